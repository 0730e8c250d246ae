"""Licence notices in texts, by Dice coefficient of word bigrams with templates.

A text's units are its lines, where they have several lines its paragraphs
(blank lines part them), and where a line has several sentences those, so a
notice may count as more than one.  Normalised, they are lower-case words of
a-z and 0-9; a unit is compared by the set of its word bigrams (one word alone
is one gram).  With a and b grams, the coefficient 2c / (a + b) is at most
2 min(a, b) / (a + b), so a template of b grams can reach the threshold t only
if b t / (2 - t) <= a <= b (2 - t) / t; other templates are not looked at.  The
same bounds say how many grams must be shared, and so give words of
which a matching unit has one; texts and units without any of them go no further.

Everything is DataFrame expressions, row by row, without a shuffle.

Defined cases: a null or empty text has no units; of equal coefficients the
licence that comes first in the alphabet is named; a document without a notice
has a null licence and coefficient 0.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolumna.llm.license_texts import STANDARD

THRESHOLD = 0.7

#: Notices by licence: short forms, then whole licence texts, their parts, standard headers, titles and SPDX lines.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *STANDARD,
)


#: What stands between two sentences of a line, in place of full stop and space.
END = "\x01"
#: Grams of a template that is taken for a whole text.
LONG = 60
#: Words of ordinary prose, which tell little about a notice.
COMMON = (
    "a about after all also an and any are as at be been before but by can could did do does each except for found from had has have he her his how i if in into is it its "
    "made make many may more most must new no not of on one only or other our out over own part see she should so some such than that the their them then there these they "
    "this those time to two under up use used was way we were what when where which who whole will with within would you your"
).split()


def grams(text: str) -> list[str]:
    """Distinct grams of a template, as the expressions below make them."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))) or words


def _gram_sets(text: Column, low: int, high: int, cues: list[str]) -> Column:
    """The grams of each unit of a text that has a cue word and may have from low to high of them: one of d distinct words has d - 1 or more."""
    folded = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = F.split(F.regexp_replace(F.regexp_replace(folded, r"[.!?]+[ \t\r]+", END), f"[^a-z0-9\n{END}]+", " "), r"\n")
    sentences = F.flatten(F.transform(F.filter(marked, lambda u: F.contains(u, F.lit(END))), lambda u: F.split(u, END)))
    lines = F.transform(marked, lambda u: F.translate(u, END, " "))
    plain = F.array_join(lines, "\n")
    paragraphs = F.transform(F.filter(F.split(plain, r"\n *\n[ \n]*"), lambda p: F.rlike(p, F.lit(r"[a-z0-9] *\n *[a-z0-9]"))), lambda p: F.translate(p, "\n", " "))
    words = F.transform(F.concat(lines, paragraphs, sentences), lambda u: F.filter(F.split(u, " "), lambda x: x != ""))
    words = F.filter(words, lambda w: F.arrays_overlap(w, F.split(F.lit(" ".join(cues)), " ")) & (F.size(w) >= low) & (F.size(F.array_distinct(w)) <= high + 1))
    pairs = lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), w[i + 1])))
    return F.transform(words, lambda w: F.when(F.size(w) < 2, w).otherwise(pairs(w)))


def bounds(grams_: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of grams of a unit that can reach the threshold with a template."""
    return math.ceil(grams_ * threshold / (2 - threshold) - 1e-9), math.floor(grams_ * (2 - threshold) / threshold + 1e-9)


def cue_words(known: list[tuple[str, tuple[str, ...]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with a template has one.

    With b grams, a template shares at least t (low + b) / 2 with such a unit. Its longest words are taken
    until fewer of its grams than that are without one; so one of the shared grams has one."""
    found: set[str] = set()
    for _, g in known:
        need = math.ceil(threshold * (bounds(len(g), threshold)[0] + len(g)) / 2 - 1e-9)
        left, words = list(g), sorted({w for x in g for w in x.split()}, key=lambda w: (w in COMMON, -len(w), w))
        if len(g) > LONG:  # few words that are in many grams
            often = Counter(w for x in g for w in x.split())
            words.sort(key=lambda w: (w in COMMON or len(w) < 4, -often[w], w))
        while len(left) >= need:
            word = words.pop(0)
            found.add(word)
            left = [x for x in left if word not in x.split()]
    return sorted(found)


def _any_of(words: list[str]) -> str:
    """A pattern of just these words, by their common beginnings."""
    rest = {c: [w[1:] for w in words if w[:1] == c] for c in sorted({w[0] for w in words if w})}
    options = [c + _any_of(r) for c, r in rest.items()] + [""] * ("" in words)
    return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"


def license_notices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each document: doc_id, n_units (units that reach the threshold), license (of the best one) and dice."""
    known = sorted({(name, tuple(grams(t))) for name, t in templates})
    limits = [bounds(len(g), threshold) for _, g in known]
    low, high = min(a for a, _ in limits), max(b for _, b in limits)

    def best(g: Column) -> Column:
        """(dice, - number of the template) of the best template for one unit."""
        options = []
        for k, ((_, t), (a, b)) in enumerate(zip(known, limits)):
            common = F.size(F.array_intersect(g, F.split(F.lit("|".join(t)), r"\|")))
            dice = F.when((F.size(g) >= a) & (F.size(g) <= b), 2.0 * common / (F.size(g) + len(t))).otherwise(0.0)
            options.append(F.struct(dice.alias("dice"), F.lit(-k).alias("place")))
        return F.array_max(F.array(*options))

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cues = cue_words(known, threshold)
    cue = F.rlike(whole, F.lit(f"(?i)(?<![a-z0-9]){_any_of(cues)}(?![a-z0-9])"))
    fitting = F.filter(_gram_sets(whole, low, high, cues), lambda g: (F.size(g) >= low) & (F.size(g) <= high))
    matches = F.filter(F.transform(fitting, best), lambda x: x["dice"] >= threshold)
    none = F.array().cast("array<struct<dice:double,place:int>>")
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.when(cue, matches).otherwise(none).alias("found"))
    top = F.array_max("found")
    name = F.element_at(F.array(*(F.lit(n) for n, _ in known)), F.lit(1) - top["place"])
    return scored.select("doc_id", F.size("found").cast("long").alias("n_units"), F.when(F.size("found") > 0, name).alias("license"), F.coalesce(F.when(F.size("found") > 0, top["dice"]), F.lit(0.0)).alias("dice"))
