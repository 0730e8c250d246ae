import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from kolumna.llm import decontam, licenses, lm_score, mixing, quality, secrets, textblocks, token_counts, topk


def key(r):
    return tuple((x is None, x) for x in r)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# Words

def test_words_against_python(odd_rows):
    texts = [r[1] for r in odd_rows]
    buf, offsets = textblocks.raw(pa.array(texts))
    words = textblocks.Words(buf, offsets)
    names = {}
    for k, t in enumerate(texts):
        mine = slice(words.first[k], words.first[k + 1])
        want = (t or "").encode().split()
        assert [buf[a:b].tobytes() for a, b in zip(words.start[mine], words.end[mine])] == want
        for w, h in zip(want, words.hash[mine].tolist()):
            assert names.setdefault(h, w.lower()) == w.lower()
    assert len(set(names.values())) == len(names)


def test_numbers_come_back_from_their_packing():
    rng = np.random.default_rng(2)
    for v in (np.zeros(0, np.int64), np.array([0]), np.array([127, 128, 16383, 16384, 2**40, 2**62]), rng.integers(0, 300, 5000), 2 ** rng.integers(0, 62, 3000)):
        assert textblocks.unsqueezed(textblocks.squeezed(v)).tolist() == v.tolist()
        assert textblocks.unpacked(textblocks.packed(v)).tolist() == v.tolist()


# Quality

@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "river", "runs", "past", "old", "mills", "and", "quiet", "towns"]) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(30, 120))) for _ in range(200)]
    bad = [" ".join(rng.choice(["BUY!!", "###", "now&&&", "win$$$"]) for _ in range(rng.randint(30, 120))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 200)) for i in range(260)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_quality_of_documents_held_out(graded):
    docs, labels = graded
    model = quality.fit(docs, labels, learn=F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r["__score"] for r in quality.scored(docs, model, ["doc_id"]).collect()}
    held = [i for i in got if i % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 200) for i in held]) > 0.95
    again = quality.fit(docs.repartition(5), labels, learn=F.col("doc_id") % 3 != 1)
    assert {r["doc_id"]: r["__score"] for r in quality.scored(docs, again, ["doc_id"]).collect()} == got


def test_statistics_against_plain_python(odd_rows):
    rng = random.Random(5)
    parts = ["the", "The", "THE", "a1", "#x", "é", "ÀB", "\n", "\n\n", "\t", " ", "word!", "word", "word", "(x)", "42", "\x0b"]
    texts = [r[1] for r in odd_rows] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = quality.statistics(*textblocks.raw(pa.array(texts)))
    assert got.shape[1] == len(quality.NAMES)
    assert np.allclose(got, [brute.statistics(t) for t in texts])


def test_trees_as_arrays_score_like_the_trees():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.Trees(0.0).fit(x, y)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    assert np.mean((model.score(x) > 0.5) == y) > 0.95


def test_quality_of_odd_rows(odd_docs, no_docs, clashing, graded, spark):
    docs, labels = graded
    model = quality.fit(docs, labels)
    out = quality.scored(odd_docs, model, ["doc_id"]).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["__score"] <= 1 for r in out)
    assert quality.kept(no_docs, model).collect() == []
    assert quality.kept(clashing, model).columns == clashing.columns
    none = quality.fit(no_docs, labels)
    assert {r["__score"] for r in quality.scored(odd_docs, none, ["doc_id"]).collect()} == {0.5}
    one = quality.fit(docs, labels.where("quality = 1"))
    assert len({r["__score"] for r in quality.scored(odd_docs, one, ["doc_id"]).collect()}) == 1


# Mixing

def test_targets_are_filled_like_water(spark):
    rng = random.Random(9)
    for n in (1, 2, 5, 9):
        sizes = [(chr(97 + i), rng.choice([0, 3, 50, 1000, 40_000])) for i in range(n - 1)] + [(None, 70)]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s, _ in sizes if s), key=str.encode) + [None])}
        total, capped = sum(x for _, x in sizes), {}
        while True:
            rest = [s for s, _ in sizes if s not in capped]
            share = (total - sum(capped.values())) / sum(weight[s] for s in rest) if rest else 0
            over = {s: 3 * x for s, x in sizes if s not in capped and share * weight[s] > 3 * x}
            if not over:
                break
            capped |= over
        for s, _ in sizes:
            assert got[s] == pytest.approx(capped.get(s, share * weight[s]))
        assert sum(got.values()) == pytest.approx(total)


def test_mix_of_many_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 10 % 4).cast("string")).alias("source"), F.expr("repeat('w ', cast(1 + id % 37 as int))").alias("text"))
    got = mixing.mix_report(docs).collect()
    assert len(got) == 4000 and all(0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    for source in range(4):
        mine = [r for r in got if r["doc_id"] % 10 % 4 == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 37
    assert rows(mixing.mix_report(docs.repartition(7))) == rows(mixing.mix_report(docs))
    out = mixing.mixed(docs)
    assert out.count() == sum(r["taken"] // r["size"] for r in got) and out.columns == [*docs.columns, "copy"]


def test_affinities_change_inclusion(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"), F.lit("five words in each text").alias("text"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("like"))
    got = {r["doc_id"]: r["taken"] // 5 for r in mixing.mix_report(docs, affinity=F.col("like"), weights=(1, 5)).collect()}
    even, odd = (np.mean([n for i, n in got.items() if i < 4000 and i % 2 == k]) for k in (0, 1))
    assert 2.2 < even / odd < 4  # three times the copies, within the error of sampling


def test_mix_of_odd_rows(odd_docs, no_docs, clashing, odd_rows):
    got = mixing.mix_report(odd_docs).collect()
    assert len(got) == len(odd_rows) and sorted(r["size"] for r in got) == sorted(len((r[1] or "").split()) for r in odd_rows)
    assert mixing.mix_report(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []
    assert sorted(mixing.mixed(clashing).columns) == sorted(clashing.columns)


# Search

def test_search_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (700, 8)))]
    vectors += [(i, vectors[3][1]) for i in range(700, 900)] + [(900, None), (None, [1.0] * 8), (901, [1.0, None]), (950, [float("nan")] * 8), (1000, [0.5] * 3), (1050, []), (1100, [1e30] * 8), (1101, [float("inf")] * 8)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(3)
    small = df.where("vec_id <> 1100 or vec_id is null")
    want = brute.best([v for v in vectors if v[0] != 1100])
    assert rows(topk.top_k(small, "id % 50 = 0", data_block=128, query_block=7)) == want
    assert rows(topk.top_k(small, "id % 50 = 0")) == want
    held = topk.top_k(df, "id = 1100", data_block=10_000).collect()
    assert sorted(r["rank"] for r in held) == [1, 2, 3, 4, 5]
    assert all(-(2**63) <= r["score"] < 2**63 for r in held)
    assert topk.top_k(df.limit(0), "id % 50 = 0").collect() == []


def _clustered(n, groups, dim=32, spread=0.03):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(groups, dim))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    return np.floor(256 * (middle[rng.integers(0, groups, n)] + rng.normal(0, spread / np.sqrt(dim), (n, dim))))


def test_trees_prune_what_has_structure():
    x = _clustered(6000, 40)
    q, ids = x[::20], np.arange(6000)
    work = []
    scores, names, found = topk.search(q, ids[::20], x, ids, 5, work=work)
    assert sum(work) < 0.25 * len(q) * len(x) and found.all()
    products = (q @ x.T).astype(np.int64)
    products[np.arange(len(q)), ids[::20]] = -(2**62)
    for k in range(len(q)):
        assert names[k].tolist() == np.lexsort((ids, -products[k]))[:5].tolist()
    late = []
    topk.search(q, ids[::20], x, ids, 5, scores[:, -1].astype(float), late)
    assert sum(late) <= sum(work)


def test_cells_that_cannot_matter_are_left_out(spark):
    x = _clustered(6000, 40)
    centres = topk.centres_of(x[::7], 40)
    owner, far = topk._nearest(x, centres)
    radius, most = (np.array([y[owner == c].max(initial=-1) for c in range(len(centres))]) for y in (far, np.linalg.norm(x, axis=1)))
    q = x[::50]
    beat = np.sort(q @ x.T, axis=1)[:, -6]
    at = topk.reached(q, beat, centres, radius, most)
    assert at.mean() < 0.2
    for k, c in zip(*np.nonzero(~at)):
        assert not len(x[owner == c]) or (x[owner == c] @ q[k]).max() < beat[k]
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x[:3000])], "vec_id bigint, embedding array<double>").repartition(3)
    want = brute.best([(i, (v / 256).tolist()) for i, v in enumerate(x[:3000])])
    assert rows(topk.top_k(df, "id % 50 = 0", cell=100, data_block=64, query_block=5)) == want


def test_few_candidates_and_shared_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert rows(topk.top_k(df, "id % 50 = 0")) == [(0, 1, 1, 65536), (0, 1, 1, 65536)]


def test_cover_tree_covers():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(800, 5)), np.zeros((300, 5))])
    tree = topk.CoverTree(x)
    for n, children in enumerate(tree.children):
        d = np.sqrt(((x[tree.rows[n]] - x[tree.centre[n]]) ** 2).sum(axis=1))
        assert d.max() <= tree.radius[n] + 1e-9
        if children is not None:
            assert sorted(np.concatenate([tree.rows[c] for c in children]).tolist()) == sorted(tree.rows[n].tolist())


# Licences

def test_licence_notices(spark, odd_docs, no_docs, clashing):
    texts = [
        "Intro line\nLicensed under CC BY-NC 4.0.\nmore", "LICENSED under cc by nc 4.0 !", "Released\nunder the MIT License.", "no licence here", "", None, "Licensed under the Apache License, Version 2.0",
        "This work is licensed under the GNU General Public License, version 3, or later.", "the license of the apache version is long and has nothing to do with anything else under the sun " * 5,
    ]
    got = {r["doc_id"]: r for r in licenses.license_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i]["license"] for i in range(9)] == ["CC-BY-NC-4.0", "CC-BY-NC-4.0", "MIT", None, None, None, "Apache-2.0", "GPL-3.0", None]
    assert got[0]["dice"] == 1.0 and got[0]["n_units"] == 2 and got[3]["dice"] == 0.0
    inside = "Some words of a longer line stand before it! Released under the MIT License.  And so do others, after it; they are many and of no use."
    got = licenses.license_notices(spark.createDataFrame([(1, inside), (2, inside.replace(". ", ", "))], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["license"], r["n_units"]) for r in got} == {1: ("MIT", 1), 2: (None, 0)}
    assert licenses.license_notices(odd_docs).count() == odd_docs.count() and licenses.license_notices(no_docs).collect() == []
    assert licenses.license_notices(clashing).count() == odd_docs.count()


def test_standard_licence_texts(spark):
    from kolumna.llm.license_texts import TEXTS

    mit = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""
    texts = [
        ("MIT", mit), ("MIT", mit.split("\n\n", 2)[2]), ("GPL-3.0", gpl.format(3)), ("GPL-2.0", gpl.format(2)), ("AGPL-3.0", gpl.format(3).replace("GNU", "GNU Affero")), ("BSD-family", bsd),
        ("MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (None, "SPDX-License-Identifier: Zlib"), *((n, "Copyright 2020 A. U. Thor " + " ".join(t.split())) for n, t in TEXTS.items()),
    ]
    got = {r["doc_id"]: r["license"] for r in licenses.license_notices(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id bigint, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == [n for n, _ in texts]


def test_pruning_loses_no_match():
    """Bounds and cue words against all templates and many cut-up notices."""
    known = sorted({(n, tuple(licenses.grams(t))) for n, t in licenses.TEMPLATES})
    cues = set(licenses.cue_words(known, licenses.THRESHOLD))
    rng = random.Random(2)
    for name, g in known:
        low, high = licenses.bounds(len(g), licenses.THRESHOLD)
        for _ in range(200):
            unit = set(rng.sample(g, rng.randint(1, len(g)))) | {f"z{i} z{i + 1}" for i in range(rng.randint(0, 9))}
            if 2 * len(unit & set(g)) / (len(unit) + len(g)) >= licenses.THRESHOLD:
                assert low <= len(unit) <= high and cues & {w for x in unit for w in x.split()}


# Decontamination

def test_hits_against_brute_force(spark, odd_docs, odd_rows, no_docs, clashing):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["Ä", "é1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(30)]
    items += [(30, None), (31, ""), (None, "w1 w2"), (32, items[0][1]), (32, items[1][1]), (33, " ".join(f"base{i}" for i in range(40, 60)))]
    docs = [(i, " ".join(rng.choice([rng.choice(words), (rng.choice(items)[1] or "").upper(), f"z{rng.random()}"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    for frame, plain in ((spark.createDataFrame(docs, "doc_id bigint, text string"), docs), (odd_docs, [r[:2] for r in odd_rows])):
        want = sorted(brute.hits(plain, items), key=key)
        assert rows(decontam.contamination(frame, table).select(columns)) == want
        assert rows(decontam.contamination(frame, table, piece=60).select(columns)) == want  # several pieces of items
    assert decontam.contamination(no_docs, table).collect() == []
    assert {r["n_items"] for r in decontam.contamination(odd_docs, table.limit(0)).collect()} == {0}
    out = decontam.clean(clashing, table)
    assert out.columns == clashing.columns
    bad = {x[0] for x in brute.hits([r[:2] for r in odd_rows], items) if x[2] and 20 * x[2] >= x[1] and x[0] is not None}
    assert sorted((r["doc_id"] for r in out.collect()), key=lambda x: (x is None, x)) == sorted((r[0] for r in odd_rows if r[0] not in bad), key=lambda x: (x is None, x))


def test_passages_are_masked_and_judges_by_text(spark):
    passage, prose = " ".join(f"bench{i}" for i in range(13)), " ".join(f"Prose{i}," for i in range(400))
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    mixed = f"{prose}\n{passage.upper()}. End {passage}"
    docs = spark.createDataFrame([(1, f"{mixed} {prose}"), (2, prose), (None, passage), (None, prose), (3, passage), (3, "a clean text")], "doc_id bigint, text string")
    out = decontam.without_passages(docs, items)
    assert rows(out) == sorted([(1, f"{prose}\n[BENCHMARK]. End [BENCHMARK] {prose}"), (2, prose), (None, prose), (3, "a clean text")], key=key)
    assert out.schema == docs.schema and {r["n_hit"] for r in decontam.contamination(out, items).collect()} == {0}
    more = items.unionByName(spark.createDataFrame([(k, f"other{k} words of an item that is nowhere") for k in range(2, 30)], "item_id bigint, text string"))
    assert rows(decontam.without_passages(docs, more, piece=40)) == rows(out)  # several pieces


def test_one_passage_in_a_long_document_does_not_survive(spark):
    """A passage of 13 words among 2,000, and one at the end of a text of 12 MB."""
    passage = " ".join(f"bench{i}" for i in range(13))
    prose = " ".join(f"prose{i}" for i in range(2000))
    long = "lorem ipsum dolor " * 650_000
    docs = spark.createDataFrame([(1, f"{prose} {passage} {prose}"), (2, f"{long}{passage}"), (3, prose)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert [r["n_hit"] for r in decontam.contamination(docs, items).orderBy("doc_id").collect()] == [13, 13, 0]
    out = {r["doc_id"]: r["text"] for r in decontam.without_passages(docs, items).collect()}
    assert out == {1: f"{prose} [BENCHMARK] {prose}", 2: f"{long}[BENCHMARK]", 3: prose}
    assert [r["doc_id"] for r in decontam.without_passages(docs, items, share=None).collect()] == [3]


# Tokens

def test_token_counts_against_the_library(spark, odd_docs, odd_rows, no_docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    parts = [" ", "  ", "▁", "a", "the", "ing", "\n", "\t", "é", "漢", "🙂", "</s>", "<s>", "<unk>", "\0", "1", "234", ".", " \n", "´"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", " ", "  ", "▁", " a", "a ", "a▁ b"]
    assert token_counts.count_batch(token_counts.Counter(path), pa.array(texts, pa.large_string())).tolist() == [len(model.encode(t)) for t in texts]
    got = rows(token_counts.token_counts(odd_docs, path, limit=50))
    assert got == sorted(((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 50) for r in odd_rows), key=key)
    assert token_counts.token_counts(no_docs, path).collect() == []


# Secrets

def test_base_spans(odd_docs, odd_rows, no_docs):
    text = """Password : "abcdefgh1" token=short API_KEY='k/+.=-_9Z' AKIA12345678901A AKIA123 0123456789abcdef0123456789abcdef! ſecret=aaaaaaaaaa"""
    found = [(k, text[s:e]) for s, k, e in secrets.base_spans(text)]
    assert found == [("assign", "abcdefgh1"), ("assign", "k/+.=-_9Z"), ("access", "AKIA12345678901A"), ("hex", "0123456789abcdef0123456789abcdef")]
    both = f'token = "{"0f" * 20}"'
    assert [(k, both[s:e]) for s, k, e in secrets.base_spans(both)] == [("assign", "0f" * 20), ("hex", "0f" * 20)]
    got = rows(secrets.secret_spans(odd_docs))
    assert [(*r[:5], r[6]) for r in got] == sorted(((r[0], *brute.secret_digests(r[1])) for r in odd_rows), key=key)
    for r in got:
        assert [p for p in r[5].split(",") if p] == sorted((p for p in r[5].split(",") if p), key=lambda p: (int(p.split(":")[1]), secrets.KINDS.index(p.split(":")[0])))
    assert secrets.secret_spans(no_docs).collect() == []


def test_base_spans_against_a_scan_by_hand(spark):
    rng = random.Random(8)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "api", "=", ":", " ", "  ", "'", '"', "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "deadbeef", "z", "é", "🙂", "\n", "ſecret", "x.y/z+w-", "tokentoken", "AKIAAKIA"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2500)]
    for t in texts:
        found = sorted((k, s, e) for s, k, e in secrets.base_spans(t))
        assert found == sorted((k, s, e) for k, s, e, _ in brute.secret_base(t))
        assert sorted((k, s, e) for s, k, e in secrets.base_matches(t, secrets.base_spans(t))) == sorted((k, m, e) for k, _, e, m in brute.secret_base(t))


def test_long_texts_with_many_secrets(spark, field):
    """3 MB on one line: every secret is found, and every stretch of the line may be fitted on."""
    words = "river mill town bridge stone water quiet garden market street letter".split()
    lines = secrets.made_lines(words, 40_000, seed=3)
    text, spans = " ".join(t for t, _ in lines), []
    at = 0
    for t, s in lines:
        spans += [(at + a, at + b) for a, b in s]
        at += len(t) + 1
    found = [(s, e) for s, _, e in secrets.spans_of(field, pa.array(["x", text]))[1]]
    assert len(text) > 2_500_000 and found == sorted(found)
    assert len(set(found) & set(spans)) > 0.85 * len(spans)
    stretches = list(secrets._tagged(text, spans))
    assert sum(len(t) for _, t in stretches) == len(secrets.features(*textblocks.raw(pa.array([text])))[1]) and sum((t == 1).sum() for _, t in stretches) >= len(spans)


@pytest.fixture(scope="module")
def field():
    words = "river mill town bridge stone water quiet garden market street letter".split()
    lines = [x for t, s in secrets.made_lines(words, 500) for x in secrets._tagged(t, s) if len(x[1])]
    return secrets.Field().fit(lines)


def test_field_finds_secrets_in_lines_held_out(field):
    words = "harbour castle tower winter summer forest valley".split()
    right = missed = wrong = 0
    for text, spans in secrets.made_lines(words, 400, seed=99):
        found = {(s, e) for s, k, e in secrets.spans_of(field, pa.array([text]))[0]}
        covered = lambda a, b: any(s <= a and b <= e or a <= s and e <= b for s, e in found)
        right += sum(covered(*s) for s in spans)
        missed += sum(not covered(*s) for s in spans)
        wrong += bool(found) and not spans
    assert right / (right + missed) > 0.9 and wrong / 400 < 0.03


#: Surroundings that are not among those of the fit.
NEW_FRAMES = ('SECRET_KEY_BASE = {}', 'credential: "{}"', "db_pass={}", "--auth={}", 'login with passphrase "{}"', "Authorization: Basic {}", "my key: {}", "ACCESS_TOKEN_2='{}'", "the pwd is {}", "signing_key={}")
NEW_PLAIN = ("release {}", "room {} at noon", "price = {}", "see chapter {}", "name: {}", "ticket {} closed", "http://example.com/{}", "total: {}", "the key point", "a token of thanks", "pass the {} bridge")


def test_field_in_surroundings_that_it_was_not_fitted_on(field):
    words = "harbour castle tower winter summer forest valley".split()
    right = missed = wrong = 0
    for text, spans in secrets.made_lines(words, 1000, 99, NEW_FRAMES, NEW_PLAIN):
        found = {(s, e) for s, _, e in secrets.spans_of(field, pa.array([text]))[0]}
        right += sum(s in found for s in spans)
        missed += sum(s not in found for s in spans)
        wrong += len(found - set(spans))
    print("recall", right / (right + missed), "precision", right / (right + wrong))
    assert right / (right + missed) > 0.6 and right / (right + wrong) > 0.9


def test_viterbi_against_all_paths(field):
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(20):
        e = rng.normal(0, 3, (6, 3))
        score = lambda p: field.start[p[0]] + e[0, p[0]] + sum(field.moves[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))
        assert score(tuple(field.viterbi(e))) == pytest.approx(max(map(score, product(range(3), repeat=6))))


def test_lines_that_are_not_decoded_have_no_tags(field, odd_rows):
    buf, offsets = textblocks.raw(pa.array([r[1] for r in odd_rows] + [t for t, _ in secrets.made_lines(["word"], 60)]))
    _, line, table = secrets.features(buf, offsets)
    e = field.emissions(table)
    every = np.concatenate([field.viterbi(e[line == k]) for k in range(line[-1] + 1)])
    assert (field.tag(line, table) == every).all()


def test_redaction(clashing, odd_docs, no_docs):
    out = secrets.redacted(clashing)
    assert out.columns == clashing.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[15] == 'password="[SECRET]" [SECRET] and [SECRET]' and texts[5] is None and texts[4] == ""
    assert secrets.redacted(no_docs).collect() == []


# Language model

def test_base_scores_and_counts(odd_docs, odd_rows, no_docs):
    for block in (lm_score.BLOCK, 3000):
        got = rows(lm_score.scores(odd_docs, block=block))
        want = sorted(brute.lm_base([r[:2] for r in odd_rows]), key=key)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert all(a[5] == pytest.approx(b[5]) and math.isfinite(a[6]) for a, b in zip(got, want))
    assert lm_score.scores(no_docs).collect() == []


def test_model_beats_unigrams_on_texts_held_out(spark):
    rng = random.Random(0)
    follow = {w: rng.sample("abcdefghij", 3) for w in "abcdefghij"}

    def text():
        w = [rng.choice("abcdefghij")]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id bigint, text string")
    held = lm_score.scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] / held[2] > held[1] / held[2] + 0.3


def test_every_bigram_of_training_texts_counts(spark):
    import zlib

    learnt, held = ([i for i in range(100) if (zlib.crc32(str(i).encode()) % 10 != 0) == t] for t in (True, False))
    texts = ["x " * 1_200_000, "red green", "blue gold"]  # a million tokens or more: a bigram seen once is rarer than 1e-6
    docs = [*zip(learnt, texts), (held[0], "red green"), (held[1], "red gold")]
    count, total = {"red": 1, "green": 1, "blue": 1, "gold": 1, "x": 1_200_000, None: 3}, 1_200_007

    def plain(words, seen):
        p = [(count[w] + 0.1) / (total + 0.1 * 7) for w in words]
        once = 2 ** (0.5 / lm_score.STEPS)  # a count of one, read back from the filter
        return sum(math.log10((once * s + lm_score.MU * q) / (max(c, once * s) + lm_score.MU)) for q, s, c in zip(p, seen, (3, *(count[w] for w in words[:-1]))))

    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for block in (lm_score.BLOCK, 300_000):  # one shard, and several
        got = {r["doc_id"]: r["score"] for r in lm_score.scores(frame, block=block).collect()}
        assert got[held[0]] == pytest.approx(plain(["red", "green", None], (1, 1, 1)))
        assert got[held[1]] == pytest.approx(plain(["red", "gold", None], (1, 0, 1)))


def test_scores_against_plain_counts(spark, odd_rows):
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(i + 1000 if i is not None else None, t) for i, t, *_ in odd_rows]
    docs += [(200, "twice seen words of a text"), (201, "twice seen words of a text")]
    want = sorted(zip((i for i, _ in docs), brute.lm_score(docs, 2, lm_score.MU, lm_score.STEPS)), key=key)
    for block in (lm_score.BLOCK, 500):
        got = sorted(((r["doc_id"], r["score"]) for r in lm_score.scores(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), block=block).collect()), key=key)
        off = [abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)]
        # A Bloom filter takes some n-grams that it never saw for seen ones.
        assert np.mean(np.array(off) < 1e-6) > 0.9 and max(off) < 5


def test_filter_reads_back_counts():
    rng = np.random.default_rng(4)
    keys, counts = rng.integers(-(2**62), 2**62, 5000), rng.integers(7, 100_000, 5000)
    f = lm_score.LogFrequencyFilter(keys, counts, 7)
    got = f.counts(keys)
    step = 2 ** (1 / lm_score.STEPS)
    assert (got >= counts / step - 1e-9).all() and np.mean(np.abs(np.log(got / counts)) < math.log(step)) > 0.98
    assert np.mean(f.counts(rng.integers(2**62, 2**63 - 1, 5000)) > 0) < 0.02


# Every operator

def test_columns_of_other_names_change_nothing(spark, odd_docs, clashing):
    """Extra columns of names that the operators use themselves."""
    tokenizers = pytest.importorskip("public_tokenizers")
    from kolumna.llm import near_dup, suffix_dedup

    path = tokenizers.path("piece_bpe_32k.model")
    more = clashing.select("*", *(F.lit("x").alias(n) for n in ("train", "n_bytes", "n_words", "hashes", "step", "times", "tokens", "doc", "a", "b", "__id", "__size", "__spans", "__score", "__text")))
    for run in (lambda d: token_counts.token_counts(d, path), secrets.secret_spans, lm_score.scores, mixing.mix_report, suffix_dedup.removal_report, licenses.license_notices, near_dup.near_duplicates):
        assert rows(run(more)) == rows(run(odd_docs))
    vectors = [(i, [float(i % 7), float(i % 5)]) for i in range(120)]
    plain = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    assert rows(topk.top_k(plain.select("*", *(F.lit(1).alias(n) for n in ("row", "id", "v", "cell", "far", "norm", "beat", "part", "group", "rank", "score"))), "id % 50 = 0")) == rows(topk.top_k(plain, "id % 50 = 0"))
    items = spark.createDataFrame([(1, "base1 base2 base3")], "item_id bigint, text string")
    for piece in (decontam.PIECE, 1):
        out = decontam.without_passages(more, items, piece=piece)
        assert out.columns == more.columns and out.count() == decontam.without_passages(odd_docs, items, piece=piece).count()


def test_a_text_of_twelve_megabytes(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from kolumna.llm import near_dup, suffix_dedup

    rng = random.Random(13)
    text = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300_000)}" for _ in range(1_600_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, text[:500]), (5, "z" * 11_000_000)], "doc_id bigint, text string").withColumn("source", F.lit("s")).repartition(2)
    assert len(text) > 11_000_000
    model = quality.Trees(0.0).flat()
    assert {r["__score"] for r in quality.scored(docs, model, ["doc_id"]).collect()} == {0.5}
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removal_report(docs).collect()}
    assert removed == {1: len(text), 2: len(text), 3: len(text), 4: 500, 5: 11_000_000}
    assert {r["doc_id"]: r["size"] for r in mixing.mix_report(docs).collect()} == {1: 1_600_000, 2: 1_600_000, 3: 1_600_001, 4: len(text[:500].split()), 5: 1}
    assert {r["n_units"] for r in licenses.license_notices(docs).collect()} == {0}
    assert all(math.isfinite(r["score"]) for r in lm_score.scores(docs).collect())
    assert len(secrets.secret_spans(docs).collect()) == 5
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {1: len(model.encode(text)), 4: len(model.encode(text[:500]))}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs.where("doc_id < 5"), path).collect()}
    assert got[1] == got[2] == want[1] and got[4] == want[4]


def test_ties(spark):
    """Equal ids and sizes in the mix, and licences of equal coefficient."""
    docs = spark.createDataFrame([(7 if i % 2 else None, "one two three", "a" if i < 40 else "b") for i in range(60)], "doc_id bigint, text string, source string").repartition(4)
    got = mixing.mix_report(docs).collect()
    for source in "ab":
        mine = [r for r, d in zip(got, got) if r["source_size"] == (120 if source == "a" else 60)]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3 and all(r["taken"] in (0, 3, 6, 9) for r in mine)
    assert mixing.mixed(docs).count() == sum(r["taken"] for r in got) // 3
    two = (("Zeta", "alpha beta gamma delta"), ("Beta", "alpha beta gamma delta"), ("Alpha", "other words here now"))
    found = licenses.license_notices(spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "x")], "doc_id bigint, text string"), templates=two).collect()
    assert {r["doc_id"]: (r["license"], r["dice"]) for r in found} == {1: ("Beta", 1.0), 2: (None, 0.0)}


def test_altered_notices(spark):
    """Notices with words changed, left out and added are found down to the threshold, and the coefficient is as counted by hand."""
    from kolumna.llm.license_texts import TEXTS

    rng = random.Random(4)
    made = []
    for name, text in TEXTS.items():
        words = text.split()
        for share in (0.02, 0.1, 0.5):
            made.append((name, share, " ".join(rng.choice(["changed", w + " added", ""]) if rng.random() < share else w for w in words)))
    got = {r["doc_id"]: r for r in licenses.license_notices(spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(made)], "doc_id bigint, text string")).collect()}
    templates = [(n, set(licenses.grams(t))) for n, t in licenses.TEMPLATES]
    for k, (name, share, text) in enumerate(made):
        units = [set(licenses.grams(u)) for u in (text, *re.split(r"[.!?]+[ \t\r]+", text))]
        best = max((2 * len(u & t) / (len(u) + len(t)), n) for u in units if u for n, t in templates)
        assert got[k]["dice"] == pytest.approx(best[0] if best[0] >= licenses.THRESHOLD else 0.0)
        # A sentence that BSD licences share may be nearer to its template than the whole text is to its own.
        assert share > 0.02 or got[k]["license"] in (name, "BSD-family" if "BSD" in name else name)


# Pipeline

def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on what the one before kept, over the smallest tables."""
    import os

    import corpus_pipeline
    from kolumna.llm.work import saved

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = saved(stage(spark, docs, data), name)
        got = sorted(r["doc_id"] for r in kept[name].collect())
        plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
            assert got == sorted(r["doc_id"] for r in quality.scored(docs, model, ["doc_id"]).collect() if r["__score"] >= 0.5)
        if name == "near_duplicates":
            assert got == sorted(i for i, _, _, keep in brute.near_groups(plain, 5) if keep)
        if name == "decontamination":
            assert got == sorted(h[0] for h in brute.hits(plain, items) if not h[2])
        if name == "secrets":
            assert got == sorted(i for i, _ in plain)
            texts = {r["doc_id"]: r["text"] for r in kept[name].collect()}
            for i, t in plain:
                spans = brute.secret_base(t)
                assert not [x for x in brute.secret_base(texts[i]) if "[SECRET]" not in texts[i][x[1] : x[2]]]
                assert spans or texts[i] == t or "[SECRET]" in texts[i]
        if name == "mixing":
            want = [r["doc_id"] for r in mixing.mix_report(docs).collect() for _ in range(r["taken"] // r["size"] if r["size"] else 0)]
            assert got == sorted(want)
        docs = kept[name]
    whole = corpus_pipeline.run(spark, data)
    assert rows(whole.select("doc_id", "text", "copy")) == rows(docs.select("doc_id", "text", "copy"))


def test_pipeline(spark, odd_docs, odd_rows, tmp_path):
    import corpus_pipeline

    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (7, 1, 0), (13, 0, 0), (14, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w{i % 977}x{i % 13}" for i in range(40)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_docs.columns + ["copy"] * (name == "mixing")
    assert sorted(docs.columns) == sorted(corpus_pipeline.run(spark, str(tmp_path)).columns)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
