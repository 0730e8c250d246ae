"""Benchmark passages inside documents: a prefix-filtered set join of shingles.

An item is cut in windows of ``WINDOW`` words.  A window is contained in a
document only if all its shingles are, so one of them is enough to look for:
the necessary prefix of a window, at full containment, is its rarest shingle.
Rarity is counted over all documents.  Where a document has that shingle, the
shingle's place in the window fixes where the window would have to lie; places
that reach over either end of the document go (length and positional bounds),
and the rest are compared word by word.

The items' index is broadcast; ``PIECE`` bounds one broadcast and what the
driver holds, and more items make more pieces, each of which passes over the
documents once.  Hashes find candidates; words are compared by their bytes.

Defined cases: a null text has no words; an item without words or without an
id takes no part; an item of fewer words than a window is one window; items
that share an id count once; rows of documents are judged one by one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm import textblocks
from kolumna.llm.work import modest, saved

WINDOW, SHINGLE = 13, 4
#: Words of items whose index makes one broadcast: about 60 bytes a word, so 16 MB at most (a longer item alone is more).
PIECE = 250_000

_U = np.uint64


class Index:
    """Windows of some items: word hashes and bytes, lengths, items; and, once rarity is known, each window's rarest shingle and its place."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        a = pa.array([t for _, t in items], pa.large_string())
        words = textblocks.Words(*textblocks.raw(a), textblocks.ALNUM)
        self.hashes = words.hash
        self.bytes, self.start, self.end = textblocks.FOLD[words.buf], words.start, words.end
        self.shingle, self.window = shingle, window
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        found: dict[bytes, int] = {}
        pairs: set[tuple[int, int]] = set()
        at, length = [], []  # where a window's words are among the items' words; each distinct window once
        self.spans = []  # the items' words, for rarity
        for k, (item, _) in enumerate(items):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if b > a:
                self.spans.append((a, b))
            for s in range(a, max(a, b - window) + 1) if b > a else ():
                part = self.hashes[s : min(s + window, b)]
                w = found.setdefault(part.tobytes(), len(found))
                if w == len(at):
                    at.append(s)
                    length.append(len(part))
                pairs.add((w, number[item]))
        ordered = sorted(pairs)
        self.window_of = np.array([p[0] for p in ordered], np.int64)
        self.item_of = np.array([p[1] for p in ordered], np.int64)
        self.at, self.length = np.array(at, np.int64), np.array(length, np.int64)
        self.sizes = sorted({min(shingle, int(n)) for n in np.unique(self.length)})
        # All shingles of all windows, by shingle size: what rarity is counted for.
        self.tokens = {z: np.unique(np.concatenate([textblocks.shingles(self.hashes[a:b], z) for a, b in self.spans if min(shingle, b - a) == z])) for z in self.sizes}

    def __len__(self) -> int:
        return len(self.at)

    def choose(self, counts: dict[int, np.ndarray]) -> Index:
        """Set each window's rarest shingle (ties: the first) by the counts over all documents."""
        rare_at, place_at = np.zeros(len(self.hashes), _U), np.zeros(len(self.hashes), np.int64)
        for a, b in self.spans:
            z = min(self.shingle, b - a)
            s = textblocks.shingles(self.hashes[a:b], z)
            n = min(self.window, b - a) - z + 1
            place = np.lib.stride_tricks.sliding_window_view(counts[z][np.searchsorted(self.tokens[z], s)], n).argmin(axis=1)
            rare_at[a : a + len(place)], place_at[a : a + len(place)] = s[np.arange(len(place)) + place], place
        rare, place = rare_at[self.at], place_at[self.at]
        self.prefix = {}
        size = np.minimum(self.length, self.shingle)
        for z in self.sizes:
            w = np.flatnonzero(size == z)
            w = w[np.argsort(rare[w], kind="stable")]
            self.prefix[z] = (rare[w], place[w], w)
        self.spans = []
        return self


class _Sieve:
    """Which of many hashes are in a sorted table: a bitmap first, then a search."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = max(16, int(len(table)).bit_length() + 5)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(table >> _U(64 - self.bits)).astype(np.int64)] = True

    def where(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.map[(h >> _U(64 - self.bits)).astype(np.int64)])
        k = np.searchsorted(self.table, h[at])
        k[k == len(self.table)] = 0
        return at[self.table[k] == h[at]] if len(self.table) else at[:0]


def _inside(words: textblocks.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that do not cross texts, and the word each starts at."""
    s = textblocks.shingles(words.hash, size)
    text = words.text_of
    at = np.flatnonzero(text[: len(s)] == text[size - 1 :][: len(s)])
    return s[at], at


def _count(index) -> object:
    """Documents to how often they hold each shingle of the items: (size, place in the table, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = index.value.tokens
        sieves = {z: _Sieve(t) for z, t in tokens.items()}
        n = {z: np.zeros(len(t), np.int64) for z, t in tokens.items()}
        for batch in batches:
            buf, offsets = textblocks.raw(textblocks.column(batch, "text"))
            for i, j in textblocks.blocks(offsets):
                words = textblocks.Words(buf, offsets[i : j + 1], textblocks.ALNUM)
                for z, sieve in sieves.items():
                    s, _ = _inside(words, z)
                    n[z] += np.bincount(np.searchsorted(tokens[z], s[sieve.where(s)]), minlength=len(tokens[z]))
        for z, counts in n.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), z), pa.int32()), pa.array(at, pa.int64()), pa.array(counts[at])], ["size", "token", "n"])

    return run


def _same_words(x: Index, words: textblocks.Words, start: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether a document's words from ``start`` on are those of the window, byte by byte."""
    same = np.ones(len(window), bool)
    for q in range(int(x.length[window].max(initial=0))):
        at = np.flatnonzero(same & (q < x.length[window]))
        mine, its = start[at] + q, x.at[window[at]] + q
        equal = (words.hash[mine] == x.hashes[its]) & (words.end[mine] - words.start[mine] == x.end[its] - x.start[its])
        same[at[~equal]] = False
        at, mine, its = at[equal], mine[equal], its[equal]
        if not len(at):
            continue
        n = x.end[its] - x.start[its]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        differ = textblocks.FOLD[words.buf[np.repeat(words.start[mine], n) + step]] != x.bytes[np.repeat(x.start[its], n) + step]
        same[at[np.add.reduceat(differ.astype(np.int64), first) > 0]] = False
    return same


def _occurrences(x: Index, sieves: dict[int, _Sieve], words: textblocks.Words) -> tuple[np.ndarray, ...]:
    """Where windows lie in a block of texts: text, first word, number of words, window."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    for z, (rare, place, window) in x.prefix.items():
        s, at = _inside(words, z)
        k = sieves[z].where(s)
        lo, hi = np.searchsorted(rare, s[k], "left"), np.searchsorted(rare, s[k], "right")
        m = hi - lo
        p = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
        start = np.repeat(at[k], m) - place[p]
        text = np.repeat(words.text_of[at[k]], m)
        w = window[p]
        fits = (start >= words.first[text]) & (start + x.length[w] <= words.first[text + 1])
        start, text, w = start[fits], text[fits], w[fits]
        same = _same_words(x, words, start, w)
        found.append((text[same], start[same], x.length[w[same]], w[same]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _spans(first: np.ndarray, length: np.ndarray, n: int) -> list[int]:
    """Runs of hit words of one text of n words, as first, past, first, past ..."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + length, -1)
    on = np.cumsum(mark)[:-1] > 0
    return np.flatnonzero(np.diff(np.concatenate(([False], on, [False])))).tolist()


def _sieves(x: Index) -> dict[int, _Sieve]:
    return {z: _Sieve(np.unique(p[0])) for z, p in x.prefix.items()}


def _hits(index):
    """Documents (doc_id, text, key) to n_words, hit words as [first, past) pairs, and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        sieves = _sieves(x)
        for batch in batches:
            buf, offsets = textblocks.raw(textblocks.column(batch, "text"))
            for i, j in textblocks.blocks(offsets):
                words = textblocks.Words(buf, offsets[i : j + 1], textblocks.ALNUM)
                n = j - i
                per = np.diff(words.first)
                text, first, length, w = _occurrences(x, sieves, words)
                spans: list[list[int]] = [[] for _ in range(n)]
                items: list[list[str]] = [[] for _ in range(n)]
                for t in np.unique(text).tolist():
                    mine = text == t
                    spans[t] = _spans(first[mine] - words.first[t], length[mine], int(per[t]))
                    ws = np.unique(w[mine])
                    lo, hi = np.searchsorted(x.window_of, ws, "left"), np.searchsorted(x.window_of, ws, "right")
                    items[t] = sorted({x.ids[k] for a, b in zip(lo, hi) for k in x.item_of[a:b].tolist()})
                yield pa.RecordBatch.from_arrays(
                    [*(textblocks.column(batch, c).slice(i, n) for c in ("doc_id", "key")), pa.array(per, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "key", "n_words", "spans", "items"],
                )

    return run


def _alone(index):
    """Of one piece of items: hits and their digests in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _hits(index)(batches):
            n = np.arange(len(batch) + 1, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(n), textblocks.column(batch, c)) for c in ("spans", "items")]
            yield from _digest(iter([pa.RecordBatch.from_arrays([textblocks.column(batch, "doc_id"), textblocks.column(batch, "n_words"), *lists], ["doc_id", "n_words", "parts", "lists"])]))

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, shas, spans, found = [], [], [], [], []
        for parts, items in zip(textblocks.column(batch, "parts").to_pylist(), textblocks.column(batch, "lists").to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted(p for part in parts for p in zip(part[::2], part[1::2])):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            ids = sorted({i for x in items for i in x})
            n_hit.append(sum(b - a for a, b in merged))
            n_items.append(len(ids))
            shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            spans.append([{"start": a, "end": b} for a, b in merged])
            found.append(ids)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*(textblocks.column(batch, c) for c in ("doc_id", "n_words")), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans", "items"],
        )


def _pieces(items: DataFrame, item_id: str, item_text: str, piece: int) -> Iterator[list[tuple[str, str]]]:
    """Items in pieces of about ``piece`` words, dealt by their ids; the driver holds one piece at a time. At least one piece, of no items if there are none."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    # Two bytes hold a word and the border after it, at least.
    words = rows.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0] // 2
    n = max(1, -(-words // piece))
    rows = rows if n == 1 else saved(rows.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), "items")
    for k in range(n):
        mine = rows if n == 1 else rows.where(F.col("piece") == k)
        held = mine.select("id", "text").toArrow()
        yield sorted(zip(held.column("id").to_pylist(), held.column("text").to_pylist()))


def _indexes(texts: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, piece: int) -> Iterator:
    """An index for each piece of the items, broadcast, with rarity counted over all of ``texts`` (text)."""
    context = texts.sparkSession.sparkContext
    for group in _pieces(items, item_id, item_text, piece):
        index = Index(group, window)
        counts = {z: np.zeros(len(t), np.int64) for z, t in index.tokens.items()}
        if len(index):
            tokens = context.broadcast(index)
            for r in texts.mapInArrow(_count(tokens), "size int, token bigint, n bigint").groupBy("size", "token").agg(F.sum("n").alias("n")).toLocalIterator():
                counts[r["size"]][r["token"]] = r["n"]
            tokens.destroy()
        yield context.broadcast(index.choose(counts))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, spans of hit words (words as numbers), items (ids as strings, sorted).

    A document is rarely worth more than a few of these words, so callers judge by n_hit against n_words."""
    rows = modest(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    return _contamination(rows, list(_indexes(rows.select("text"), items, item_id, item_text, window, piece)))


def _contamination(rows: DataFrame, indexes: list) -> DataFrame:
    """The rows of :func:`contamination` for ``rows`` (doc_id, text, key)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    if len(indexes) == 1:
        return rows.mapInArrow(_alone(indexes[0]), out)
    found = functools.reduce(DataFrame.unionByName, (rows.mapInArrow(_hits(x), f"doc_id {kind}, key string, n_words bigint, spans array<bigint>, items array<string>") for x in indexes))
    # Every piece has a row for each document: rows that are equal in id and text share one, as often as they came.
    together = found.groupBy("doc_id", "key").agg(F.first("n_words").alias("n_words"), F.collect_set("spans").alias("parts"), F.collect_set("items").alias("lists"), (F.count("*") / len(indexes)).cast("int").alias("times"))
    return together.select("doc_id", "n_words", "parts", "lists", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_").mapInArrow(_digest, out)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 20) -> DataFrame:
    """``docs`` without those of which a ``share``-th part or more of the words lie in items; rows without an id stay unjudged."""
    found = contamination(docs.where(f"`{doc_id}` is not null"), items, doc_id, text)
    gone = found.where(f"n_hit > 0 and {share} * n_hit >= n_words").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)


#: What stands for a passage.
MARK = "[BENCHMARK]"


def _masked(raw: bytes, words: textblocks.Words, begins: int, first: int, spans: list[int]) -> str:
    """A text (its bytes, where they begin in the block, and its first word's number there) with a mark in place of each span of words."""
    parts, done = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        parts += [raw[done : int(words.start[first + a]) - begins], MARK.encode()]
        done = int(words.end[first + b - 1]) - begins
    return b"".join([*parts, raw[done:]]).decode()


def _without(index, share: int | None, at: int):
    """Documents to those that stay, with passages masked; the text is column ``at``. Without an index a last column has the spans, and is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index and index.value
        sieves = index and _sieves(x)
        for batch in batches:
            texts = batch.column(at)
            buf, offsets = textblocks.raw(texts)
            columns = batch.columns if index else batch.columns[:-1]
            for i, j in textblocks.blocks(offsets):
                n = j - i
                spans: dict[int, list[int]] = {}
                if index or any(len(s) for s in batch.column(batch.num_columns - 1).slice(i, n) if s.is_valid):
                    words = textblocks.Words(buf, offsets[i : j + 1], textblocks.ALNUM)
                    if index:
                        text, first, length, _ = _occurrences(x, sieves, words)
                        for t in np.unique(text).tolist():
                            mine = text == t
                            spans[t] = _spans(first[mine] - words.first[t], length[mine], int(words.first[t + 1] - words.first[t]))
                    else:
                        spans = {t: s for t, s in enumerate(batch.column(batch.num_columns - 1).slice(i, n).to_pylist()) if s}
                stays, new = np.ones(n, bool), {}
                for t, found in spans.items():
                    hit, per = sum(found[1::2]) - sum(found[::2]), int(words.first[t + 1] - words.first[t])
                    stays[t] = share is not None and share * hit < per
                    if stays[t]:
                        begins = int(offsets[i + t] - offsets[i])
                        new[t] = _masked(words.buf[begins : int(offsets[i + t + 1] - offsets[i])].tobytes(), words, begins, int(words.first[t]), found)
                out = [c.slice(i, n) for c in columns]
                if new:
                    changed = pa.array([t in new for t in range(n)])
                    out[at] = pc.replace_with_mask(out[at], changed, pa.array([new[t] for t in sorted(new)], out[at].type))
                yield pa.RecordBatch.from_arrays(out, schema=batch.schema if index else pa.schema(list(batch.schema)[:-1])).filter(pa.array(stays))

    return run


def without_passages(docs: DataFrame, items: DataFrame, text: str = "text", share: int | None = 20, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``docs`` without those of which a ``share``-th part or more of the words lie in items; in the others a mark stands for such words.
    With ``share`` None, every document with a passage goes.

    Rows are judged by their text, whatever their ids. With one piece of items that is one pass without a shuffle."""
    at = docs.columns.index(text)
    string = docs.withColumn(text, F.col(text).cast("string"))
    indexes = list(_indexes(modest(docs).select(F.col(text).cast("string").alias("text")), items, item_id, item_text, window, piece))
    if len(indexes) == 1:
        return string.mapInArrow(_without(indexes[0], share, at), string.schema)
    key = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    # One row for each distinct text: the spans of a text are the same wherever it occurs.
    distinct = docs.select(F.col(text).cast("string").alias("text"), key.alias("key")).dropDuplicates(["key"]).withColumn("doc_id", F.col("key"))
    found = _contamination(distinct, indexes).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("__key"), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))).alias("__spans"))
    # The row stays together while it is joined, whatever its columns are called.
    joined = string.select(F.struct(*(F.col(c) for c in string.columns)).alias("row"), key.alias("__key")).join(found, "__key", "left")
    joined = joined.select(*(F.col("row").getField(c).alias(c) for c in string.columns), F.col("__spans").alias("__given"))
    return joined.mapInArrow(_without(None, share, at), string.schema)
