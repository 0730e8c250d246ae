"""Removal of long repeated strings, exact to the byte.

A byte goes if some ``length``-byte string over it also starts anywhere else.
Suffix sorting needs strings that may match in one place, so windows of
``length`` bytes are dealt by content: a window's key is the least hash of its
32-byte grams, equal windows have equal keys, and neighbouring windows mostly
share theirs, so a text becomes runs of windows (about 285 bytes each) under
one key.  Only keys of two or more runs can hold repeats; their runs are
shuffled by key and searched by interval expansion on a Burrows-Wheeler
transform (:mod:`kolumna.llm.bwt`) in small blocks.

Equal texts are one class and equal runs one string with a multiplicity, so
a group of copies costs one of it; texts and runs are told apart by digests of
128 bits.  A run is cut after ``PIECE`` windows, so that a text of one repeated
phrase is many runs, most of them equal.  A key whose runs hold more than
``HOT`` times 300 bytes is split by content over several blocks: within a block
the transform finds the repeats, and the distinct windows of all its blocks are
compared once more by digest.  All other repeats come from the transform.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing;
a text that occurs twice (repeated rows included) loses everything if it has
``length`` bytes; matches never cross texts.  Ids play no part, so null or
repeated ids change nothing.  Columns beside the text are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm import bwt, textblocks
from kolumna.llm.work import modest, release, saved, width

LENGTH = 200
GRAM = 32
#: Bytes of distinct runs that one transform is built over (a key's runs stay together): what caches hold.
BLOCK = 300_000
#: Runs of one key (as so many times ``RUN`` bytes) beyond which it is split by content: 0.9 MB, which bounds a block.
HOT, RUN = 3_000, 300
#: Windows of a run, at most, and bytes of a text that are looked at together.
PIECE, SEGMENT = 4_096, 1 << 20
#: Bytes of distinct runs that a task gathers before it sends them on.
HELD = 16 << 20

_U = np.uint64


def _grams(buf: np.ndarray) -> np.ndarray:
    h = textblocks.BYTE_VALUES[buf]
    step = 1
    while step < GRAM:
        h = h[:-step] * _U(0x9E3779B97F4A7C15 + 2 * step * 7919) + h[step:]
        step *= 2
    return textblocks.mix(h)


def _sliding(h: np.ndarray, size: int, pick) -> np.ndarray:
    done = 1
    while 2 * done <= size:
        h = pick(h[:-done], h[done:])
        done *= 2
    return pick(h[: len(h) - (size - done)], h[size - done :]) if done < size else h


def runs(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows under one key, of all texts of a block: text, start in the text, windows, key, whether the key's gram repeats in the run."""
    base = offsets[0]
    buf, offsets = buf[base : offsets[-1]], offsets - base
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(bool)
    offsets = offsets.astype(np.int64)
    inner = length - GRAM + 1
    grams = _grams(buf)
    keys = _sliding(grams, inner, np.minimum)
    step = np.zeros(len(buf) + 1, np.int8)
    long = np.diff(offsets) >= length
    step[offsets[:-1][long]] += 1
    np.add.at(step, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(step[:-1], dtype=np.int8)[: len(keys)] > 0
    begins = valid.copy()
    begins[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1]
    begins[offsets[:-1][long]] = True
    start = np.flatnonzero(begins)
    if not len(start):
        return none, none, none, none, none.astype(bool)
    text = np.searchsorted(offsets, start, "right") - 1
    end = np.append(start[1:], 0)
    last = np.append(text[1:] != text[:-1], True)
    end[last] = offsets[text[last] + 1] - length + 1
    key = keys[start]
    # Places of a least gram: those that equal the greatest key of the windows over them.
    padded = np.zeros(len(grams) + inner - 1, _U)
    padded[inner - 1 : inner - 1 + len(keys)] = np.where(valid, keys, _U(0))
    least = np.flatnonzero(grams == _sliding(padded, inner, np.maximum))
    lo, hi = np.searchsorted(least, start), np.searchsorted(least, end - 1 + inner)
    count = hi - lo
    at = np.repeat(np.arange(len(start)), count)
    place = least[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + lo[at]]
    again = np.bincount(at[grams[place] == key[at]], minlength=len(start)) > 1
    # A long run is several, which share its key.
    size = end - start
    pieces = -(-size // PIECE)
    k = np.repeat(np.arange(len(start)), pieces)
    past = (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    return text[k], start[k] + past - offsets[text[k]], np.minimum(size[k] - past, PIECE), key.view(np.int64)[k], again[k]


def _segments(buf: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """Blocks of texts [i, j) and their runs; a text longer than ``SEGMENT`` is looked at in parts that overlap by all but one byte of a window."""
    for i, j in textblocks.blocks(offsets):
        if j - i > 1 or offsets[j] - offsets[i] <= 2 * SEGMENT:
            yield i, j, runs(buf, offsets[i : j + 1], length)
            continue
        parts = []
        for a in range(int(offsets[i]), int(offsets[j]) - length + 1, SEGMENT):
            text, start, *rest = runs(buf, np.array([a, min(a + SEGMENT + length - 1, int(offsets[j]))]), length)
            parts.append((text, start + a - int(offsets[i]), *rest))
        yield i, j, tuple(np.concatenate(c) for c in zip(*parts))


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textblocks.raw(textblocks.column(batch, "text"))
            ids = textblocks.column(batch, "text_key")
            for i, j, (text, start, size, key, again) in _segments(buf, offsets, length):
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), _lists(key, text, n, pa.int64()), _lists(start, text, n, pa.int32()), _lists(size, text, n, pa.int32()), _lists(again, text, n, pa.bool_())],
                    ["text_key", "key", "start", "size", "again"],
                )

    return run


def _run_rows(length: int, whole: bool):
    """Candidate texts to their runs: distinct ones with their strings (whole), or each place of one in a text that has no copy."""

    def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, int, int, int, bytes, bytes]]:
        for row in batch.to_pylist():
            if whole or row["copies"] == 1:
                text = row["text"]
                for key, start, size, among in (r.values() for r in row["runs"]):
                    string = text[start : start + size - 1 + length]
                    yield row, key, start, among, string, hashlib.md5(key.to_bytes(8, "little", signed=True) + string).digest()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            cols = list(zip(*found.values())) or [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())],
                ["run_id", "key", "among", "string", "times"],
            )

        found: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for row, key, _, among, string, run_id in runs_of(batch):
                known = found.get(run_id)
                if known is None:
                    found[run_id] = [key, among, string, 1 if row["copies"] == 1 else 2]
                    held += len(string)
                else:
                    known[3] += 1
            if held > HELD:
                yield flush()
                found, held = {}, 0
        yield flush()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*((row["text_key"], start, run_id) for row, _, start, _, _, run_id in runs_of(batch)))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["text_key", "start", "run_id"])

    return strings if whole else places


def _search(length: int, block: int):
    """Sorted runs to marks: windows [first, past) of a run that occur elsewhere; of split keys also one row with a digest for each distinct window."""

    def solve(held: list[tuple[bytes, bytes, int, bool]], out: list[list]) -> None:
        strings = [x[1] for x in held]
        offsets, shared, classes = bwt.repeats(strings, length)
        for k, (run_id, string, times, split) in enumerate(held):
            n = len(string) - length + 1
            a = offsets[k]
            mark = np.ones(n, bool) if times > 1 else shared[a : a + n]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False]))))
            for first, past in edge.reshape(-1, 2).tolist():
                out.append([run_id, first, past, None])
        hot = [k for k, x in enumerate(held) if x[3]]
        if hot:
            place = np.concatenate([np.arange(offsets[k], offsets[k] + len(strings[k]) - length + 1) for k in hot])
            owner = np.concatenate([np.full(len(strings[k]) - length + 1, k) for k in hot])
            _, rep = np.unique(classes[place], return_index=True)
            for p, k in zip(place[rep].tolist(), owner[rep].tolist()):
                w = p - int(offsets[k])
                out.append([held[k][0], w, w + 1, hashlib.md5(strings[k][w : w + length]).digest()])

    def flush(out: list[list]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["run_id", "first", "past", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int, bool]] = []
        group: dict[bytes, list] = {}
        at, bytes_held, out = None, 0, []

        def close() -> int:
            """Put a key's distinct runs to those of the block; one run that makes up its key repeats as a whole, whatever the block holds."""
            rows = [(i, s, t, h) for i, (s, t, h) in group.items()]
            if len(rows) == 1 and rows[0][2] > 1 and not rows[0][3]:
                out.append([rows[0][0], 0, len(rows[0][1]) - length + 1, None])
                return 0
            held.extend(rows)
            return sum(len(x[1]) for x in rows)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["key"], row["part"]) != at:
                    bytes_held += close()
                    group, at = {}, (row["key"], row["part"])
                    if bytes_held >= block:
                        solve(held, out)
                        held, bytes_held = [], 0
                        yield flush(out)
                known = group.get(row["run_id"])
                if known:
                    known[1] += row["times"]
                else:
                    group[row["run_id"]] = [row["string"], row["times"], row["split"]]
        close()
        if held:
            solve(held, out)
        yield flush(out)

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def text_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_hash, text_key, n_bytes, text) for each row: the text's SHA-256 and its first half, which stands for the text below."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = modest(docs).select(whole.alias("text"))
    return found.select(F.sha2("text", 256).alias("text_hash"), F.octet_length("text").cast("long").alias("n_bytes"), "text").withColumn("text_key", F.substring(F.unhex("text_hash"), 1, 16))


def repeated(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``docs`` repeat: (text_key, copies) of each distinct text with ``length`` bytes, and (text_key, text, spans) of
    those that occur once and lose bytes; spans are the maximal removed runs, in order.  Texts with copies lose all."""
    spark = docs.sparkSession
    n = width(spark)
    texts = text_classes(docs, text).where(F.col("n_bytes") >= length)
    kinds = "array<{}>"
    found = texts.select("text_key", "text").mapInArrow(_find_runs(length), f"text_key binary, key {kinds.format('bigint')}, start {kinds.format('int')}, size {kinds.format('int')}, again {kinds.format('boolean')}")
    signs = saved(found.groupBy("text_key").agg(F.count("*").alias("copies"), F.first(F.struct("key", "start", "size", "again")).alias("r")).select("text_key", "copies", "r.*"), "runs")
    single = signs.select("text_key", "copies", F.explode(F.arrays_zip("key", "start", "size", "again")).alias("r")).select("text_key", "copies", "r.*")
    held = F.sum((F.col("size") + length - 1).cast("long"))
    keys = single.groupBy("key").agg(F.count("*").alias("runs"), F.ceil(held / RUN).alias("among"), F.max("again").alias("again")).where("runs > 1 or again").select("key", "among")
    wanted = single.select("text_key", "copies", "key", "start", "size").join(keys, "key").groupBy("text_key", "copies").agg(F.collect_list(F.struct("key", "start", "size", "among")).alias("runs"))
    one = texts.select("text_key", F.encode("text", "UTF-8").alias("text")).groupBy("text_key").agg(F.first("text").alias("text"))
    candidates = saved(one.join(wanted, "text_key"), "candidates")

    parts = F.when(F.col("among") > hot, F.pmod(F.xxhash64("run_id"), F.ceil(F.col("among") / hot))).otherwise(F.lit(0)).cast("int")
    strings = candidates.mapInArrow(_run_rows(length, True), "run_id binary, key bigint, among bigint, string binary, times bigint")
    dealt = strings.select("run_id", "key", parts.alias("part"), "string", "times", (F.col("among") > hot).alias("split")).repartition(n, "key", "part").sortWithinPartitions("key", "part")
    marks = saved(dealt.mapInArrow(_search(length, block), "run_id binary, first int, past int, digest binary"), "marks")
    windows = marks.where("digest is not null")
    twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    sure = marks.where("digest is null").select("run_id", "first", "past").unionByName(windows.join(twice, "digest", "left_semi").select("run_id", "first", "past"))
    places = candidates.mapInArrow(_run_rows(length, False), "text_key binary, start int, run_id binary")
    spans = places.join(sure, "run_id").select("text_key", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("past") - 1 + length).alias("end")).alias("span"))
    gathered = spans.groupBy("text_key").agg(F.collect_set("span").alias("spans"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[{"start": a, "end": b} for a, b in _merge([(s["start"], s["end"]) for s in row])] for row in textblocks.column(batch, "spans").to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([textblocks.column(batch, "text_key"), textblocks.column(batch, "text"), pa.array(lists, kind)], ["text_key", "text", "spans"])

    lost = candidates.where("copies = 1").select("text_key", "text").join(gathered, "text_key").mapInArrow(merged, "text_key binary, text binary, spans array<struct<start:int,end:int>>")
    release(spark)
    return signs.select("text_key", "copies"), lost


def _cut(text: bytes, spans: list[dict]) -> bytes:
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, text[at:]])


def remaining(lost: DataFrame) -> DataFrame:
    """(text_key, n_removed, n_spans, kept, kept_sha256) for each row of ``lost`` (see :func:`repeated`); kept is binary, since a cut may split a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            kept = [_cut(r["text"], r["spans"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    textblocks.column(batch, "text_key"), pa.array([len(r["text"]) - len(k) for r, k in zip(rows, kept)], pa.int64()), pa.array([len(r["spans"]) for r in rows], pa.int64()),
                    pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                ["text_key", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return lost.mapInArrow(run, "text_key binary, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    copies, lost = repeated(docs, text, length, hot, block)
    cut = remaining(lost).select("text_key", "n_removed", "n_spans", "kept_sha256").withColumn("copies", F.lit(1).cast("long"))
    # A text with copies says so by itself: one row for each class of copies, whose documents lose all.
    gone = copies.where("copies > 1").select("text_key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA256).alias("kept_sha256"), "copies")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("doc_id", F.sha2("text", 256).alias("text_hash"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = rows.withColumn("text_key", F.substring(F.unhex("text_hash"), 1, 16))
    known = rows.join(cut.unionByName(gone), "text_key", "left")
    return known.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copies") > 1, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "text_hash").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``docs`` with a binary column ``kept`` (one of that name is replaced): the text's bytes that stay."""
    copies, lost = repeated(docs, text, length, hot, block)
    left = remaining(lost).select(F.col("text_key").alias("__key"), F.col("kept").alias("__kept"))
    left = left.unionByName(copies.where("copies > 1").select(F.col("text_key").alias("__key"), F.lit(b"").alias("__kept")))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.drop("kept").withColumn("__key", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16))
    return rows.join(left, "__key", "left").withColumn("kept", F.coalesce("__kept", F.encode(whole, "UTF-8"))).drop("__key", "__kept")
