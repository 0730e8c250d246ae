"""Near-duplicate groups by MinHash, with odd sketches before the exact check.

Each text's distinct word shingles give ``BANDS * ROWS`` MinHash samples.  The
samples, cut in bands, find candidate pairs; the same samples, folded into a
parity bitmap (an odd sketch), weigh them: the exclusive-or of two sketches
holds the samples that differ, its population count gives the similarity with
little variance where it is high, and pairs that are clearly below the
threshold go.  What is left is confirmed on the full shingle sets.

Equal sets are one class, so copies cost nothing.  In a band's bucket only
the least class is compared with the others at first; that joins nearly every
group at linear cost.  Then only pairs in different components that share a
bucket are compared, in blocks of bounded size and by odd sketches of the
whole sets as well: those never differ in more bits than the sets do in
shingles, so that they part families just below the threshold without loss.  After both steps every pair
of a bucket is either in one component or was compared, so no link between
candidates is lost.  A bucket of n classes that stay apart costs n^2 / 2 bit
comparisons and n^2 / ``BLOCK`` rows.  A pair at similarity 0.8 shares no
bucket with probability (1 - 0.8^5)^40 = 1.2e-7, and its sketches put it below
``SKETCH_FLOOR``, five deviations off, with about 3e-7; both are less above.

Defined cases: a null or empty text, or one without words, has no shingles
and links with nothing; fewer words than a shingle make one shingle; rows that
share an id are one document; a null id gives a null component and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm import textblocks
from kolumna.llm.components import components
from kolumna.llm.work import forget, modest, saved, width

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Pairs whose sketches put them below this go without the exact check; at 0.8 that is five deviations away.
SKETCH_FLOOR = 0.6
#: Bits of a set's own parity bitmap for each of its shingles, at least.
PARITY = 4
#: Bits of such a bitmap, at most: beyond, sets of about 300,000 shingles, it parts fewer pairs, and more are confirmed in full.
MOST_BITS = 1 << 17
#: Pairs with one and the same least class that are confirmed together; more are several chunks, each with a copy of its text.
SPOKES = 64
#: Classes of a bucket that are compared at once.
BLOCK = 2048

_U = np.uint64
_rng = np.random.default_rng(0x0DD5)
_A = (_rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[None, :]
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[None, :]
_SAMPLE = np.arange(SAMPLES, dtype=_U) << _U(32)
_BAND = textblocks.mix(np.arange(1, BANDS + 1, dtype=_U))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block (sorted), and n + 1 offsets of the texts."""
    words = textblocks.Words(buf, offsets)
    n = len(offsets) - 1
    per = np.diff(words.first)
    text = words.text_of
    all_ = textblocks.shingles(words.hash, size)
    inside = text[: len(all_)] == text[len(words.hash) - len(all_) :] if len(all_) else np.zeros(0, bool)
    hashes, owner = all_[inside], text[: len(all_)][inside]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        whole = np.array([textblocks.shingles(words.hash[words.first[i] : words.first[i + 1]], int(per[i]))[0] for i in short], _U)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
        by = np.argsort(owner, kind="stable")
        hashes, owner = hashes[by], owner[by]
    hashes, owner = textblocks.distinct(hashes, owner)
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of one set."""
    low = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    x = (hashes >> _U(32)).astype(np.uint32)[:, None]
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048] * _A + _B).min(axis=0), out=low)
    return low


def bands_and_sketch(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = low.astype(_U).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for r in range(ROWS):
        key = textblocks.mix(key ^ rows[:, r])
    bit = (textblocks.mix(low.astype(_U) | _SAMPLE) >> _U(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return key.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity(hashes: np.ndarray) -> bytes:
    """Odd sketch of a whole set: a power of two of bits. Two of them differ in as many bits as the sets differ in shingles, or fewer."""
    bits = min(MOST_BITS, max(64, 1 << (PARITY * len(hashes) - 1).bit_length()))
    at = (hashes & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of a power of two of 64-bit words, folded to ``words``."""
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def most_differing_bits(similarity: float) -> int:
    """Bits in which two sketches differ at this similarity, on average."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textblocks.raw(textblocks.column(batch, "text"))
            ids = textblocks.column(batch, "doc_id")
            for i, j in textblocks.blocks(offsets):
                hashes, first = shingle_sets(buf, offsets[i : j + 1], size)
                n = j - i
                count = np.diff(first)
                both = np.zeros((n, 2), np.int64)
                bands, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, SKETCH_BITS // 64), np.int64)
                bitmaps = [b""] * n
                other = textblocks.mix(hashes + _U(1))
                for k in np.flatnonzero(count):
                    a, b = first[k], first[k + 1]
                    both[k] = hashes[a:b].sum(dtype=_U).view(np.int64), other[a:b].sum(dtype=_U).view(np.int64)
                    bands[k], sketch[k] = bands_and_sketch(samples(hashes[a:b]))
                    bitmaps[k] = parity(hashes[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (bands, sketch)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(count, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), *lists, pa.array(bitmaps, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch", "parity"])

    return run


def _confirm(size: int, percent: int):
    """Rows (a, chunk, side, b, text), sorted by the first three, to the links: of side 0 the texts of a, of side 1 those of each b that it may be linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            buf, offsets = textblocks.raw(textblocks.column(batch, "text"))
            a, chunk, side, b = (textblocks.column(batch, c).to_pylist() for c in ("a", "chunk", "side", "b"))
            found = []
            for i, j in textblocks.blocks(offsets):
                hashes, first = shingle_sets(buf, offsets[i : j + 1], size)
                for k in range(i, j):
                    mine = hashes[first[k - i] : first[k - i + 1]]
                    if (a[k], chunk[k]) != at:
                        at, held = (a[k], chunk[k]), []
                    if side[k] == 0:
                        held.append(mine.copy())
                    elif any(_similar(x, mine, percent) for x in held):
                        found.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the intersection of two sorted sets is that share of their union, or more."""
    if len(x) < len(y):
        x, y = y, x
    if not len(y) or 100 * len(y) < percent * len(x):
        return False
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _within(most: int, percent: int):
    """Sorted members of buckets (bucket, i, j, block, rep, component, n_shingles, sketch, parity, least) to the pairs in
    different components that may be links: sketches near enough, then bitmaps of the whole sets, which no link fails."""

    class Side:
        def __init__(self, rows: list[dict]):
            self.rep, self.component, self.n, self.least = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "component", "n_shingles", "least"))
            self.sketch = np.array([r["sketch"] for r in rows], np.int64).view(_U)
            self.words = np.array([len(r["parity"]) // 8 for r in rows])
            self.place = np.zeros(len(rows), np.int64)
            self.maps = {}
            for w in np.unique(self.words).tolist():
                at = np.flatnonzero(self.words == w)
                self.place[at] = np.arange(len(at))
                self.maps[w] = np.array([np.frombuffer(rows[k]["parity"], _U) for k in at])

    def solve(rows: list[dict]) -> list[tuple]:
        left = [r for r in rows if r["block"] == r["i"]]
        right = left if rows[0]["i"] == rows[0]["j"] else [r for r in rows if r["block"] == r["j"]]
        if not left or not right:
            return []
        a = Side(left)
        b = a if right is left else Side(right)
        out = []
        for k in range(len(a.rep)):
            near = (b.component != a.component[k]) & (100 * np.minimum(b.n, a.n[k]) >= percent * np.maximum(b.n, a.n[k]))
            near &= (b.rep != b.least) & (a.rep[k] != a.least[k])
            if a is b:
                near[: k + 1] = False
            at = np.flatnonzero(near)
            if len(at):
                at = at[np.bitwise_count(b.sketch[at] ^ a.sketch[k]).sum(axis=1) <= most]
            for w in np.unique(b.words[at]).tolist():
                part = at[b.words[at] == w]
                least = min(w, int(a.words[k]))
                differ = np.bitwise_count(_fold(b.maps[w][b.place[part]], least) ^ _fold(a.maps[int(a.words[k])][a.place[k]], least)).sum(axis=1)
                # |A ^ B| of a link is (1 - s) / (1 + s) of the sizes' sum, or less.
                for p in part[(100 + percent) * differ.astype(np.int64) <= (100 - percent) * (b.n[part] + a.n[k])].tolist():
                    x, y = int(a.rep[k]), int(b.rep[p])
                    out.append((min(x, y), max(x, y)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                key = (row["bucket"], row["i"], row["j"])
                if key != at:
                    if len(rows) > 1:
                        found += solve(rows)
                    at, rows = key, []
                rows.append(row)
            found = list(dict.fromkeys(found))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
        found = list(dict.fromkeys(solve(rows))) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id (a whole number), n_shingles, component_id (the least id it is linked with, over any number of links) and kept."""
    most = most_differing_bits(SKETCH_FLOOR)
    rows = modest(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signs = saved(rows.mapInArrow(_sign(shingle), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>, parity binary"), "signs")
    filled = signs.where("n_shingles > 0 and doc_id is not null")
    classes = saved(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n_shingles", "bands", "sketch", "parity")).alias("s")).select("set_a", "set_b", "rep", "s.*"), "classes")
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    weights = classes.select("rep", "n_shingles", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and sketches leave; where ids are shared some come twice.

        Nothing is grouped behind the joins, so that a hub's pairs can be read by several tasks."""
        left, right = (weights.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
        differ = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
        return pairs.join(right, "b").join(left, "a").where((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (differ <= most)).select("a", "b")

    def links(pairs: DataFrame, also: DataFrame | None = None) -> DataFrame:
        """The pairs that are links, and ``also``, written."""
        # Texts of documents in pairs; a hub's text goes to each chunk of its pairs, not to each pair, and no key holds all of them.
        needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        texts = saved(rows.where("doc_id is not null").join(needed, "doc_id", "left_semi"), "texts")
        chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("chunks"))
        hubs = chunks.where("chunks > 1").select(F.col("a").alias("hub"), F.col("chunks").alias("parts"))
        chunk = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int")
        spokes = pairs.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", chunk.alias("chunk")).join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
        centres = texts.select(F.col("doc_id").alias("a"), "text").join(chunks, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "text")
        both = centres.unionByName(spokes.select("a", "chunk", F.lit(1).alias("side"), "b", "text"))
        found = both.repartition(width(docs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(_confirm(shingle, percent), "a bigint, b bigint")
        found = saved((found if also is None else found.unionByName(also)).distinct(), "links")
        forget(texts)
        return found

    buckets = members.groupBy("bucket").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    spokes = members.join(buckets, "bucket").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    again = filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = filled.join(again, "doc_id", "left_semi").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("rep <> doc_id").select(F.least("rep", "doc_id").alias("a"), F.greatest("rep", "doc_id").alias("b"))
    candidates = saved(near(spokes), "pairs")
    first = links(candidates, same)
    forget(candidates)
    joined = saved(components(first), "components")

    # What a bucket holds in several components, beside the pairs with its least class, which were compared.
    placed = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n"), F.min("rep").alias("least")).where("c <> d and n > 2")
    split = F.ceil(F.col("n") / block).cast("int")
    loose = placed.join(mixed.select("bucket", split.alias("blocks"), "least"), "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = loose.select("bucket", "block", "rep", "component", "least", F.explode(sides).alias("s")).select("bucket", "s.i", "s.j", "block", "rep", "component", "least").join(classes.select("rep", "n_shingles", "sketch", "parity"), "rep")
    compared = dealt.repartition(width(docs.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_within(most, percent), "a bigint, b bigint").distinct()
    second = saved(compared, "pairs")
    if second.isEmpty():
        final = joined
    else:
        more = links(second)
        if more.isEmpty():
            final = joined
        else:
            final = saved(components(first.unionByName(more)), "components")
            forget(joined)
        forget(more)
    forget(first, second)

    named = classes.select("set_a", "set_b", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = signs.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one of the least id; rows without an id stay. Of rows that share an id one stays."""
    found = saved(near_duplicates(docs, doc_id, text, shingle, percent).where("doc_id is not null"), "groups")
    gone = found.where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    left = docs.join(gone, doc_id, "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return left
    again = again.select(F.col("doc_id").alias(doc_id))
    return left.join(again, doc_id, "left_anti").unionByName(left.join(again, doc_id, "left_semi").dropDuplicates([doc_id])).select(*docs.columns)
