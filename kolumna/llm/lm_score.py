"""Language-model scores of documents, with n-gram counts in a log-frequency Bloom filter.

Counts are learnt and looked up by blocks of documents (about ``BLOCK`` bytes of
text, dealt by a hash of the document).  A block sends each distinct token and
bigram once, as sorted hashes with their counts in training texts; they go to
shards, which divide the range of the hashes; a shard makes totals, and sends
each block its answers in the order in which the block asked.  So nothing that
grows with the vocabulary is broadcast, a token as common as "the" costs one
entry for each block, and there are as many shards as the input needs, each of
about two blocks' entries.

Unigram totals are exact.  All bigrams of training texts, however rare, are in
the filter, which has a part in each shard: a bigram of quantised count q is
stored as (bigram, 1) to (bigram, q), and reading it back probes 1, 2, ... until
the first miss.  The score of a word after another is

    (count of both + MU * unigram probability) / (count of the first + MU)

Defined cases: null text is empty and holds the end token alone; a null id is
held out; with nothing to learn from, each token has probability 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm import textblocks
from kolumna.llm.work import modest, release, saved

#: Bytes of text in a block, and blocks to a shard.
BLOCK, TOGETHER = 8 << 20, 2
#: Bits of the hashes of tokens and bigrams on their way.
TOKEN_BITS, PAIR_BITS = 64, 48
#: Steps of the quantised counts to a doubling, and weight of the unigram estimate.
STEPS, MU = 2, 50.0
#: Probes for one entry, and bits for each.
PROBES, BITS = 8, 12

_U = np.uint64
#: Hashes of the token that ends each text and of the place before its first word.
END, BEGIN = textblocks.mix(np.array([0xE0D, 0xB0], _U))


class LogFrequencyFilter:
    """Quantised counts of 64-bit keys in a Bloom filter; a count read back is never below the one stored, but for quantisation."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, unit: float):
        self.unit = unit
        level = self._level(counts)
        self.most = int(level.max()) if len(level) else 0
        entries = int(level.sum())
        self.bits = max(16, math.ceil(math.log2(max(1, entries) * BITS)))
        self.map = np.zeros(1 << (self.bits - 3), np.uint8)
        for q in range(1, self.most + 1):
            for at in self._probes(keys[level >= q], q):
                np.bitwise_or.at(self.map, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _level(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.floor(STEPS * np.log2(np.maximum(counts / self.unit, 1))).astype(np.int64)

    def _probes(self, keys: np.ndarray, q: int) -> Iterator[np.ndarray]:
        h = textblocks.mix(keys.view(_U) ^ textblocks.mix(np.array([q], _U)))
        step = textblocks.mix(h + _U(q)) | _U(1)
        for _ in range(PROBES):
            yield (h >> _U(64 - self.bits)).astype(np.int64)
            h = h + step

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of the keys, 0 for those that are not in the filter."""
        level = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for q in range(1, self.most + 1):
            held = np.ones(len(live), bool)
            for at in self._probes(keys[live], q):
                held &= ((self.map[at >> 3] >> (at & 7)) & 1).astype(bool)
            live = live[held]
            if not len(live):
                break
            level[live] = q
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys, 0 for those that are not in the filter."""
        return _middle(self.levels(keys), self.unit)


def _middle(level: np.ndarray, unit: float = 1) -> np.ndarray:
    return np.where(level > 0, unit * 2.0 ** ((level - 0.5) / STEPS), 0.0)


def _trained(batch) -> np.ndarray:
    return textblocks.column(batch, "train").to_numpy(zero_copy_only=False)


def _starts(shards: int, bits: int) -> np.ndarray:
    """The least hash of each shard."""
    return np.array([-(-(k << bits) // shards) for k in range(shards)], _U)


def _keys(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token (words and, last in each text, the end): its text, its hash, that of it and the one before, and whether it is the first."""
    buf, offsets = textblocks.raw(textblocks.column(docs, "text"))
    texts, tokens = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for i, j in textblocks.blocks(offsets):
        words = textblocks.Words(buf, offsets[i : j + 1])
        text = np.concatenate([words.text_of, np.arange(j - i)])
        by = np.argsort(text, kind="stable")
        texts.append(text[by] + i)
        tokens.append(np.concatenate([words.hash, np.full(j - i, END)])[by])
    text, token = np.concatenate(texts), np.concatenate(tokens)
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    before = np.concatenate([token[:1], token[:-1]])
    before[first] = BEGIN
    return text, token, textblocks.mix(textblocks.mix(before) * _U(0x9E3779B97F4A7C15) + token) >> _U(64 - PAIR_BITS), first


def _asked(shards: int):
    """A block's documents to its distinct tokens and bigrams, by shard, with their counts in training texts."""

    def run(docs: pa.Table) -> pa.Table:
        text, token, pair, _ = _keys(docs)
        train = _trained(docs)[text].astype(np.int64)
        cols: list[list[bytes]] = []
        for key, bits in ((token, TOKEN_BITS), (pair, PAIR_BITS)):
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, train, minlength=len(key)).astype(_U)
            starts = _starts(shards, bits)
            cut = [*np.searchsorted(key, starts).tolist(), len(key)]
            parts = list(zip(cut, cut[1:], starts))
            cols += [[textblocks.packed(np.diff(key[a:b], prepend=start)) for a, b, start in parts], [textblocks.packed(n[a:b]) for a, b, _ in parts]]
        at = [k for k in range(shards) if len(cols[0][k]) > 1 or len(cols[2][k]) > 1]
        block = textblocks.column(docs, "block")[0].as_py()
        return pa.Table.from_arrays([pa.array(at, pa.int64()), pa.array([block] * len(at), pa.int64()), *(pa.array([c[k] for k in at], pa.binary()) for c in cols)], names=["shard", "block", "tokens", "token_n", "pairs", "pair_n"])

    return run


def _answered(shards: int):
    """What blocks ask of a shard to each block's answers: totals of its tokens, levels of its bigrams; and, in one row, the shard's sums."""

    def totals(keys: list[bytes], counts: list[bytes], start: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        each = [np.cumsum(textblocks.unpacked(k)) + start for k in keys]
        key, at = np.unique(np.concatenate(each), return_inverse=True)
        n = np.bincount(at, np.concatenate([textblocks.unpacked(c) for c in counts]), minlength=len(key)).astype(np.int64)
        return key, n, at, np.cumsum([0, *map(len, each)]).tolist()

    def run(asked: pa.Table) -> pa.Table:
        shard = textblocks.column(asked, "shard")[0].as_py()
        tokens, token_n, pairs, pair_n = (textblocks.column(asked, c).to_pylist() for c in ("tokens", "token_n", "pairs", "pair_n"))
        _, n, at, cut = totals(tokens, token_n, _starts(shards, TOKEN_BITS)[shard])
        answers = [textblocks.packed(n[at[a:b]].astype(_U)) for a, b in zip(cut, cut[1:])]
        key, m, at, cut = totals(pairs, pair_n, _starts(shards, PAIR_BITS)[shard])
        filter_ = LogFrequencyFilter(key[m > 0], m[m > 0], 1)
        level = filter_.levels(key)
        levels = [textblocks.packed(level[at[a:b]].astype(_U)) for a, b in zip(cut, cut[1:])]
        rest = [0] * (len(answers) - 1)
        return pa.Table.from_arrays(
            [textblocks.column(asked, "block"), textblocks.column(asked, "shard"), pa.array(answers, pa.binary()), pa.array(levels, pa.binary()), pa.array([int(n.sum()), *rest], pa.int64()), pa.array([int((n > 0).sum()), *rest], pa.int64())],
            names=["block", "shard", "token_n", "levels", "total", "seen"],
        )

    return run


def _score(total: int, distinct: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        text, token, pair, begins = _keys(docs)
        by = np.argsort(textblocks.column(answers, "shard").to_numpy())
        token_n, levels = ([c[k] for k in by] for c in (textblocks.column(answers, x).to_pylist() for x in ("token_n", "levels")))
        distinct_tokens, at = np.unique(token, return_inverse=True)
        n = np.concatenate([np.zeros(0, _U), *map(textblocks.unpacked, token_n)]).astype(np.int64)
        c = n[at]
        unigram = (c + 0.1) / (total + 0.1 * (distinct + 1))
        # A word of training texts is followed by one as often as it occurs; their beginnings are as many as their ends.
        first = np.concatenate([c[:1], c[:-1]])
        first[begins] = n[np.searchsorted(distinct_tokens, END)] if len(n) else 0
        _, at = np.unique(pair, return_inverse=True)
        both = _middle(np.concatenate([np.zeros(0, _U), *map(textblocks.unpacked, levels)]).astype(np.int64))[at]
        probability = (both + MU * unigram) / (np.maximum(first, both) + MU)
        rows = len(docs)
        return pa.Table.from_arrays(
            [
                textblocks.column(docs, "doc_id"), pa.array(~_trained(docs)) if rows else pa.array([], pa.bool_()), pa.array(np.bincount(text, minlength=rows), pa.int64()), pa.array(np.bincount(text, c > 0, minlength=rows).astype(np.int64)),
                pa.array(np.full(rows, total), pa.int64()), pa.array(np.bincount(text, np.log10(unigram), minlength=rows)), pa.array(np.bincount(text, np.log10(probability), minlength=rows)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the documents of which crc32(id as text) mod ``folds`` is not 0."""
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(whole).cast("long"))).first()[0] or 0
    n = max(1, math.ceil(size / block))
    train = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds != 0, F.lit(False))
    rows = modest(docs).select(F.col(doc_id).alias("doc_id"), whole.alias("text"), train.alias("train")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("long"))

    # All sides are dealt to as many partitions as there are blocks or shards, so a task's share does not grow with the input.
    shards = max(1, math.ceil(n / TOGETHER))
    asked = rows.select("block", "text", "train").repartition(n, "block").groupBy("block").applyInArrow(_asked(shards), "shard bigint, block bigint, tokens binary, token_n binary, pairs binary, pair_n binary")
    answers = saved(asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_answered(shards), "block bigint, shard bigint, token_n binary, levels binary, total bigint, seen bigint"), "answers")
    total, distinct = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    release(docs.sparkSession)

    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.repartition(n, "block").groupBy("block").cogroup(answers.select("block", "shard", "token_n", "levels").repartition(n, "block").groupBy("block")).applyInArrow(_score(total, distinct), out)
