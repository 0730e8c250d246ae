"""Document quality from text statistics, by histogram gradient-boosted trees.

Statistics of whole texts (character classes, words, lines, repetition) are
computed for blocks of texts as arrays.  Trees are grown on binned statistics
with gradient and hessian histograms, then flattened into arrays (feature,
threshold, left, right, value) that all rows go down together, one level of
all trees a step.

The labelled rows that it learns from are at most ``SAMPLE`` (chosen by a hash
of the id, so reruns agree); every text is scored.

Defined cases: a null text is empty; a text without words has all statistics 0
and is scored like any other; several labels of one id count as their least, several texts likewise;
with no label, or labels of one sort, all scores are the share of label 1
among those learnt from (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm import textblocks
from kolumna.llm.work import chance, modest

#: Labelled documents that are learnt from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 80, 4, 64, 0.15, 1.0, 8

_b = np.arange(256)
_CLASSES = (
    (_b >= 97) & (_b <= 122),  # lower
    (_b >= 65) & (_b <= 90),  # upper
    (_b >= 48) & (_b <= 57),  # digits
    np.isin(_b, np.frombuffer(b".,;:!?'\"()-", np.uint8)),  # usual marks
    np.isin(_b, np.frombuffer(b"#$%&*+/<=>@[]\\^_`{|}~", np.uint8)),  # other marks
    _b == 10,
    (_b == 32) | (_b == 9),
    _b >= 128,
    np.isin(_b, np.frombuffer(b"!?", np.uint8)),
)
_WEIGHT = np.array(_CLASSES, np.int64)
NAMES = (
    "log_bytes", "lower", "upper", "digit", "mark", "odd_mark", "newline", "space", "high", "shout", "word_length", "word_length_spread", "distinct_words", "repeated_next", "distinct_pairs",
    "words_a_line", "distinct_lines", "top_word", "odd_words", "upper_words", "digit_words", "log_words",
)


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text of a block."""
    n = len(offsets) - 1
    words = textblocks.Words(buf, offsets)
    b = words.buf
    size = np.diff(offsets).astype(float)
    grid, at = np.zeros(n * 256, np.int64), offsets - offsets[0]
    for a in range(0, len(b), textblocks.STEP):
        owner = np.repeat(np.arange(n), np.diff(np.clip(at, a, a + textblocks.STEP)))
        grid += np.bincount(owner * 256 + b[a : a + textblocks.STEP], minlength=n * 256)
    grid = grid.reshape(n, 256)
    classes = grid @ _WEIGHT.T
    text = words.text_of
    count = np.diff(words.first).astype(float)
    length = (words.end - words.start).astype(float)
    mean = _share(np.bincount(text, length, minlength=n), count)
    spread = np.sqrt(np.maximum(_share(np.bincount(text, length**2, minlength=n), count) - mean**2, 0))
    _, g = textblocks.distinct(words.hash, text)
    distinct = np.bincount(g, minlength=n)
    same = np.zeros(len(text), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    pairs = textblocks.shingles(words.hash, 2)
    inside = text[: len(pairs)] == text[1 : len(pairs) + 1]
    _, pg = textblocks.distinct(pairs[inside], text[: len(pairs)][inside])
    order = np.lexsort((words.hash, text))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (text[order][1:] != text[order][:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(order)))
    top = np.zeros(n)
    np.maximum.at(top, text[order][first], runs)
    lines = textblocks.Words(b, offsets - offsets[0], _b != 10)
    _, lg = textblocks.distinct(lines.hash, lines.text_of)
    line_count = np.diff(lines.first).astype(float)
    if len(words.start):
        kinds = (_CLASSES[1] * 1 + _CLASSES[2] * 2 + _CLASSES[4] * 4 + _CLASSES[0] * 8 + (_b >= 128) * 8).astype(np.uint8)[b]
        kinds[~textblocks.NOT_SPACE[b]] = 0
        bits = np.bitwise_or.reduceat(kinds, words.start)
    else:
        bits = np.zeros(0, np.uint8)
    per_word = [_share(np.bincount(text, m, minlength=n), count) for m in ((bits & 4) > 0, ((bits & 1) > 0) & ((bits & 8) == 0), (bits & 2) > 0)]
    return np.column_stack([
        np.log1p(size), *(_share(classes[:, k], size) for k in range(9)), mean, spread, _share(distinct, count), _share(np.bincount(text[same], minlength=n), count), _share(np.bincount(pg, minlength=n), count - 1),
        _share(count, line_count), _share(np.bincount(lg, minlength=n), line_count), _share(top, count), *per_word, np.log1p(count),
    ])


class Trees:
    """Boosted trees, flattened: node arrays of all trees in one, and the root of each."""

    def __init__(self, base: float):
        self.base = base
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def _node(self, feature: int = 0, threshold: float = np.inf, value: float = 0.0) -> int:
        k = len(self.feature)
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (feature, threshold, k, k, value)):
            column.append(x)
        return k

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
        width = BINS
        raw = np.full(len(y), self.base)
        offset = np.arange(x.shape[1]) * width
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            root = self._node()
            self.roots.append(root)
            at = np.full(len(y), root)
            level = [root]
            for depth in range(DEPTH + 1):
                number = {k: i for i, k in enumerate(level)}
                place = np.array([number.get(k, -1) for k in range(len(self.feature))])[at]
                live = np.flatnonzero(place >= 0)
                cell = (place[live, None] * x.shape[1] * width + offset + binned[live]).ravel()
                shape = (len(level), x.shape[1], width)
                total = int(np.prod(shape))
                g, h, c = (np.bincount(cell, None if w is None else np.repeat(w[live], x.shape[1]), minlength=total).reshape(shape).cumsum(axis=2) for w in (grad, hess, None))
                gs, hs, cs = g[:, 0, -1], h[:, 0, -1], c[:, 0, -1]
                score = lambda a, b: a * a / (b + SHRINK)
                gain = score(g, h) + score(gs[:, None, None] - g, hs[:, None, None] - h) - score(gs, hs)[:, None, None]
                gain[(c < LEAST) | (cs[:, None, None] - c < LEAST)] = -np.inf
                nxt = []
                for i, k in enumerate(level):
                    f, t = np.unravel_index(int(gain[i].argmax()), gain[i].shape)
                    if depth == DEPTH or not gain[i, f, t] > 1e-6 or t >= len(edges[f]):
                        self.value[k] = -RATE * gs[i] / (hs[i] + SHRINK)
                        continue
                    self.feature[k], self.threshold[k] = int(f), float(edges[f][t])
                    self.left[k], self.right[k] = self._node(), self._node()
                    mine = at == k
                    at[mine] = np.where(binned[mine, f] <= t, self.left[k], self.right[k])
                    nxt += [self.left[k], self.right[k]]
                level = nxt
                if not level:
                    break
            raw = raw + np.array(self.value)[at]
        return self.flat()

    def flat(self) -> Trees:
        self.feature, self.left, self.right, self.roots = (np.array(v, np.int32) for v in (self.feature, self.left, self.right, self.roots))
        self.threshold, self.value = np.array(self.threshold, float), np.array(self.value, float)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row. A leaf leads to itself, so all rows take ``DEPTH`` steps."""
        raw = np.full(len(x), self.base)
        if len(self.roots):
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                rows = np.arange(len(part))[:, None]
                at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
                for _ in range(DEPTH):
                    at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                raw[a : a + 4096] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def _features(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textblocks.raw(textblocks.column(batch, "text"))
            for i, j in textblocks.blocks(offsets):
                x = statistics(buf, offsets[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([textblocks.column(batch, name).slice(i, j - i), lists], [name, "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn=None, sample: int = SAMPLE) -> Trees:
    """Trees from the labelled rows that ``learn`` (a condition on the id column; all by default) admits, ``sample`` at most."""
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    if learn is not None:
        chosen = chosen.where(learn)
    chosen = chosen.groupBy(F.col(doc_id).alias("id")).agg(F.min(F.col(label)).cast("int").alias("y"))
    chosen = chosen.where(chance(F.col("id"), sample, chosen.count())).limit(sample)
    # At most ``sample`` rows of an id and a label: a broadcast of known size.
    known = modest(docs).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")
    rows = known.mapInArrow(_features("y"), "y int, x array<double>").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Trees(float(np.log(p / (1 - p)))).flat()
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    by = np.lexsort((*x.T[::-1], y))  # the order in which rows arrive must not matter
    p = float(y.mean())
    return Trees(float(np.log(p / (1 - p)))).fit(x[by], y[by])


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textblocks.raw(batch.column(batch.num_columns - 1))
            scores = [model.value.score(statistics(buf, offsets[i : j + 1])) for i, j in textblocks.blocks(offsets)]
            found = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "__score"])

    return run


def scored(docs: DataFrame, model: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document and ``__score``, the probability of label 1."""
    from pyspark.sql.types import DoubleType, StructType

    found = modest(docs).select(*keep, F.col(text).cast("string").alias("__text"))
    schema = StructType([*found.schema.fields[:-1]]).add("__score", DoubleType())
    return found.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), schema)


def kept(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` without those whose score is under one half."""
    at, trees = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textblocks.raw(batch.column(at))
            for i, j in textblocks.blocks(offsets):
                good = trees.value.score(statistics(buf, offsets[i : j + 1])) >= 0.5
                yield batch.slice(i, j - i).filter(pa.array(good))

    return modest(docs).mapInArrow(run, docs.schema)
