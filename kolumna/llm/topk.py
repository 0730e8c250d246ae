"""Exact top-k by inner product, with cover trees over queries and data searched together.

Rows are dealt to cells by their nearest pivot; pivots are centres of a bounded
sample, at most ``PIVOTS`` of them, and a cell is its pivot, the greatest
distance from it and the greatest norm in it.  A cell's rows are cut into
blocks of bounded size, so a cell may hold any share of the rows.

Each query is searched for in one block of its own cell first, which gives it a
k-th score to beat.  Cells whose bound is below that are left out; the query
meets the blocks of the others, and the k best over all are merged.

In a pair of blocks a cover tree is built over the data and one over the
queries.  For a node of queries (centre q, radius a, greatest norm Q) and a node
of data (centre r, radius b, greatest norm R) no product is above

    q.r + a|r| + |q|b + ab    and    (Q^2 + R^2 - max(0, |q - r| - a - b)^2) / 2;

a pair of nodes whose bound is below the worst k-th score of all queries in the
node is pruned.  Equal bounds are not, since a tie may go to a smaller id.
Vectors without any structure have no bounds that prune: then every query meets
every block, which is the task.

Components are floor(256 x), whole numbers, so products are exact in double
up to 2^53; blocks whose values could pass that use Python integers.

Defined cases: a vector that is null or holds null, NaN or an infinity takes
no part, nor does a null id, nor a vector of which 256 x is beyond a double;
vectors of different lengths are filled with zeros; scores beyond the range of
long are held at its ends; rows that share a query's id are its own and no
candidates, and each of them is a query itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kolumna.llm.work import chance, forget, modest, saved

K = 5
#: Vectors and queries of a block.
DATA, QUERIES = 8192, 2048
#: Vectors of a leaf.
LEAF = 96
#: Rows to a pivot, pivots at most, sampled rows to a pivot, and bytes of pivots and of their sample, at most.
CELL, PIVOTS, SAMPLE = 4096, 1024, 8
PIVOT_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20


class CoverTree:
    """Nodes over rows of ``x``: centre (a row), covering radius, greatest norm, and either children or, in a leaf, rows.

    The children of a node are more than half its scale apart and cover its rows within that;
    scales on which a node would have itself as its only child are left out."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.most: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.rows: list[np.ndarray] = []
        rows = np.arange(len(x))
        self._add(0, rows, self._far(0, rows))

    def _far(self, p: int, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.x[p]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _add(self, p: int, rows: np.ndarray, far: np.ndarray) -> int:
        todo = [(p, rows, far, -1, 0)]
        while todo:
            p, rows, far, parent, slot = todo.pop()
            node = len(self.centre)
            self.centre.append(p)
            self.radius.append(float(far.max()) if len(far) else 0.0)
            self.most.append(float(self.norm[rows].max()) if len(rows) else 0.0)
            self.children.append(None)
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent][slot] = node
            if len(rows) <= LEAF or self.radius[node] == 0:
                continue
            scale = self.radius[node] / 2
            near, owner = far.copy(), np.zeros(len(rows), np.int64)
            centres = [p]
            while True:
                k = int(near.argmax())
                if near[k] <= scale or len(centres) > math.isqrt(len(rows)) + 8:
                    break  # covered, or so spread that the rest goes to the nearest centre as it is
                d = self._far(int(rows[k]), rows)
                closer = d < near
                near[closer], owner[closer] = d[closer], len(centres)
                centres.append(int(rows[k]))
            self.children[node] = np.zeros(len(centres), np.int64)
            for c, q in enumerate(centres):
                mine = owner == c
                todo.append((q, rows[mine], near[mine], node, c))
        return 0


def _bounds(products: np.ndarray, q_norm: np.ndarray, q_radius: np.ndarray, q_most: np.ndarray, x_norm: np.ndarray, x_radius: np.ndarray, x_most: np.ndarray) -> np.ndarray:
    """No product of a vector of a ball of queries (rows) and one of a ball of data (columns) is above this."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, q, big = q_radius[:, None], q_norm[:, None], q_most[:, None]
        top = products + a * x_norm + q * x_radius + a * x_radius
        apart = np.sqrt(np.maximum(q**2 + x_norm**2 - 2 * products, 0)) * (1 - 1e-9) - 1e-3
        top = np.minimum(top, (big**2 + x_most**2 - np.maximum(apart - a - x_radius, 0) ** 2) / 2)
        top += 1e-9 * (q + a) * (x_norm + x_radius) + 1e-6
    top[np.isnan(top)] = np.inf
    return top


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int = K, beat: np.ndarray | None = None, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query over the rows of x with another id, and which of these places are filled.

    ``beat``: a score for each query below which nothing is wanted. ``work`` gets the number of products of each pair of leaves."""
    low = np.iinfo(np.int64).min
    best, names = np.full((len(q), k), low, np.int64), np.zeros((len(q), k), np.int64)
    filled = np.zeros(len(q), np.int64)
    if not len(q) or not len(x):
        return best, names, np.zeros((len(q), k), bool)
    big = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(x).max(initial=0)), 1.0) * max(q.shape[1], 1) >= 2.0**53
    exact = [np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (q, x)] if big else None
    a, b = CoverTree(q), CoverTree(x)
    worst = np.full(len(q), -np.inf) if beat is None else beat.copy()

    def base(rows: np.ndarray, cols: np.ndarray) -> None:
        if work is not None:
            work.append(len(rows) * len(cols))
        if big:
            scores = np.clip(exact[0][rows].dot(exact[1][cols].T), low, np.iinfo(np.int64).max).astype(np.int64)
        else:
            scores = np.rint(q[rows] @ x[cols].T).astype(np.int64)
        take = (scores >= worst[rows, None]) & (q_ids[rows, None] != x_ids[cols])
        r, c = np.nonzero(take)
        if not len(r):
            return
        for i in np.unique(r).tolist():
            row, at = rows[i], c[np.searchsorted(r, i) : np.searchsorted(r, i, "right")]
            s, n = np.concatenate([best[row, : filled[row]], scores[i, at]]), np.concatenate([names[row, : filled[row]], x_ids[cols[at]]])
            by = np.lexsort((n, -s.astype(object) if big else -s))[:k]
            filled[row] = len(by)
            best[row, : len(by)], names[row, : len(by)] = s[by], n[by]
            if len(by) == k:
                worst[row] = max(worst[row], float(s[by[-1]]))

    def bounds(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        p, r = np.array([a.centre[i] for i in m]), np.array([b.centre[i] for i in n])
        ball = lambda t, at, c: (t.norm[c], np.array([t.radius[i] for i in at]), np.array([t.most[i] for i in at]))
        return _bounds(a.x[p] @ b.x[r].T, *ball(a, m, p), *ball(b, n, r))

    todo = [(0, 0, float(bounds(np.array([0]), np.array([0]))[0, 0]))]
    while todo:
        m, n, top = todo.pop()
        if top < worst[a.rows[m]].min():
            continue
        ca, cb = a.children[m], b.children[n]
        if ca is None and cb is None:
            base(a.rows[m], b.rows[n])
            continue
        ms, ns = np.array([m]) if ca is None else ca, np.array([n]) if cb is None else cb
        grid = bounds(ms, ns)
        floor = np.array([worst[a.rows[i]].min() for i in ms])
        i, j = np.nonzero(grid >= floor[:, None])
        order = np.argsort(grid[i, j], kind="stable")  # the most promising pair is last, so it comes next
        todo += [(int(ms[i[t]]), int(ns[j[t]]), float(grid[i[t], j[t]])) for t in order]
    return best, names, np.arange(k) < filled[:, None]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    rows = np.repeat(np.arange(len(lists)), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def centres_of(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Up to ``n`` centres of the rows of x: rows far from each other, then means of what is nearest to each."""
    centres, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(centres) < min(n, len(x)) and near.max() > 0:
        centres.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[centres[-1]]) ** 2).sum(axis=1))
    c = x[centres]
    for _ in range(rounds):
        owner, _ = _nearest(x, c)
        count = np.bincount(owner, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, owner, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is."""
    with np.errstate(over="ignore", invalid="ignore"):
        owner = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
        far = np.sqrt(((x - centres[owner]) ** 2).sum(axis=1))
    return owner, np.where(np.isnan(far), np.inf, far)


def _placed(centres):
    """Rows to rows with their cell, the distance from its pivot and the norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), centres.value.shape[1])
            owner, far = _nearest(x, centres.value) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
            with np.errstate(over="ignore"):
                norm = np.sqrt((x**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owner, pa.int32()), pa.array(far), pa.array(norm)], names=["row", "id", "v", "cell", "far", "norm"])

    return run


def reached(x: np.ndarray, beat: np.ndarray, centres: np.ndarray, radius: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which cells (columns) may hold a score of ``beat`` or more for each query (rows); a cell without rows has a radius of -1."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x**2).sum(axis=1))
        top = _bounds(x @ centres.T, norm, np.zeros(len(x)), norm, np.sqrt((centres**2).sum(axis=1)), np.maximum(radius, 0), most)
    return (top >= beat[:, None]) & (radius >= 0)


def _reach(cells):
    """Queries with a score to beat to the cells that they must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, most = cells.value
        for batch in batches:
            beat = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            at = reached(_matrix(batch.column(2), centres.shape[1]), np.where(np.isnan(beat), -np.inf, beat), centres, radius, most)
            row, cell = np.nonzero(at)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32()), pa.array(cell, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["row", "id", "v", "beat", "cells"])

    return run


def _group(k: int, seed: bool):
    """A block of queries and one of data to the queries' best rows, or, for a seed, to their k-th scores."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        lists = [t.column("v").combine_chunks() for t in (queries, data)]
        lists = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in lists]
        width = max([0, *(int(x.value_lengths().to_numpy(zero_copy_only=False).max()) for x in lists if len(x))])
        q, x = (_matrix(v, width) for v in lists)
        ids, rows = queries.column("id").to_numpy(), queries.column("row").to_numpy()
        beat = None
        if not seed:
            beat = queries.column("beat").to_numpy(zero_copy_only=False).astype(float)
            beat = np.where(np.isnan(beat), -np.inf, beat)
        scores, names, found = search(q, ids, x, data.column("id").to_numpy(), k, beat)
        if seed:
            full = found.all(axis=1)
            return pa.table({"row": rows[full], "beat": scores[full].min(axis=1).astype(float) if full.any() else np.zeros(0)})
        row, col = np.nonzero(found)
        return pa.table({"row": rows[row], "query_id": ids[row], "vec_id": names[row, col], "score": scores[row, col]})

    return run


def _floor(x: Column) -> Column:
    """floor(256 x) as a double of any size; SQL's floor gives a long."""
    y = 256 * x
    return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)


def top_k(
    vectors: DataFrame, is_query: str, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, data_block: int = DATA, query_block: int = QUERIES, cell: int = CELL, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row that ``is_query`` (SQL over ``id``) admits."""
    spark, v = vectors.sparkSession, F.col(embedding)
    usable = v.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(256 * x.cast("double")) == float("inf")))
    # The number of a row in the scan only tells rows of one id apart; it is written down with the cell.
    rows = modest(vectors).where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.transform(v.cast("array<double>"), _floor).alias("v"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    n_pivots = max(1, min(pivots, math.ceil(n / cell), PIVOT_BYTES // (8 * width)))
    most = min(SAMPLE * n_pivots, max(1, SAMPLE_BYTES // (8 * width)))
    sample = rows.where(chance(F.col("id"), most, n)).select("id", "v").limit(most).toArrow() if n_pivots > 1 else None
    centres = np.zeros((1, width))
    if sample is not None and len(sample):
        x = _matrix(pa.concat_arrays(sample.column("v").chunks), width)
        centres = centres_of(x[np.lexsort((*x.T[::-1], sample.column("id").to_numpy()))], n_pivots)
    placed = saved(rows.mapInArrow(_placed(spark.sparkContext.broadcast(centres)), "row bigint, id bigint, v array<double>, cell int, far double, norm double"), "vectors")

    # One row for each cell: at most as many as there are pivots.
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.count_if(F.expr(is_query)).alias("queries")).collect()
    parts = {r["cell"]: math.ceil(r["n"] / data_block) for r in cells}
    deal = lambda seed, of: F.pmod(F.xxhash64("row", F.lit(seed)), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    queries = placed.where(is_query).select("row", "id", "v", "cell")
    data = placed.select(*(F.col(c).alias(c) for c in ("row", "id", "v", "cell")))  # columns of its own: it meets the queries

    def told(groups: dict[int, int]) -> DataFrame:
        """(cell, parts, groups): blocks of data and of queries of each cell that has queries."""
        return F.broadcast(spark.createDataFrame([(c, parts[c], g) for c, g in groups.items() if g], "cell int, parts int, groups int"))

    def met(left: DataFrame, right: DataFrame, run, out: str) -> DataFrame:
        by = ["cell", "part", "group"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, out)

    first = told({r["cell"]: math.ceil(r["queries"] / parts[r["cell"]] / query_block) for r in cells})
    own = queries.join(first, "cell").select("row", "id", "v", "cell", deal(2, F.col("parts")).alias("part"), deal(1, F.col("groups")).alias("group"))
    dealt = lambda of: data.join(of, "cell").select("id", "v", "cell", deal(2, F.col("parts")).alias("part"), every(F.col("groups")).alias("group"))
    seeds = saved(met(own, dealt(first), _group(k, True), "row bigint, beat double"), "seeds")

    held = {r["cell"]: r for r in cells}
    radius, norm = (np.array([float(held[c][x]) if c in held else -1.0 for c in range(len(centres))]) for x in ("far", "norm"))
    known = spark.sparkContext.broadcast((centres, radius, np.maximum(norm, 0)))
    reach = queries.join(seeds, "row", "left").select("row", "id", "v", "beat").mapInArrow(_reach(known), "row bigint, id bigint, v array<double>, beat double, cells array<int>")
    reach = saved(reach, "reach")
    forget(seeds)
    reach = reach.select("row", "id", "v", "beat", F.explode("cells").alias("cell"))
    second = told({r["cell"]: math.ceil(r["count"] / query_block) for r in reach.groupBy("cell").count().collect()})
    asked = reach.join(second, "cell").select("row", "id", "v", "beat", "cell", deal(1, F.col("groups")).alias("group"), every(F.col("parts")).alias("part"))
    found = met(asked, dealt(second), _group(k, False), "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
