"""An order-independent digest of a result: equal for equal multisets of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.streaming import in_turn

_WRAP = 1 << 64


@dataclass(frozen=True)
class Digest:
    """Number of rows and the sums, modulo 2^64, of two hashes of each row."""

    row_count: int
    first: int
    second: int

    def __str__(self) -> str:
        return f"{self.row_count}:{self.first:016x}:{self.second:016x}"


def digest(rows: DataFrame, at_once: int | None = None) -> Digest:
    """``at_once``: tasks of ``rows`` that run at a time, each to sums of its own; None leaves them to Spark."""
    named = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    columns = [F.col(c) for c in named.columns]
    hashes = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns, F.lit(2))
    if at_once:
        sums = in_turn(named.select(hashes[0].alias("a"), hashes[1].alias("b")).mapInArrow(_summed(), "n bigint, a bigint, b bigint"), at_once)
        n, a, b = map(sum, zip((0, 0, 0), *sums))
    else:
        total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))
        n, a, b = named.agg(F.count(F.lit(1)), *map(total, hashes)).first()
    return Digest(n, int(a) % _WRAP, int(b) % _WRAP)


def _summed():
    """A task's number of rows and sums of their hashes, modulo 2^64. A function of its own, as workers may lack this package."""

    def run(batches):
        import pyarrow as pa

        n, sums = 0, [0, 0]
        for batch in batches:
            n += batch.num_rows
            sums = [(s + int(c.to_numpy().sum())) % (1 << 64) for s, c in zip(sums, batch.columns)]  # a sum of 64-bit numbers wraps around
        signed = [s - (s >> 63 << 64) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, *signed)], ["n", "a", "b"])

    return run
