"""Rows of a result in batches, without holding the result."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row

#: Rows of a batch.
BATCH = 1024


def batches(rows: DataFrame, size: int = BATCH) -> Iterator[tuple[Row, ...]]:
    """Partition by partition: the driver holds one partition at a time."""
    yield from batched(rows.toLocalIterator(), size)


def in_turn(rows: DataFrame, at_once: int) -> Iterator[Row]:
    """Rows whose tasks run so many at a time, in the order of the partitions; what lies behind a shuffle runs once, for all of them."""
    if at_once < 1:
        raise ValueError(f"so many tasks cannot run at a time: {at_once}")
    tasks = rows.rdd
    n = tasks.getNumPartitions()
    for k in range(0, n, at_once):
        yield from rows.sparkSession.sparkContext.runJob(tasks, list, list(range(k, min(k + at_once, n))))
