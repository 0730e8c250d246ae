"""Filter, projection and aggregation.

Plans stay declarative: the conditions reach the Parquet scan, only columns in
use are read, and aggregates split into partial and final around one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from kolumna.functions import aggregate, truth, value
from kolumna.plans.bound import Agg, BoundSelect, Output, Scalar


def filtered(rows: DataFrame, where: Scalar | None) -> DataFrame:
    return rows if where is None else rows.where(truth(where))


def projected(rows: DataFrame, outputs: tuple[Output, ...]) -> DataFrame:
    return rows.select(*(value(o.expr).alias(o.name) for o in outputs))


def aggregated(rows: DataFrame, outputs: tuple[Output, ...], group: tuple[Scalar, ...]) -> DataFrame:
    """One row for each group, or exactly one without keys."""
    keys = {e: f"__key{i}" for i, e in enumerate(group)}
    found = {o.expr: f"__agg{i}" for i, o in enumerate(outputs) if isinstance(o.expr, Agg)}
    columns = [aggregate(a, bool(group)).alias(n) for a, n in found.items()]
    grouped = [value(e).alias(n) for e, n in keys.items()]
    if not columns:
        result = rows.select(*grouped).distinct()
    elif grouped:
        result = rows.groupBy(*grouped).agg(*columns)
    else:
        result = rows.agg(*columns)
    names = keys | found
    return result.select(*(result[names[o.expr]].alias(o.name) for o in outputs))


def run_select(plan: BoundSelect, rows: DataFrame) -> DataFrame:
    """``rows``: all of the plan's table."""
    kept = filtered(rows, plan.where)
    return aggregated(kept, plan.outputs, plan.group) if plan.aggregated else projected(kept, plan.outputs)
