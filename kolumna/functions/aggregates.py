"""Aggregates as Spark columns. SUM and AVG are DOUBLE; over no rows a global aggregate is zero, not null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolumna.functions.scalars import value
from kolumna.plans.bound import Agg
from kolumna.schema import DataType


def aggregate(a: Agg, grouped: bool) -> Column:
    if a.argument is None:
        return F.count(F.lit(1))
    x = value(a.argument)
    match a.function:
        case "COUNT":
            return F.count(x)
        case "SUM":
            found = F.sum(x).cast("double")
            if a.argument.type.integral:  # exact while the sum fits a BIGINT; beyond, the sum of doubles
                found = F.coalesce(F.try_sum(x).cast("double"), F.sum(x.cast("double")))
        case "AVG":
            found = F.avg(x)
        case "MIN":
            found = F.min(x)
        case _:
            found = F.max(x)
    if grouped:
        return found
    zero = F.lit(a.type.zero)
    return F.coalesce(found, zero if a.type is DataType.VARCHAR else zero.cast(a.type.spark))
