"""Expressions and aggregates as Spark columns."""

from kolumna.functions.aggregates import aggregate
from kolumna.functions.scalars import truth, value

__all__ = ["aggregate", "truth", "value"]
