"""Bound scalar expressions as Spark columns.

Conditions stay Boolean inside filters and become 0 or 1 where they are
values.  A whole-number column is compared with a fractional or huge literal
by a whole-number bound (n > 2.5 is n > 2), which is exact where doubles are
not and which the Parquet reader can prune by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolumna.plans.bound import ColumnRef, Const, Op, Scalar
from kolumna.schema import RANGE, DataType

_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def value(e: Scalar) -> Column:
    """``e`` as a value of its type."""
    match e:
        case ColumnRef():
            return quoted(e.name)
        case Const():
            return F.lit(e.value) if e.type is DataType.VARCHAR else F.lit(e.value).cast(e.type.spark)
        case Op(op="+" | "-"):
            a, b = value(e.left), value(e.right)
            found = a + b if e.op == "+" else a - b
            return found if e.left.type is e.right.type is e.type else found.cast(e.type.spark)
    return truth(e).cast("int")


def truth(e: Scalar) -> Column:
    """``e`` as a condition: numbers are true if not 0, strings if not empty."""
    if isinstance(e, Op):
        if e.op == "AND":
            return truth(e.left) & truth(e.right)
        if e.op == "OR":
            return truth(e.left) | truth(e.right)
        if e.op in _COMPARE:
            return _compare(e)
    return value(e) != (F.lit("") if e.type is DataType.VARCHAR else F.lit(0))


def _compare(e: Op) -> Column:
    op, left, right = e.op, e.left, e.right
    if isinstance(left, Const) and not isinstance(right, Const):
        op, left, right = _FLIP[op], right, left
    if isinstance(right, Const) and left.type.integral and right.type.numeric:
        return _against_number(op, value(left), RANGE[left.type], right.value)
    return _COMPARE[op](value(left), value(right))


def _against_number(op: str, column: Column, bits: int, number: int | float) -> Column:
    """A whole-number column against any number, by whole numbers in the column's range."""
    low, high = -(2**bits), 2**bits - 1
    whole = number == math.floor(number)
    if op in ("=", "!="):
        if not whole or not low <= number <= high:
            return F.lit(op == "!=") & column.isNotNull()
        bound = int(number)
    elif op in ("<", ">="):
        bound = math.ceil(number)
    else:
        bound = math.floor(number)
    if not low <= bound <= high:
        below = bound > high  # the whole range lies below the bound
        return F.lit(below if op in ("<", "<=") else not below) & column.isNotNull()
    return _COMPARE[op](column, F.lit(bound).cast("int" if bits == 31 else "bigint"))
