"""Which key, if any, a condition looks rows up by.

A lookup takes an equality with a number for every column of a key: the
primary key first, then the others in order of definition.  Strings are not
looked up by, nor is a whole-number column by a number that it cannot hold
(1.5, or one out of its range).  The rows are the same either way; tables that the engine
writes have Bloom filters on key columns and are sorted by them in each file,
so the lookup skips row groups at the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from kolumna.plans.bound import BoundSelect, ColumnRef, Const, Op, conjuncts
from kolumna.schema import RANGE, DataType, Key


@dataclass(frozen=True)
class AccessPath:
    """``key`` None: all rows are read."""

    key: Key | None
    residual: int  # conditions beside those on the key

    def __str__(self) -> str:
        return "SeqScan" if self.key is None else f"IndexScan({self.key.name})"


def _holds(kind: DataType, number: int | float) -> bool:
    """Whether a column of this type can hold the number exactly."""
    if not kind.integral:
        return True
    bits = RANGE[kind]
    return number == math.floor(number) and -(2**bits) <= number < 2**bits


def access_path(plan: BoundSelect) -> AccessPath:
    parts = conjuncts(plan.where)
    fixed = set()
    for p in parts:
        if isinstance(p, Op) and p.op == "=":
            for a, b in ((p.left, p.right), (p.right, p.left)):
                if isinstance(a, ColumnRef) and isinstance(b, Const) and a.type.numeric and b.type.numeric and _holds(a.type, b.value):
                    fixed.add(a.name)
    keys = [k for k in (plan.table.primary, *plan.table.secondary) if k]
    for k in keys:
        if set(k.columns) <= fixed:
            return AccessPath(k, len(parts) - len(k.columns))
    return AccessPath(None, len(parts))
