"""Bound expressions and statements: names resolved, types known."""

from __future__ import annotations

from dataclasses import dataclass

from kolumna.schema import DataType, Table


@dataclass(frozen=True)
class ColumnRef:
    name: str
    type: DataType


@dataclass(frozen=True)
class Const:
    value: int | float | str
    type: DataType


@dataclass(frozen=True)
class Op:
    op: str
    left: Scalar
    right: Scalar
    type: DataType


@dataclass(frozen=True)
class Agg:
    function: str
    argument: Scalar | None
    type: DataType


Scalar = ColumnRef | Const | Op
Bound = Scalar | Agg


@dataclass(frozen=True)
class Output:
    name: str
    expr: Bound


@dataclass(frozen=True)
class BoundSelect:
    table: Table
    outputs: tuple[Output, ...]
    where: Scalar | None
    group: tuple[Scalar, ...]

    @property
    def aggregated(self) -> bool:
        return bool(self.group) or any(isinstance(o.expr, Agg) for o in self.outputs)


@dataclass(frozen=True)
class BoundInsert:
    """Rows in the table's column order, left-out columns filled with zeros."""

    table: Table
    rows: tuple[tuple, ...]


def conjuncts(e: Scalar | None) -> list[Scalar]:
    """The parts of a condition that AND joins."""
    if e is None:
        return []
    if isinstance(e, Op) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]
