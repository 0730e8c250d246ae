"""Syntax trees. ``str`` of an expression is the name of an output column without an alias."""

from __future__ import annotations

from dataclasses import dataclass

from kolumna.schema import DataType


@dataclass(frozen=True)
class Name:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal:
    value: int | float | str

    def __str__(self) -> str:
        return f"{self.value:f}" if isinstance(self.value, float) else str(self.value)

    @property
    def type(self) -> DataType:
        if isinstance(self.value, str):
            return DataType.VARCHAR
        if isinstance(self.value, float):
            return DataType.DOUBLE
        return DataType.INT if -(2**31) <= self.value < 2**31 else DataType.BIGINT


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Expr | None  # None: COUNT(*)

    def __str__(self) -> str:
        return f"{self.function}({'*' if self.argument is None else self.argument})"


@dataclass(frozen=True)
class Star:
    def __str__(self) -> str:
        return "*"


Expr = Name | Literal | Binary | Aggregate | Star


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or str(self.expr)


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    where: Expr | None = None
    group: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary: bool = False


@dataclass(frozen=True)
class KeyDef:
    columns: tuple[str, ...]
    name: str | None = None
    primary: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]
    keys: tuple[KeyDef, ...] = ()


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class SetMode:
    mode: str


@dataclass(frozen=True)
class Explain:
    query: Select


Statement = Select | CreateTable | Insert | DropTable | SetMode | Explain
