"""Types, columns, keys and tables, and their Spark counterparts."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from pyspark.sql import types as T

from kolumna.errors import BindError


class DataType(enum.Enum):
    """The column types. OTHER stands for a type of an attached table that expressions cannot use."""

    INT = "INT"
    BIGINT = "BIGINT"
    FLOAT = "FLOAT"
    DOUBLE = "DOUBLE"
    VARCHAR = "VARCHAR"
    OTHER = "OTHER"

    @property
    def numeric(self) -> bool:
        return self in _NUMERIC

    @property
    def integral(self) -> bool:
        return self in (DataType.INT, DataType.BIGINT)

    @property
    def spark(self) -> T.DataType:
        if self is DataType.OTHER:
            raise BindError("this column has a type that the engine does not know")
        return _SPARK[self]

    @property
    def zero(self) -> int | float | str:
        """What fills a column that an INSERT leaves out, and what aggregates of no rows give."""
        return "" if self is DataType.VARCHAR else 0.0 if self in (DataType.FLOAT, DataType.DOUBLE) else 0


#: Whole numbers of n bits beside the sign, by type.
RANGE = {DataType.INT: 31, DataType.BIGINT: 63}
_NUMERIC = (DataType.INT, DataType.BIGINT, DataType.FLOAT, DataType.DOUBLE)
_SPARK = {DataType.INT: T.IntegerType(), DataType.BIGINT: T.LongType(), DataType.FLOAT: T.FloatType(), DataType.DOUBLE: T.DoubleType(), DataType.VARCHAR: T.StringType()}
_BY_SPARK = {type(v): k for k, v in _SPARK.items()}
_SPELLED = {"INT": DataType.INT, "INTEGER": DataType.INT, "BIGINT": DataType.BIGINT, "FLOAT": DataType.FLOAT, "DOUBLE": DataType.DOUBLE, "VARCHAR": DataType.VARCHAR}

#: Bytes of a VARCHAR value in tables that the engine makes.
VARCHAR_BYTES = 60


def type_named(name: str) -> DataType:
    try:
        return _SPELLED[name.upper()]
    except KeyError:
        raise BindError(f"unknown type: {name}") from None


def type_of(spark_type: T.DataType) -> DataType:
    return _BY_SPARK.get(type(spark_type), DataType.OTHER)


@dataclass(frozen=True)
class Column:
    name: str
    type: DataType


@dataclass(frozen=True)
class Key:
    """A key over columns of the table. Values of the primary key are unique; other keys only help lookups."""

    name: str
    columns: tuple[str, ...]
    primary: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    keys: tuple[Key, ...] = field(default=())

    @property
    def primary(self) -> Key | None:
        return next((k for k in self.keys if k.primary), None)

    @property
    def secondary(self) -> tuple[Key, ...]:
        return tuple(k for k in self.keys if not k.primary)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise BindError(f"column not found: {name}")

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, False) for c in self.columns])

    def as_dict(self) -> dict:
        return {"name": self.name, "columns": [[c.name, c.type.value] for c in self.columns], "keys": [[k.name, list(k.columns), k.primary] for k in self.keys]}

    @staticmethod
    def from_dict(d: dict) -> Table:
        return Table(d["name"], tuple(Column(n, DataType(t)) for n, t in d["columns"]), tuple(Key(n, tuple(c), p) for n, c, p in d["keys"]))


def table_of(name: str, struct: T.StructType, keys: tuple[Key, ...] = ()) -> Table:
    """The table that a DataFrame's schema describes."""
    return Table(name, tuple(Column(f.name, type_of(f.dataType)) for f in struct.fields), keys)


def checked(table: Table) -> Table:
    """``table`` if its names are distinct and its keys are over its columns, at most one of them primary."""
    names = [c.name for c in table.columns]
    if not names:
        raise BindError(f"table {table.name} has no columns")
    if len(set(names)) < len(names):
        raise BindError(f"table {table.name} names a column twice")
    if sum(k.primary for k in table.keys) > 1:
        raise BindError(f"table {table.name} has more than one primary key")
    if len({k.name for k in table.keys}) < len(table.keys):
        raise BindError(f"table {table.name} names a key twice")
    for k in table.keys:
        if not k.columns or len(set(k.columns)) < len(k.columns):
            raise BindError(f"key {k.name} is empty or repeats a column")
        for c in k.columns:
            table.column(c)
    return table
