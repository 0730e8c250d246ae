"""Tables by name, and their rows.

A table is a folder: ``rows`` holds Parquet batches that queries see,
``pending`` holds batches that were inserted but not flushed.  A batch is
first written to a staging folder, checked as a whole (types, nulls, string
lengths, primary key within the batch and against all batches), and only then
renamed into ``pending``; a batch that fails leaves nothing.  The checks are
one aggregate, one grouping and one semi-join over key columns.

One writer at a time holds a table's lock file, which names its process and
when it began; a second one is refused.  :meth:`Catalog.unlock` removes the
lock of a writer that is known to be gone.
Names, columns and keys are in ``catalog.json`` at the root.
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolumna.errors import BindError, ConstraintError
from kolumna.functions.scalars import quoted
from kolumna.schema import VARCHAR_BYTES, DataType, Key, Table, checked, table_of
from kolumna.sources.files import Files

VERSION = 1
#: Keys of a batch that are looked up one by one, and that are sent to all tasks: at most 64 bytes for each column.
FEW_KEYS, BROADCAST_KEYS = 20, 100_000


def duplicates(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The values of ``columns`` that occur in more than one row, with their number."""
    return rows.groupBy(*map(quoted, columns)).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._path = f"{self.root}/catalog.json"
        self._tables: dict[str, Table] = {}
        self._attached: dict[str, DataFrame] = {}
        self.files.make(self.root)
        if self.files.exists(self._path):
            stored = json.loads(self.files.read(self._path))
            if stored["version"] != VERSION:
                raise BindError(f"{self._path} has version {stored['version']}")
            self._tables = {t["name"]: Table.from_dict(t) for t in stored["tables"]}
            for name in self._tables:
                if not self.files.exists(f"{self._folder(name)}/_lock"):  # else its writer may be at work
                    self._settle(name)

    def _store(self) -> None:
        tables = [t.as_dict() for n, t in self._tables.items() if n not in self._attached]
        self.files.write(self._path, json.dumps({"version": VERSION, "tables": tables}))

    def names(self) -> list[str]:
        return sorted(self._tables)

    def find(self, name: str) -> Table:
        try:
            return self._tables[name]
        except KeyError:
            raise BindError(f"table not found: {name}") from None

    def create(self, table: Table) -> None:
        if table.name in self._tables:
            raise BindError(f"table {table.name} exists")
        self._tables[checked(table).name] = table
        try:
            self.files.make(self._folder(table.name))
            self._store()
        except Exception:
            del self._tables[table.name]
            raise

    def attach(self, name: str, rows: DataFrame, keys: tuple[Key, ...] = ()) -> None:
        """A table over a DataFrame, to be read only and forgotten when the catalog closes."""
        if name in self._tables:
            raise BindError(f"table {name} exists")
        self._tables[name] = checked(table_of(name, rows.schema, keys))
        self._attached[name] = rows

    def attached(self, name: str) -> bool:
        """Whether a table stands for a DataFrame."""
        return name in self._attached

    def drop(self, name: str) -> None:
        """Forget a table; its folder is set aside, not erased."""
        self.find(name)
        if not self._attached.pop(name, None):
            with self._writing(name):
                pass
            self.files.rename(self._folder(name), f"{self._folder(name)}_dropped_{uuid.uuid4().hex[:8]}")
        del self._tables[name]
        self._store()

    # Rows

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    @contextlib.contextmanager
    def _writing(self, name: str) -> Iterator[None]:
        if name in self._attached:
            raise BindError(f"table {name} is attached: it cannot be written")
        lock = f"{self._folder(name)}/_lock"
        if not self.files.claim(lock, f"{socket.gethostname()}:{os.getpid()} since {datetime.now(UTC):%Y-%m-%d %H:%M:%S} UTC"):
            raise ConstraintError(f"table {name} is being written by {self.files.read(lock) or 'another process'} ({lock})")
        try:
            yield
        finally:
            self.files.delete(lock)

    def unlock(self, name: str) -> None:
        """Remove the lock of a writer that is gone. What it had staged is not seen, and its batch is as if never given."""
        self.find(name)
        self._settle(name)
        self.files.delete(f"{self._folder(name)}/_lock")

    def _read(self, table: Table, *folders: str) -> DataFrame:
        there = [f"{self._folder(table.name)}/{f}" for f in folders]
        there = [f for f in there if self.files.names(f)]
        if not there:
            return self.spark.createDataFrame([], table.struct)
        return self.spark.read.schema(table.struct).option("recursiveFileLookup", "true").parquet(*there)

    def rows(self, name: str) -> DataFrame:
        """The rows that queries see."""
        table = self.find(name)
        return self._attached[name] if name in self._attached else self._read(table, "rows")

    def gather(self, name: str, offsets: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        """Flushed rows of a stored table by their places, from 0 in the order of its batches and files: a column ``offset``
        and the columns asked for (all by default), once for each time that an offset is given.  A place that is not there is an error.

        One count for each file tells where its rows begin; then only files that hold a place are read."""
        table = self.find(name)
        if name in self._attached:
            raise BindError(f"table {name} is attached: its rows have no places")
        names = tuple(columns) if columns is not None else tuple(c.name for c in table.columns)
        for c in names:
            table.column(c)
        rows = self._read(table, "rows")
        schema = "__offset bigint, __file string, __row bigint"
        places: list[tuple[int, str, int]] = []
        if offsets:
            there = rows.groupBy(F.col("_metadata.file_path").alias("f")).count().orderBy("f").collect() if self.files.names(f"{self._folder(name)}/rows") else []
            ends = list(accumulate(r["count"] for r in there))
            for k in offsets:
                if not 0 <= k < (ends[-1] if ends else 0):
                    raise ConstraintError(f"{name} has no row at {k}")
                at = bisect_right(ends, k)
                places.append((k, there[at]["f"], k - (ends[at - 1] if at else 0)))
        if not places:
            return rows.limit(0).select(F.lit(0).cast("long").alias("offset"), *map(quoted, names))
        wanted = self.spark.createDataFrame(places, schema)
        rows = rows.where(F.col("_metadata.file_path").isin(sorted({f for _, f, _ in places}))).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), *map(quoted, names))
        return rows.join(F.broadcast(wanted), ["__file", "__row"]).select(F.col("__offset").alias("offset"), *map(quoted, names))

    def append(self, name: str, rows: DataFrame) -> int:
        """Add a batch, unseen until :meth:`flush`. Returns its number of rows."""
        table = self.find(name)
        given = [(f.name, f.dataType) for f in rows.schema.fields]
        wanted = [(c.name, c.type.spark) for c in table.columns]
        if given != wanted:
            raise BindError(f"rows of {name} must be {wanted}, not {given}")
        with self._writing(name):
            staged = f"{self._folder(name)}/_staged_{uuid.uuid4().hex}"
            try:
                self._write(table, rows, staged)
                batch = self.spark.read.schema(table.struct).parquet(staged)
                count = self._check(table, batch)
                self.files.make(f"{self._folder(name)}/pending")
                number = len(self.files.names(f"{self._folder(name)}/pending")) + len(self.files.names(f"{self._folder(name)}/rows"))
                self.files.rename(staged, f"{self._folder(name)}/pending/batch-{number:06d}-{uuid.uuid4().hex[:8]}")
            except Exception:
                self.files.delete(staged)
                raise
        return count

    def _write(self, table: Table, rows: DataFrame, path: str) -> None:
        """Parquet files, each sorted by the primary key, with Bloom filters on all key columns."""
        writer = rows.sortWithinPartitions(*map(quoted, table.primary.columns)) if table.primary else rows
        writer = writer.write
        for c in {c for k in table.keys for c in k.columns}:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)

    def compact(self, name: str, file_bytes: int = 256 << 20) -> None:
        """Write the flushed rows of a table anew, in files of about ``file_bytes``, each with a range of the primary key.

        Inserts leave a folder of files each; this makes few of many, and lookups by the primary key read one of them.
        The new files are complete before the old ones are set aside; what a crash leaves is put right when
        the lock is removed, or, without one, when the catalog is opened."""
        table = self.find(name)
        with self._writing(name):
            self._settle(name)
            folder = self._folder(name)
            if not self.files.names(f"{folder}/rows"):
                return
            n = max(1, -(-self.files.size(f"{folder}/rows") // file_bytes))
            rows = self._read(table, "rows")
            rows = rows.repartitionByRange(n, *map(quoted, table.primary.columns)) if table.primary and n > 1 else rows.coalesce(n)
            staged = f"{folder}/_staged_{uuid.uuid4().hex}"
            self._write(table, rows, f"{staged}/batch-000000-{uuid.uuid4().hex[:8]}")
            self.files.rename(staged, f"{folder}/_merged")
            self.files.rename(f"{folder}/rows", f"{folder}/_before")
            self._settle(name)

    def _settle(self, name: str) -> None:
        """Finish a compaction, or undo it, by the folders that are there."""
        folder = self._folder(name)
        there = [x for x in ("rows", "_before", "_merged") if self.files.exists(f"{folder}/{x}")]
        if "rows" not in there and "_merged" in there:
            self.files.rename(f"{folder}/_merged", f"{folder}/rows")
        elif "rows" not in there and "_before" in there:
            self.files.rename(f"{folder}/_before", f"{folder}/rows")
        elif "_merged" in there:  # the rows that it was made of are still shown
            self.files.delete(f"{folder}/_merged")
        if "_before" in there and self.files.exists(f"{folder}/_before"):
            self.files.delete(f"{folder}/_before")

    def _check(self, table: Table, batch: DataFrame) -> int:
        any_null = F.lit(False)
        for c in table.columns:
            any_null = any_null | quoted(c.name).isNull()
        too_long = F.lit(False)
        for c in table.columns:
            if c.type is DataType.VARCHAR:
                too_long = too_long | (F.octet_length(quoted(c.name)) > VARCHAR_BYTES)
        count, nulls, long = batch.agg(F.count(F.lit(1)), F.count_if(any_null), F.count_if(too_long)).first()
        if nulls:
            raise ConstraintError(f"{nulls} rows for {table.name} have a null")
        if long:
            raise ConstraintError(f"{long} rows for {table.name} have a string of over {VARCHAR_BYTES} bytes")
        if table.primary:
            columns = table.primary.columns
            if not duplicates(batch, columns).isEmpty():
                raise ConstraintError(f"the rows for {table.name} repeat a value of its primary key")
            if not self._stored_with(table, batch.select(*map(quoted, columns)), count).isEmpty():
                raise ConstraintError(f"{table.name} has a row with this primary key")
        return count

    def _stored_with(self, table: Table, keys: DataFrame, count: int) -> DataFrame:
        """Primary keys of stored rows that ``keys`` has too.

        Stored rows stream past the batch's keys. Its least and greatest keys, and the keys themselves if they are few,
        are conditions at the scan, where file statistics and Bloom filters drop row groups."""
        columns = table.primary.columns
        stored = self._read(table, "rows", "pending").select(*map(quoted, columns))
        if not count:
            return stored.limit(0)
        ends = keys.agg(*(f(quoted(c)).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max)))).first()
        for k, c in enumerate(columns):
            stored = stored.where(quoted(c).between(F.lit(ends[f"low{k}"]), F.lit(ends[f"high{k}"])))
        if count <= FEW_KEYS and len(columns) == 1:
            stored = stored.where(quoted(columns[0]).isin([r[0] for r in keys.collect()]))
        return stored.join(F.broadcast(keys) if count <= BROADCAST_KEYS else keys, list(columns), "left_semi")

    def flush(self, name: str | None = None) -> None:
        """Show the pending batches of a table, or of all."""
        for n in [name] if name else [n for n in self._tables if n not in self._attached]:
            self.find(n)
            pending = self.files.names(f"{self._folder(n)}/pending")
            if not pending:
                continue
            with self._writing(n):
                self.files.make(f"{self._folder(n)}/rows")
                for batch in pending:
                    self.files.rename(f"{self._folder(n)}/pending/{batch}", f"{self._folder(n)}/rows/{batch}")
