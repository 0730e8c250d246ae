"""The engine's front door: databases, connections, prepared statements, results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from kolumna.digest import Digest, digest
from kolumna.errors import BindError
from kolumna.operators import run_select
from kolumna.plans.access import AccessPath, access_path
from kolumna.plans.binder import bind_create, bind_insert, bind_select
from kolumna.plans.bound import Agg, BoundSelect
from kolumna.schema import Column, Key, Table
from kolumna.sources.catalog import Catalog
from kolumna.sql import ast, parse
from kolumna.streaming import BATCH, batches, in_turn


@dataclass(frozen=True)
class Config:
    """How results run. ``mode``: auto leaves a result's tasks to Spark, single runs one at a time, multi ``partitions`` at a time.

    No mode changes what a task holds: it reads a partition as Spark makes them, never the whole result."""

    mode: str = "auto"
    partitions: int | None = None

    @property
    def at_once(self) -> int | None:
        return {"single": 1, "multi": self.partitions}.get(self.mode)


@dataclass
class Result:
    """What a statement gave: rows of a SELECT, or the number of rows that a command affected."""

    kind: str
    columns: tuple[Column, ...] = ()
    frame: DataFrame | None = None
    affected_rows: int = 0
    text: str = ""
    at_once: int | None = None
    _rows: list[Row] | None = field(default=None, repr=False)

    def rows(self) -> list[Row]:
        """All rows, on the driver: for results known to be small."""
        if self._rows is None:
            self._rows = [] if self.frame is None else list(in_turn(self.frame, self.at_once)) if self.at_once else self.frame.collect()
        return self._rows

    def batches(self, size: int = BATCH):
        return batches(self.frame, size) if self.frame is not None else iter(())

    def digest(self) -> Digest:
        return digest(self.frame, self.at_once) if self.frame is not None else Digest(0, 0, 0)


@dataclass(frozen=True)
class Prepared:
    """A planned statement, to be run any number of times; each run sees the rows of its time.

    Over an attached table, whose rows are a fixed frame, the statement's own frame is built once and held."""

    sql: str
    statement: ast.Statement
    plan: BoundSelect | None
    held: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)


class Database:
    """Tables under one folder. Closing (or leaving a ``with``) flushes what was inserted."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.catalog = Catalog(spark, root)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.catalog.flush()

    def connect(self) -> Connection:
        return Connection(self)

    def create_table(self, table: Table) -> None:
        self.catalog.create(table)

    def drop_table(self, name: str) -> None:
        self.catalog.drop(name)

    def attach(self, name: str, rows: DataFrame, keys: tuple[Key, ...] = ()) -> None:
        self.catalog.attach(name, rows, keys)

    def append(self, name: str, rows: DataFrame) -> int:
        """Bulk load: any Spark DataFrame of the table's columns and types."""
        return self.catalog.append(name, rows)

    def compact(self, name: str) -> None:
        """Make few files of a table's many."""
        self.catalog.compact(name)

    def gather(self, name: str, offsets: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of a stored table by their places."""
        return self.catalog.gather(name, offsets, columns)

    def flush(self, name: str | None = None) -> None:
        self.catalog.flush(name)

    def unlock(self, name: str) -> None:
        """Remove a table's lock after its writer was lost."""
        self.catalog.unlock(name)

    def set_mode(self, mode: str) -> None:
        if mode not in ("auto", "single", "multi"):
            raise BindError(f"unknown mode: {mode}")
        self.config = Config(mode, self.config.partitions)


class Connection:
    def __init__(self, database: Database):
        self.database = database

    def plan(self, sql: str) -> BoundSelect:
        statement = parse(sql)
        if not isinstance(statement, ast.Select):
            raise BindError("not a SELECT")
        return bind_select(statement, self.database.catalog.find)

    def frame(self, sql: str) -> DataFrame:
        """A SELECT as a lazy DataFrame, whose caller runs it: the mode does not apply."""
        return self._frame(self.plan(sql))

    def access(self, sql: str) -> AccessPath:
        return access_path(self.plan(sql))

    def query(self, sql: str) -> Result:
        return self.execute(self.prepare(sql))

    def prepare(self, sql: str) -> Prepared:
        statement = parse(sql)
        plan = bind_select(statement, self.database.catalog.find) if isinstance(statement, ast.Select) else None
        return Prepared(sql, statement, plan)

    def execute(self, what: str | Prepared, consumer: Callable[[tuple[Row, ...]], None] | None = None, size: int = BATCH) -> Result:
        """Run a statement. A consumer gets a SELECT's rows in batches; they are not kept then."""
        prepared = self.prepare(what) if isinstance(what, str) else what
        result = self._run(prepared)
        if consumer and result.frame is not None:
            for batch in result.batches(size):
                consumer(batch)
                result.affected_rows += len(batch)
        return result

    def _frame(self, plan: BoundSelect, held: dict[str, DataFrame] | None = None) -> DataFrame:
        catalog = self.database.catalog
        rows = catalog.rows(plan.table.name)
        if held is None or not catalog.attached(plan.table.name):
            found = run_select(plan, rows)
        else:
            if held.get("rows") is not rows:
                held |= {"rows": rows, "found": run_select(plan, rows)}
            found = held["found"].select("*")  # a frame of its own: one that has run once would begin at its last shuffle
        return planned_at_once(found) if plan.aggregated and not plan.group else found

    def _run(self, prepared: Prepared) -> Result:
        catalog, statement = self.database.catalog, prepared.statement
        match statement:
            case ast.Select():
                plan = prepared.plan
                return Result("SELECT", tuple(Column(o.name, o.expr.type) for o in plan.outputs), self._frame(plan, prepared.held), at_once=self.database.config.at_once)
            case ast.CreateTable():
                catalog.create(bind_create(statement))
                return Result("CREATE TABLE")
            case ast.Insert():
                insert = bind_insert(statement, catalog.find)
                rows = self.database.spark.createDataFrame(list(insert.rows), insert.table.struct)
                return Result("INSERT", affected_rows=catalog.append(insert.table.name, rows))
            case ast.DropTable():
                catalog.drop(statement.table)
                return Result("DROP TABLE")
            case ast.SetMode():
                self.database.set_mode(statement.mode)
                return Result("SET MODE")
            case ast.Explain():
                plan = bind_select(statement.query, catalog.find)
                return Result("EXPLAIN", text=explained(plan, self._frame(plan)))
        raise BindError(f"cannot run {prepared.sql}")


def planned_at_once(frame: DataFrame) -> DataFrame:
    """A global aggregate, planned without adaptive execution: behind its one exchange is one partition, which there is nothing to
    adapt for, and its two stages are one job instead of two."""
    conf, name = frame.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        frame._jdf.queryExecution().executedPlan()
    finally:
        conf.set(name, before)
    return frame


def explained(plan: BoundSelect, frame: DataFrame) -> str:
    """The access path, the shape of the plan, and Spark's physical plan."""
    shape = ["Aggregate" if plan.aggregated else "Project", *(["Filter"] if plan.where is not None else []), str(access_path(plan))]
    aggregates = sum(isinstance(o.expr, Agg) for o in plan.outputs)
    physical = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return f"{' <- '.join(shape)} ({aggregates} aggregates)\n{physical}"
