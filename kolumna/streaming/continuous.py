"""A SELECT over a stored table as a streaming query: flushed batches are taken in as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kolumna.operators import run_select
from kolumna.plans.binder import bind_select
from kolumna.sources.catalog import Catalog
from kolumna.sql import ast, parse


def follow(catalog: Catalog, sql: str) -> DataFrame:
    """A streaming DataFrame. Aggregates are to be written in complete mode, other queries in append mode."""
    statement = parse(sql)
    if not isinstance(statement, ast.Select):
        raise TypeError("only a SELECT can be followed")
    plan = bind_select(statement, catalog.find)
    catalog.files.make(f"{catalog.root}/{plan.table.name}/rows")
    source = catalog.spark.readStream.schema(plan.table.struct).option("recursiveFileLookup", "true").parquet(f"{catalog.root}/{plan.table.name}/rows")
    return run_select(plan, source)
