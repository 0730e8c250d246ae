"""The catalogue against DuckDB, in file order and dealt anew."""

import os

import duckdb
import pytest

from kolumna import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dealt")
    for t in queries.TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(5).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_agrees(spark, oracle, dealt, name):
    want = oracle.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    rows = sorted(want.select(*columns).fetchall(), key=repr)
    for folder in (DATA, dealt):
        df = queries.QUERIES[name](spark, folder)
        assert sorted(df.columns) == columns
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == rows


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
