"""The query catalogue over the synthetic tables: each entry runs through the engine, and has SQL for another engine to agree with.

Entries are (engine SQL, expressions over its result, oracle SQL).  Sums and
averages of doubles are rounded in both, since their last bits depend on the
order of addition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kolumna.database import Config, Connection, Database
from kolumna.errors import ConstraintError
from kolumna.schema import Key, table_of
from kolumna.session import shared_folder
from kolumna.sources import bench_table
from kolumna.sources.catalog import duplicates
from kolumna.sources.files import remove_at_exit

#: Keys of the attached tables.
KEYS = {
    "orders": (Key("__primary__", ("o_orderkey",), True), Key("by_customer", ("o_custkey",))),
    "lineitem": (Key("by_line", ("l_orderkey", "l_linenumber")),),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_L = "SELECT l_orderkey, l_linenumber"
#: Name: the engine's SQL, {column: expression over its result}, and the oracle's SQL where it is another text.
CATALOGUE: dict[str, tuple[str, dict[str, str], str | None]] = {
    "scan_star": ("SELECT * FROM nation", {}, None),
    "scan_columns": ("SELECT o_orderkey, o_totalprice FROM orders", {}, None),
    "scan_count_only": ("SELECT COUNT(*) AS c FROM lineitem", {}, None),
    "index_pk_hit": ("SELECT * FROM orders WHERE o_orderkey = 42", {}, None),
    "index_pk_miss": ("SELECT * FROM orders WHERE o_orderkey = 999999999", {}, None),
    "index_pk_fractional_literal": ("SELECT o_orderkey FROM orders WHERE o_orderkey = 1.5", {}, None),
    "index_secondary": ("SELECT o_orderkey FROM orders WHERE o_custkey = 7", {}, None),
    "index_secondary_residual": ("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 200000", {}, None),
    "index_composite": ("SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 10 AND l_linenumber = 1", {}, None),
    "project_alias": ("SELECT o_orderkey AS k, o_totalprice price FROM orders", {}, None),
    "project_add_const": (f"{_L}, l_quantity + 1 AS q1 FROM lineitem", {}, None),
    "project_sub_const": (f"{_L}, l_quantity - 2 AS q2 FROM lineitem", {}, None),
    "project_const_minus_col": (f"{_L}, 100 - l_quantity AS q3 FROM lineitem", {}, None),
    "project_col_col": (f"{_L}, l_discount + l_tax AS dt FROM lineitem", {}, None),
    "project_nested": (f"{_L}, (l_quantity + 1) + 2 AS q FROM lineitem", {}, None),
    "project_literal": ("SELECT 1 AS one, 'x' AS s, n_name FROM nation", {}, None),
    "project_comparison_int": (f"{_L}, l_quantity > 25 AS f FROM lineitem", {}, f"{_L}, CAST(l_quantity > 25 AS INT) AS f FROM lineitem"),
    "project_sparse": ("SELECT l_orderkey, l_quantity + 1 AS q FROM lineitem WHERE l_quantity > 49", {}, None),
    "filter_eq": (f"{_L} FROM lineitem WHERE l_quantity = 25", {}, None),
    "filter_gt": (f"{_L} FROM lineitem WHERE l_quantity > 25", {}, None),
    "filter_lt": (f"{_L} FROM lineitem WHERE l_quantity < 25", {}, None),
    "filter_ge": (f"{_L} FROM lineitem WHERE l_quantity >= 25", {}, None),
    "filter_le": (f"{_L} FROM lineitem WHERE l_quantity <= 25", {}, None),
    "filter_ne": (f"{_L} FROM lineitem WHERE l_quantity != 25", {}, None),
    "filter_literal_left": (f"{_L} FROM lineitem WHERE 25 < l_quantity", {}, None),
    "filter_col_col": (f"{_L} FROM lineitem WHERE l_partkey > l_suppkey", {}, None),
    "filter_and_split": ("SELECT l_orderkey FROM lineitem WHERE l_quantity > 25 AND l_discount >= 0.05", {}, None),
    "filter_or": ("SELECT l_orderkey FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48", {}, None),
    "filter_mixed_parens": ("SELECT l_orderkey FROM lineitem WHERE (l_quantity < 10 OR l_tax >= 0.05) AND l_linenumber = 1", {}, None),
    "filter_varchar_eq": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", {}, None),
    "filter_varchar_range": ("SELECT c_custkey FROM customer WHERE c_mktsegment >= 'F'", {}, None),
    "filter_expr": ("SELECT l_orderkey FROM lineitem WHERE (l_quantity + 1) > 40", {}, None),
    "filter_int_vs_double": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2.5", {}, None),
    "filter_truthy_int": ("SELECT l_orderkey FROM lineitem WHERE l_linenumber - 1", {}, "SELECT l_orderkey FROM lineitem WHERE (l_linenumber - 1) <> 0"),
    "filter_truthy_string": ("SELECT c_custkey FROM customer WHERE c_mktsegment AND c_acctbal > 0", {}, "SELECT c_custkey FROM customer WHERE c_mktsegment <> '' AND c_acctbal > 0"),
    "filter_zero_match": ("SELECT l_orderkey FROM lineitem WHERE l_quantity < 0", {}, None),
    "filter_logic_as_value": ("SELECT l_orderkey, l_quantity > 25 AND l_tax < 0.04 AS f FROM lineitem", {}, "SELECT l_orderkey, CAST(l_quantity > 25 AND l_tax < 0.04 AS INT) AS f FROM lineitem"),
    "agg_count_star_col": ("SELECT COUNT(*) AS c, COUNT(l_tax) AS c2 FROM lineitem", {}, None),
    "agg_sum_int_as_double": ("SELECT SUM(l_linenumber) AS s FROM lineitem", {}, "SELECT CAST(SUM(l_linenumber) AS DOUBLE) AS s FROM lineitem"),
    "agg_sum_beyond_bigint": (
        "SELECT SUM(c_custkey + 4611686018427387904) AS s FROM customer",
        {"s": "round(s / 1e18, 6)"},
        "SELECT ROUND(CAST(SUM(c_custkey + 4611686018427387904) AS DOUBLE) / 1e18, 6) AS s FROM customer",
    ),
    "agg_sum_double": ("SELECT SUM(l_extendedprice) AS s FROM lineitem", {"s": "round(s, 2)"}, "SELECT ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem"),
    "agg_avg": ("SELECT AVG(l_extendedprice) AS a FROM lineitem", {"a": "round(a, 4)"}, "SELECT ROUND(AVG(l_extendedprice), 4) AS a FROM lineitem"),
    "agg_min_max_num": ("SELECT MIN(l_quantity) AS mi, MAX(l_quantity) AS ma FROM lineitem", {}, None),
    "agg_min_max_varchar": ("SELECT MIN(l_returnflag) AS mi, MAX(l_returnflag) AS ma FROM lineitem", {}, None),
    "agg_expr_arg": ("SELECT SUM(l_linenumber + 1) AS s FROM lineitem", {}, "SELECT CAST(SUM(l_linenumber + 1) AS DOUBLE) AS s FROM lineitem"),
    "agg_sum_of_comparison": ("SELECT SUM(l_quantity > 25) AS s FROM lineitem", {}, "SELECT CAST(SUM(CAST(l_quantity > 25 AS INT)) AS DOUBLE) AS s FROM lineitem"),
    "agg_empty_global": (
        "SELECT COUNT(*) AS c, SUM(l_linenumber) AS s, AVG(l_quantity) AS a, MIN(l_linenumber) AS mi, MAX(l_quantity) AS ma FROM lineitem WHERE l_quantity < 0",
        {},
        "SELECT COUNT(*) AS c, COALESCE(CAST(SUM(l_linenumber) AS DOUBLE), CAST(0 AS DOUBLE)) AS s, COALESCE(AVG(l_quantity), CAST(0 AS DOUBLE)) AS a, COALESCE(MIN(l_linenumber), 0) AS mi, COALESCE(MAX(l_quantity), CAST(0 AS DOUBLE)) AS ma FROM lineitem WHERE l_quantity < 0",
    ),
    "agg_empty_grouped": ("SELECT l_returnflag AS g, COUNT(*) AS c FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag", {}, None),
    "group_low": ("SELECT l_returnflag, COUNT(*) AS c, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", {"s": "round(s, 2)"}, "SELECT l_returnflag, COUNT(*) AS c, ROUND(SUM(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag"),
    "group_multi_key": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus", {}, None),
    "group_high": ("SELECT l_orderkey, COUNT(*) AS c, SUM(l_quantity) AS s FROM lineitem GROUP BY l_orderkey", {"s": "round(s, 2)"}, "SELECT l_orderkey, COUNT(*) AS c, ROUND(SUM(l_quantity), 2) AS s FROM lineitem GROUP BY l_orderkey"),
    "group_expr_key": ("SELECT l_linenumber + 1 AS k, COUNT(*) AS c FROM lineitem GROUP BY l_linenumber + 1", {}, None),
    "group_bool_key": ("SELECT l_quantity > 25 AS k, COUNT(*) AS c FROM lineitem GROUP BY l_quantity > 25", {}, "SELECT CAST(l_quantity > 25 AS INT) AS k, COUNT(*) AS c FROM lineitem GROUP BY CAST(l_quantity > 25 AS INT)"),
    "group_distinct": ("SELECT p_brand FROM part GROUP BY p_brand", {}, None),
    "group_key_not_selected": ("SELECT COUNT(*) AS c FROM lineitem GROUP BY l_returnflag", {}, None),
    "group_filtered_events": ("SELECT user_id, COUNT(*) AS c, AVG(value) AS a FROM events WHERE value > 10 GROUP BY user_id", {"a": "round(a, 6)"}, "SELECT user_id, COUNT(*) AS c, ROUND(AVG(value), 6) AS a FROM events WHERE value > 10 GROUP BY user_id"),
    "bench_q2_filter_agg": ("SELECT COUNT(*) AS c, SUM(l_extendedprice) AS s FROM lineitem WHERE l_discount > 0.05", {"s": "round(s, 2)"}, "SELECT COUNT(*) AS c, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem WHERE l_discount > 0.05"),
    "flagship": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS c, SUM(l_extendedprice) AS s, AVG(l_discount) AS a, MIN(l_quantity) AS mi, MAX(l_quantity) AS ma FROM lineitem WHERE l_quantity > 5 AND l_discount >= 0.02 AND (l_tax < 0.06 OR l_linenumber = 1) GROUP BY l_returnflag, l_linestatus",
        {"s": "round(s, 2)", "a": "round(a, 6)"},
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS c, ROUND(SUM(l_extendedprice), 2) AS s, ROUND(AVG(l_discount), 6) AS a, MIN(l_quantity) AS mi, MAX(l_quantity) AS ma FROM lineitem WHERE l_quantity > 5 AND l_discount >= 0.02 AND (l_tax < 0.06 OR l_linenumber = 1) GROUP BY l_returnflag, l_linestatus",
    ),
}


def scratch(spark: SparkSession) -> str:
    """A new folder for a database, removed when the process ends: in the shared folder that the session names, or, where it names none, in this process's own."""
    shared = shared_folder(spark)
    path = f"{shared}/kolumna-db-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="kolumna-db-")
    remove_at_exit(spark, path)
    return path


class _Attached(Connection):
    """A connection to the synthetic tables alone; it keeps nothing on disk."""

    class _Tables:
        def __init__(self, spark: SparkSession, sf_dir: str):
            self._spark, self._dir, self._frames = spark, sf_dir, {}

        def rows(self, name: str) -> DataFrame:
            if name not in self._frames:
                self._frames[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            return self._frames[name]

        def attached(self, name: str) -> bool:
            return True

        def find(self, name: str):
            return table_of(name, self.rows(name).schema, KEYS.get(name, ()))

    def __init__(self, spark: SparkSession, sf_dir: str):
        from types import SimpleNamespace

        super().__init__(SimpleNamespace(spark=spark, config=Config(), catalog=self._Tables(spark, sf_dir)))


def _select(sql: str, over: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _Attached(spark, sf_dir).frame(sql)
        return found.selectExpr(*(f"{over[c]} AS {c}" if c in over else c for c in found.columns)) if over else found

    return run


def _inserted(table: str, sql: str, columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """Load a copy of a table in bulk, insert into it, flush, and read it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, scratch(spark))
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        db.create_table(table_of(table, rows.schema, (Key("__primary__", (rows.columns[0],), True),)))
        db.append(table, rows)
        connection = db.connect()
        connection.query(sql)
        db.flush()
        return connection.frame(f"SELECT {columns} FROM {table}")

    return run


def _loaded(spark: SparkSession, sf_dir: str, table: str, keys: tuple[Key, ...]) -> Database:
    """A database of its own with a stored copy of a table, flushed."""
    db = Database(spark, scratch(spark))
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    db.create_table(table_of(table, rows.schema, keys))
    db.append(table, rows)
    db.flush()
    return db


_CUSTOMER = (Key("__primary__", ("c_custkey",), True), Key("by_nation", ("c_nationkey",)))


def _stored(sql: str, keys: tuple[Key, ...] = _CUSTOMER) -> Callable[[SparkSession, str], DataFrame]:
    """A SELECT over a stored copy of customer, whose files are sorted by key and have Bloom filters."""
    return lambda spark, sf_dir: _loaded(spark, sf_dir, "customer", keys).connect().frame(sql)


def _rejected(db: Database, sql: str) -> None:
    try:
        db.connect().query(sql)
    except ConstraintError:
        return
    raise AssertionError(f"accepted: {sql}")


def _pk_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that repeat a key in themselves, of a stored row or of a pending one leave nothing; the others stay."""
    db = _loaded(spark, sf_dir, "nation", (Key("__primary__", ("n_nationkey",), True),))
    _rejected(db, "INSERT INTO nation VALUES (200, 'A', 0), (200, 'B', 0)")
    _rejected(db, "INSERT INTO nation VALUES (201, 'A', 0), (3, 'B', 0)")
    db.connect().query("INSERT INTO nation VALUES (202, 'C', 1)")
    _rejected(db, "INSERT INTO nation VALUES (202, 'D', 1)")
    db.flush()
    _rejected(db, "INSERT INTO nation VALUES (202, 'D', 1)")
    return db.connect().frame("SELECT n_nationkey, n_name FROM nation")


def _seen_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of a third each, two of them flushed."""
    db = Database(spark, scratch(spark))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    db.create_table(table_of("customer", rows.schema, _CUSTOMER))
    for k in range(3):
        db.append("customer", rows.where(f"c_custkey % 3 = {k}"))
        if k == 1:
            db.flush()
    return db.connect().frame("SELECT c_custkey, c_acctbal FROM customer")


def _created_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is made, filled, dropped and made again with other columns."""
    db = Database(spark, scratch(spark))
    for sql in ("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR)", "INSERT INTO t VALUES (1, 'x')", "DROP TABLE t", "CREATE TABLE t (a BIGINT, c DOUBLE, KEY(a))", "INSERT INTO t (a) VALUES (-9223372036854775808), (9223372036854775807)"):
        db.connect().query(sql)
    db.flush()
    return db.connect().frame("SELECT a, c FROM t")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in a table of many batches that were made one."""
    db = Database(spark, scratch(spark))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    db.create_table(table_of("customer", rows.schema, _CUSTOMER))
    for k in range(4):
        db.append("customer", rows.where(f"c_custkey % 4 = {k}"))
    db.flush()
    db.catalog.compact("customer", 20_000)
    return db.connect().frame("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey >= 40 AND c_custkey <= 60")


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their places in a stored table of one file, which is sorted by its key."""
    db = Database(spark, scratch(spark))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1)
    db.create_table(table_of("nation", rows.schema, (Key("__primary__", ("n_nationkey",), True),)))
    db.append("nation", rows)
    db.flush()
    return db.gather("nation", [3, 0, 24, 3], ["n_name"])


def _modes_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a grouping in each mode, and whether digests are the same in all."""
    connection = _Attached(spark, sf_dir)
    sql, found = "SELECT l_orderkey, COUNT(*) AS c FROM lineitem GROUP BY l_orderkey", []
    for mode in ("auto", "single", "multi"):
        connection.database.config = Config(mode, 3)
        found.append((mode, connection.query(sql).digest()))
    return spark.createDataFrame([(mode, d.row_count, d == found[0][1]) for mode, d in found], "mode string, n bigint, same boolean")


_ACCESS = {
    "SELECT * FROM orders WHERE o_orderkey = 42": "IndexScan(__primary__)",
    "SELECT * FROM orders WHERE 42 = o_orderkey AND o_custkey = 7": "IndexScan(__primary__)",
    "SELECT * FROM orders WHERE o_custkey = 7 AND o_totalprice > 5": "IndexScan(by_customer)",
    "SELECT * FROM orders WHERE o_orderkey = 1.5": "SeqScan",
    "SELECT * FROM orders WHERE o_orderkey = 42.0": "IndexScan(__primary__)",
    "SELECT * FROM orders WHERE o_orderkey > 42": "SeqScan",
    "SELECT * FROM lineitem WHERE l_orderkey = 10": "SeqScan",
    "SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_orderkey = 10": "IndexScan(by_line)",
}


def _access_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    connection = _Attached(spark, sf_dir)
    return spark.createDataFrame([(sql, str(connection.access(sql))) for sql in _ACCESS], "statement string, path string")


def _pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_orderkey", "l_linenumber"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _select(sql, over) for name, (sql, over, _) in CATALOGUE.items()} | {
    "insert_then_scan": _inserted("nation", "INSERT INTO nation VALUES (100, 'NEWLAND', 0)", "n_nationkey, n_name"),
    "insert_partial_zero_fill": _inserted("nation", "INSERT INTO nation (n_nationkey) VALUES (101)", "n_nationkey, n_name, n_regionkey"),
    "insert_const_arith": _inserted("region", "INSERT INTO region VALUES (1 + 98, 'R')", "r_regionkey, r_name"),
    "pk_duplicate_check": _pk_duplicates,
    "pk_rejections": _pk_rejections,
    "stored_pk_lookup": _stored("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42"),
    "stored_pk_fractional_literal": _stored("SELECT c_custkey FROM customer WHERE c_custkey = 42.5"),
    "stored_secondary_lookup": _stored("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0"),
    "stored_composite_lookup": _stored("SELECT c_name FROM customer WHERE c_custkey = 42 AND c_mktsegment >= 'A' AND c_nationkey >= 0", (Key("__primary__", ("c_nationkey", "c_custkey"), True),)),
    "stored_group": _stored("SELECT c_mktsegment, COUNT(*) AS c, MIN(c_custkey) AS k FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment"),
    "load_in_parts": _seen_in_parts,
    "create_drop_create": _created_anew,
    "stored_compacted": _compacted,
    "stored_gather": _gathered,
    "generated_bench": lambda spark, sf_dir: bench_table(spark, 3000),
    "modes_agree": _modes_agree,
    "access_paths": _access_paths,
}
ORACLE_SQL: dict[str, str] = {name: oracle or sql for name, (sql, _, oracle) in CATALOGUE.items()} | {
    "insert_then_scan": "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'NEWLAND'",
    "insert_partial_zero_fill": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 101, '', 0",
    "insert_const_arith": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 1 + 98, 'R'",
    "pk_duplicate_check": "SELECT l_orderkey, l_linenumber, COUNT(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
    "pk_rejections": "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 202, 'C'",
    "stored_pk_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "stored_pk_fractional_literal": "SELECT c_custkey FROM customer WHERE c_custkey = 42.5",
    "stored_secondary_lookup": "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0",
    "stored_composite_lookup": "SELECT c_name FROM customer WHERE c_custkey = 42 AND c_mktsegment >= 'A' AND c_nationkey >= 0",
    "stored_group": "SELECT c_mktsegment, COUNT(*) AS c, MIN(c_custkey) AS k FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment",
    "load_in_parts": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 < 2",
    "create_drop_create": "SELECT * FROM (VALUES (CAST(-9223372036854775808 AS BIGINT), CAST(0 AS DOUBLE)), (9223372036854775807, 0)) AS t(a, c)",
    "stored_compacted": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey >= 40 AND c_custkey <= 60",
    "stored_gather": "SELECT CAST(k AS BIGINT) AS \"offset\", n_name FROM (VALUES (3), (0), (24), (3)) AS v(k) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation) ON place = k",
    "generated_bench": "SELECT i AS id, CAST(i % 1024 AS INT) AS grp, CAST(i % 65536 AS INT) AS grp_hi, CAST((i * 48271) % 1000003 AS DOUBLE) / 1000003.0::DOUBLE AS value FROM range(3000) AS r(i)",
    "modes_agree": "SELECT m AS mode, n, true AS same FROM (VALUES ('auto'), ('single'), ('multi')) AS v(m), (SELECT COUNT(DISTINCT l_orderkey) AS n FROM lineitem)",
    "access_paths": "SELECT * FROM (VALUES " + ", ".join(f"('{sql}', '{path}')" for sql, path in _ACCESS.items()) + ") AS v(statement, path)",
}
