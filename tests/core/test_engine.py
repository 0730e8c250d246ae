import math

import pytest
from pyspark.sql import functions as F

from kolumna.database import Config, Database
from kolumna.errors import BindError, ConstraintError
from kolumna.schema import Column, DataType, Key, Table, table_of
from kolumna.sources import bench_table, goods_table, scan_table


@pytest.fixture
def db(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as d:
        yield d


@pytest.fixture
def ships(db):
    c = db.connect()
    c.query("CREATE TABLE ships (id INT PRIMARY KEY, tons INT, port VARCHAR, KEY by_tons(tons))")
    c.query("INSERT INTO ships VALUES (1, 20, 'x'), (2, 30, 'y'), (3, 30, 'z'), (4, 40, 'x')")
    db.flush()
    return c


def rows(c, sql):
    return sorted(map(tuple, c.query(sql).rows()))


def agg_t(db, n=3000, partitions=3):
    c = db.connect()
    c.query("CREATE TABLE agg_t (id INT, g INT, value DOUBLE)")
    if n:
        i = F.col("id")
        db.append("agg_t", db.spark.range(0, n, 1, partitions).select(i.cast("int").alias("id"), (i % 7).cast("int").alias("g"), (i * 0.5 + 1).alias("value")))
        db.flush()
    return c


def test_aggregates_of_an_empty_table_are_one_row_of_zeros(db):
    c = agg_t(db, 0)
    assert rows(c, "SELECT COUNT(*), SUM(id), AVG(value), MIN(id), MAX(value) FROM agg_t") == [(0, 0.0, 0.0, 0, 0.0)]
    assert rows(c, "SELECT g, COUNT(*) FROM agg_t GROUP BY g") == []


def test_aggregates_by_hand(db):
    c = agg_t(db)
    total = sum(range(3000))
    assert rows(c, "SELECT COUNT(*), COUNT(id), SUM(id), SUM(id + 1), MIN(id), MAX(id) FROM agg_t") == [(3000, 3000, float(total), float(total + 3000), 0, 2999)]
    assert rows(c, "SELECT AVG(value) FROM agg_t")[0][0] == pytest.approx(total * 0.5 / 3000 + 1)
    assert rows(c, "SELECT SUM(id), MIN(id) FROM agg_t WHERE id < 0") == [(0.0, 0)]
    assert rows(c, "SELECT g, COUNT(*) FROM agg_t WHERE id < 0 GROUP BY g") == []
    assert rows(c, "SELECT g, COUNT(*) FROM agg_t GROUP BY g") == [(g, len(range(g, 3000, 7))) for g in range(7)]
    assert rows(c, "SELECT id > 10, COUNT(*) FROM agg_t GROUP BY id > 10") == [(0, 11), (1, 2989)]
    assert rows(c, "SELECT MIN(g) FROM agg_t WHERE g = 9") == [(0,)]


def test_same_results_in_every_mode_and_partitioning(spark, tmp_path):
    seen = []
    for k, (mode, parts) in enumerate((("auto", 1), ("single", 3), ("multi", 7))):
        with Database(spark, str(tmp_path / f"d{k}"), Config(mode, 4)) as d:
            c = agg_t(d, 15_000, parts)
            seen.append((rows(c, "SELECT g, COUNT(*), SUM(value), AVG(value) FROM agg_t WHERE id >= 100 GROUP BY g"), c.query("SELECT id, g FROM agg_t").digest()))
    for other in seen[1:]:
        assert other[1] == seen[0][1]
        for a, b in zip(seen[0][0], other[0]):
            assert a[:2] == b[:2] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[2:], b[2:]))


def test_no_mode_gathers_a_result_in_few_tasks(db, monkeypatch):
    """Single runs a result's tasks one by one, multi so many at a time, and none reads more than its partition."""
    spark, jobs = db.spark, []
    c = agg_t(db, 15_000, 5)
    run = type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda self, rdd, f, partitions=None, *a: jobs.append(partitions) or run(self, rdd, f, partitions, *a))
    sql = "SELECT id, COUNT(*) FROM agg_t GROUP BY id"
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {}
        for mode in ("auto", "single", "multi"):
            db.config = Config(mode, 3)
            result = c.query(sql)
            assert result.frame.rdd.getNumPartitions() == 4
            jobs.clear()
            found[mode] = result.digest(), sorted(map(tuple, result.rows()))
            assert jobs == 2 * {"auto": [], "single": [[0], [1], [2], [3]], "multi": [[0, 1, 2], [3]]}[mode]
            assert sum(map(len, c.query(sql).batches(500))) == 15_000
            assert str(c.query("SELECT id, g FROM agg_t WHERE id < 0").digest()) == f"0:{0:016x}:{0:016x}"
            assert c.query("SELECT COUNT(*), MAX(id) FROM agg_t").digest() == found.setdefault("global", c.query("SELECT COUNT(*), MAX(id) FROM agg_t").digest())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found["single"] == found["multi"] == found["auto"] and found["auto"][0].row_count == 15_000


def test_types_of_results(ships):
    r = ships.query("SELECT id, id + 1.5, tons > 1, port, COUNT(*), SUM(tons), MIN(port) FROM ships GROUP BY id, id + 1.5, tons > 1, port")
    assert [c.type.value for c in r.columns] == ["INT", "DOUBLE", "INT", "VARCHAR", "BIGINT", "DOUBLE", "VARCHAR"]
    assert [f.dataType.simpleString() for f in r.frame.schema] == ["int", "double", "int", "string", "bigint", "double", "string"]


def test_left_side_gives_the_type_of_a_sum(db):
    c = db.connect()
    db.create_table(Table("t", (Column("i", DataType.INT), Column("b", DataType.BIGINT), Column("f", DataType.FLOAT))))
    db.append("t", db.spark.createDataFrame([(1, 5, 2.5)], db.catalog.find("t").struct))
    db.flush()
    r = c.query("SELECT i + b AS x, b + i AS y, f + i AS z, i + f AS w FROM t")
    assert [x.type.value for x in r.columns] == ["INT", "BIGINT", "FLOAT", "INT"]
    assert tuple(r.rows()[0]) == (6, 6, 3.5, 3)


def test_insert_is_seen_after_flush_only_and_stays(spark, tmp_path):
    root = str(tmp_path / "db")
    with Database(spark, root) as d:
        c = d.connect()
        c.query("CREATE TABLE t (a INT, b INT, s VARCHAR, x DOUBLE)")
        assert c.query("INSERT INTO t (b) VALUES (1 + 2), (9 - 10)").affected_rows == 2
        assert rows(c, "SELECT * FROM t") == []
    with Database(spark, root) as d:
        assert rows(d.connect(), "SELECT * FROM t") == [(0, -1, "", 0.0), (0, 3, "", 0.0)]


def test_primary_key_is_unique_in_and_across_batches(ships, db):
    with pytest.raises(ConstraintError):
        ships.query("INSERT INTO ships VALUES (9, 1, 'a'), (9, 2, 'b')")
    with pytest.raises(ConstraintError):
        ships.query("INSERT INTO ships VALUES (8, 1, 'a'), (1, 2, 'b')")
    ships.query("INSERT INTO ships VALUES (10, 1, 'a')")
    with pytest.raises(ConstraintError):  # against rows that are not flushed yet
        ships.query("INSERT INTO ships VALUES (10, 1, 'a')")
    db.flush()
    assert len(rows(ships, "SELECT id FROM ships")) == 5


def test_composite_and_string_keys(db):
    c = db.connect()
    c.query("CREATE TABLE berths (dock VARCHAR, slot INT, depth DOUBLE, metres INT, PRIMARY KEY(dock, slot), KEY by_depth(depth, metres))")
    c.query("INSERT INTO berths VALUES ('north', 7, 11.5, 90), ('north', 8, 11.5, 60), ('south', 7, 4.0, 60)")
    with pytest.raises(ConstraintError):
        c.query("INSERT INTO berths VALUES ('west', 1, 3.0, 20), ('south', 7, 9.0, 10)")
    c.query("INSERT INTO berths VALUES ('south', 8, 9.0, 10)")
    c.query("CREATE TABLE flags (code VARCHAR PRIMARY KEY, stripes INT)")
    c.query("INSERT INTO flags VALUES ('quebec', 0), ('', 3)")
    with pytest.raises(ConstraintError):
        c.query("INSERT INTO flags VALUES ('', 5)")
    with pytest.raises(ConstraintError):
        c.query(f"INSERT INTO flags VALUES ('{'é' * 31}', 2)")
    c.query(f"INSERT INTO flags VALUES ('{'é' * 30}', 2)")


def test_duplicates_are_rejected_after_reopening(spark, tmp_path):
    root = str(tmp_path / "db")
    with Database(spark, root) as d:
        d.connect().query("CREATE TABLE t (a INT PRIMARY KEY)")
        d.connect().query("INSERT INTO t VALUES (1)")
    with Database(spark, root) as d, pytest.raises(ConstraintError):
        d.connect().query("INSERT INTO t VALUES (1)")


def test_access_paths(db, ships):
    access = lambda sql: str(ships.access(sql))
    assert access("SELECT * FROM ships WHERE id = 1") == "IndexScan(__primary__)"
    assert access("SELECT * FROM ships WHERE 1 = id AND port = 'x'") == "IndexScan(__primary__)"
    assert access("SELECT * FROM ships WHERE tons = 30 AND id > 1") == "IndexScan(by_tons)"
    assert access("SELECT * FROM ships WHERE id = 1 OR tons = 2") == "SeqScan"
    assert access("SELECT * FROM ships WHERE id > 1") == "SeqScan"
    assert access("SELECT * FROM ships WHERE id = 1.5") == access("SELECT * FROM ships WHERE id = 99999999999") == "SeqScan"
    assert access("SELECT * FROM ships WHERE id = 1.0") == "IndexScan(__primary__)"
    ships.query("CREATE TABLE legs (voyage BIGINT, leg INT, miles DOUBLE, PRIMARY KEY(voyage, leg), KEY by_miles(miles))")
    assert access("SELECT * FROM legs WHERE voyage = 1") == "SeqScan"
    assert access("SELECT * FROM legs WHERE leg = 4 AND miles > 3.5 AND voyage = 10") == "IndexScan(__primary__)"
    assert access("SELECT leg FROM legs WHERE 12.5 = miles AND leg = 2") == "IndexScan(by_miles)"
    ships.query("CREATE TABLE flags (code VARCHAR PRIMARY KEY, stripes INT)")
    assert access("SELECT * FROM flags WHERE code = 'quebec'") == "SeqScan"
    assert rows(ships, "SELECT id FROM ships WHERE id = 1.5") == []
    assert rows(ships, "SELECT id FROM ships WHERE tons = 30 AND id > 2") == [(3,)]


def test_conditions_reach_the_scan_and_columns_are_pruned(ships):
    plan = ships.query("EXPLAIN SELECT id FROM ships WHERE id > 2.5 AND tons <= 30").text
    assert "PushedFilters: [IsNotNull(id), IsNotNull(tons), GreaterThan(id,2), LessThanOrEqual(tons,30)]" in plan
    assert "ReadSchema: struct<id:int,tons:int>" in plan


def test_aggregates_are_partial_before_the_exchange(ships):
    plan = ships.query("EXPLAIN SELECT tons, COUNT(*) FROM ships GROUP BY tons").text
    assert plan.count("Exchange") and "partial_count" in plan


@pytest.mark.parametrize("op,number", [(o, n) for o in ("=", "!=", "<", "<=", ">", ">=") for n in ("2", "2.5", "-2.5", "2.0", "9007199254740993", "0.5", "9223372036854775807.0", "-99999999999999999999999.0")])
def test_whole_numbers_against_any_literal(db, op, number):
    from fractions import Fraction

    values = [-3, -2, 0, 1, 2, 3, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]
    db.attach("n", db.spark.createDataFrame([(v,) for v in values], "v bigint"))
    exact = Fraction(float(number)) if "." in number else Fraction(number)
    want = [v for v in values if {"=": v == exact, "!=": v != exact, "<": v < exact, "<=": v <= exact, ">": v > exact, ">=": v >= exact}[op]]
    assert [r[0] for r in rows(db.connect(), f"SELECT v FROM n WHERE v {op} {number}")] == sorted(want)
    if not number.startswith("-"):
        flip = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
        assert [r[0] for r in rows(db.connect(), f"SELECT v FROM n WHERE {number} {flip} v")] == sorted(want)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT nope FROM ships", "SELECT * FROM nope", "SELECT id, * FROM ships", "SELECT id, COUNT(*) FROM ships", "SELECT SUM(id) + 1 FROM ships", "SELECT id FROM ships WHERE SUM(id) > 1", "SELECT SUM(SUM(id)) FROM ships",
        "SELECT SUM(port) FROM ships", "SELECT id FROM ships WHERE port > 1", "SELECT port + 1 FROM ships", "SELECT ID FROM ships", "INSERT INTO ships VALUES (1, 2)", "INSERT INTO ships VALUES (1.0, 2, 'a')", "INSERT INTO ships VALUES (1, 2, 3)",
        "INSERT INTO ships (id, id) VALUES (1, 2)", "INSERT INTO ships (id) VALUES (tons + 1)", "INSERT INTO ships (id) VALUES (2147483647 + 1)", "CREATE TABLE ships (a INT)", "CREATE TABLE q (a INT, a INT)", "CREATE TABLE q (a TEXT)",
        "CREATE TABLE q (a INT PRIMARY KEY, PRIMARY KEY(a))", "CREATE TABLE q (a INT, KEY(b))", "CREATE TABLE q (a INT, KEY(a, a))", "CREATE TABLE q (a INT, KEY k(a), KEY k(a))", "DROP TABLE nope",
    ],
)
def test_bind_errors(ships, sql):
    with pytest.raises(BindError):
        ships.query(sql).rows()


def test_drop_and_create_again(ships, db):
    ships.query("DROP TABLE ships")
    with pytest.raises(BindError):
        ships.query("SELECT * FROM ships")
    ships.query("CREATE TABLE ships (a INT)")
    assert rows(ships, "SELECT * FROM ships") == []


def test_one_writer_at_a_time(db, ships):
    with db.catalog._writing("ships"), pytest.raises(ConstraintError):
        ships.query("INSERT INTO ships VALUES (77, 1, 'a')")
    ships.query("INSERT INTO ships VALUES (77, 1, 'a')")


def test_the_lock_of_a_lost_writer_is_named_and_can_be_removed(db, ships):
    writing = db.catalog._writing("ships")
    writing.__enter__()
    with pytest.raises(ConstraintError, match=r":\d+ since \d{4}-"):
        ships.query("INSERT INTO ships VALUES (77, 1, 'a')")
    db.unlock("ships")
    ships.query("INSERT INTO ships VALUES (77, 1, 'a')")


def test_compaction_keeps_rows_and_survives_crashes(spark, tmp_path):
    root = str(tmp_path / "db")
    with Database(spark, root) as d:
        c = d.connect()
        c.query("CREATE TABLE t (a INT PRIMARY KEY, s VARCHAR, KEY by_s(s))")
        for k in range(5):
            d.append("t", spark.range(k, 500, 5).select(F.col("id").cast("int").alias("a"), F.lit(f"s{k}").alias("s")))
        d.flush()
        before = d.connect().query("SELECT * FROM t").digest()
        assert len(d.catalog.files.names(f"{root}/t/rows")) == 5
        d.catalog.compact("t", 1500)
        assert d.connect().query("SELECT * FROM t").digest() == before
        assert len(d.catalog.files.names(f"{root}/t/rows")) == 1 and d.catalog.files.names(f"{root}/t") == ["pending", "rows"]
        files = [r[0] for r in d.catalog.rows("t").groupBy(F.col("_metadata.file_path")).agg(F.struct(F.min("a"), F.max("a")).alias("r")).select("r").collect()]
        ends = sorted(map(tuple, files))
        assert len(ends) > 1 and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))  # a range of keys each
        with pytest.raises(ConstraintError):
            c.query("INSERT INTO t VALUES (7, 'again')")
    for left in (("rows", "_merged"), ("rows", "_before")):  # before the swap; within it
        (tmp_path / "db" / "t" / left[0]).rename(tmp_path / "db" / "t" / left[1])
        with Database(spark, root) as d:
            assert d.connect().query("SELECT * FROM t").digest() == before and d.catalog.files.names(f"{root}/t") == ["pending", "rows"]
    (tmp_path / "db" / "t" / "_before").mkdir()
    (tmp_path / "db" / "t" / "_merged").mkdir()
    with Database(spark, root) as d:
        assert d.connect().query("SELECT * FROM t").digest() == before and d.catalog.files.names(f"{root}/t") == ["pending", "rows"]


def test_rows_by_their_places(db, ships):
    ships.query("INSERT INTO ships VALUES (9, 1, 'n')")
    db.flush()
    assert sorted(map(tuple, db.gather("ships", [4, 0, 4]).collect())) == [(0, 1, 20, "x"), (4, 9, 1, "n"), (4, 9, 1, "n")]
    assert db.gather("ships", [], ["id"]).columns == ["offset", "id"] and db.gather("ships", []).collect() == []
    assert sorted(map(tuple, db.gather("ships", [3, 2], ["port", "id"]).collect())) == [(2, "z", 3), (3, "x", 4)]
    for wrong in ([5], [-1], [0, 99]):
        with pytest.raises(ConstraintError):
            db.gather("ships", wrong)
    with pytest.raises(BindError):
        db.gather("ships", [0], ["nope"])
    ships.query("CREATE TABLE none (a INT)")
    with pytest.raises(ConstraintError):
        db.gather("none", [0])


def test_sums_beyond_bigint(db):
    db.attach("w", db.spark.createDataFrame([(2**62, 1), (2**62, 1), (2**62, 2)], "v bigint, g int"))
    c = db.connect()
    assert rows(c, "SELECT SUM(v), SUM(g) FROM w") == [(3.0 * 2**62, 4.0)]
    assert rows(c, "SELECT g, SUM(v) FROM w GROUP BY g") == [(1, 2.0**63), (2, 2.0**62)]
    assert rows(c, "SELECT SUM(v) FROM w WHERE g > 5") == [(0.0,)]


def test_the_least_bigint_is_a_literal(db):
    from kolumna.errors import ParseError

    db.attach("w", db.spark.createDataFrame([(-(2**63),), (5,)], "v bigint"))
    assert rows(db.connect(), "SELECT v FROM w WHERE v = -9223372036854775808") == [(-(2**63),)]
    with pytest.raises(ParseError):
        db.connect().query("SELECT 9223372036854775808 FROM w")
    with pytest.raises(ParseError):
        db.connect().query("SELECT -9223372036854775809 FROM w")


def test_a_catalog_is_there_at_every_moment_of_its_replacement(db, ships):
    names = db.catalog.files.names(db.catalog.root)
    assert "catalog.json" in names and "catalog.json.new" not in names


def test_keys_of_a_batch_are_conditions_at_the_scan_of_stored_rows(db, ships):
    def plan(sql_rows):
        batch = db.spark.createDataFrame(sql_rows, db.catalog.find("ships").struct).select("id")
        found = db.catalog._stored_with(db.catalog.find("ships"), batch, len(sql_rows))
        return found, found._jdf.queryExecution().explainString(db.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    found, text = plan([(2, 1, "a"), (9, 1, "a")])
    assert [r[0] for r in found.collect()] == [2]
    assert "GreaterThanOrEqual(id,2)" in text and "LessThanOrEqual(id,9)" in text and "In(id, [2,9])" in text and "BroadcastHashJoin" in text
    assert plan([(k, 1, "a") for k in range(3, 60)])[0].count() == 2


def test_prepared_statements_see_later_rows_and_consumers_get_batches(ships, db):
    p = ships.prepare("SELECT id FROM ships")
    assert len(ships.execute(p).rows()) == 4
    ships.query("INSERT INTO ships VALUES (5, 1, 'a')")
    db.flush()
    got = []
    assert ships.execute(p, got.append, size=2).affected_rows == 5
    assert sorted(r[0] for b in got for r in b) == [1, 2, 3, 4, 5] and max(map(len, got)) <= 2


def test_digest_ignores_order_and_tells_repetition(spark):
    from kolumna.digest import digest

    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    assert digest(a) == digest(a.orderBy(F.desc("x")).repartition(3))
    assert digest(a) != digest(a.distinct()) and digest(a.limit(0)).row_count == 0


def test_a_followed_table_counts_flushed_batches(ships, db, tmp_path):
    from kolumna.streaming import follow

    q = follow(db.catalog, "SELECT tons, COUNT(*) AS c FROM ships WHERE id > 1 GROUP BY tons").writeStream.outputMode("complete").format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, db.spark.table("followed").collect())) == [(30, 2), (40, 1)]
        ships.query("INSERT INTO ships VALUES (6, 40, 'q')")
        db.flush()
        q.processAllAvailable()
        assert sorted(map(tuple, db.spark.table("followed").collect())) == [(30, 2), (40, 2)]
    finally:
        q.stop()


def test_generators_are_the_same_at_any_partitioning(spark):
    from kolumna.digest import digest

    for t in (scan_table(spark, 5000), bench_table(spark, 5000), goods_table(spark, 2000)):
        assert digest(t) == digest(t.repartition(7))
    v = bench_table(spark, 3).collect()
    assert [(r.id, r.grp, r.grp_hi, r.value) for r in v] == [(i, i, i, ((i * 48271) % 1000003) / 1000003.0) for i in range(3)]


def test_attached_tables_are_read_only(spark, db):
    db.attach("b", bench_table(spark, 100), (Key("__primary__", ("id",), True),))
    assert rows(db.connect(), "SELECT COUNT(*), SUM(id + 1) FROM b") == [(100, 5050.0)]
    with pytest.raises(BindError):
        db.append("b", bench_table(spark, 1))
    assert table_of("b", bench_table(spark, 1).schema).columns[0].type is DataType.BIGINT


def test_bulk_rows_must_fit_the_table(ships, db):
    with pytest.raises(BindError):
        db.append("ships", db.spark.range(3))
    with pytest.raises(ConstraintError):
        db.append("ships", db.spark.createDataFrame([(50, None, "a")], "id int, tons int, port string"))
    n = db.append("ships", db.spark.range(2_000, 102_000).select(F.col("id").cast("int").alias("id"), (F.col("id") % 9).cast("int").alias("tons"), F.lit("m").alias("port")))
    db.flush()
    assert n == 100_000 and rows(ships, "SELECT COUNT(*) FROM ships WHERE tons = 5") == [(11_111,)]


def test_command_line(spark, tmp_path, capsys):
    from kolumna.cli import main

    assert main(["--db", str(tmp_path / "c"), "--gen-table", "t", "--rows", "1000", "--digest", "SELECT COUNT(*) FROM t", "SELECT id FROM t WHERE id = 7"]) == 0
    out = capsys.readouterr().out
    assert "1000" in out and "digest 1:" in out
    assert main(["--db", str(tmp_path / "c"), "--gen-table", "u", "--rows", "250", "--load-batch", "100", "--unlock", "t", "SELECT COUNT(*) FROM u"]) == 0
    assert "250 rows" in capsys.readouterr().out
    assert main(["--db", str(tmp_path / "c"), "SELECT nope FROM t"]) == 1
