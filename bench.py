"""Headline queries, timed: one JSON line.

q1 to q7 run over a table of BENCH_ROWS rows (16,777,216 by default) that the
engine stores first; the rest over the tables in BENCH_SF_DIR.  Each figure is
the median of several runs after a warm-up, each from a prepared statement to
its result.  "queries" has rows held hot, as in memory-resident engines;
"stored" reads the engine's own Parquet table for each run.  "medium" and
"medium_stored" are the same for BENCH_MEDIUM_ROWS rows (4,194,304 by default;
0 leaves them out) and do not count in "value"."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame

from kolumna import queries
from kolumna.database import Database
from kolumna.schema import table_of
from kolumna.session import session
from kolumna.sources import bench_table

CPUS = os.environ.get("BENCH_CPUS", "8")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
ROWS = int(os.environ.get("BENCH_ROWS", 16_777_216))
MEDIUM_ROWS = int(os.environ.get("BENCH_MEDIUM_ROWS", 4_194_304))
WARM, REPEATS = int(os.environ.get("BENCH_WARM", 12)), int(os.environ.get("BENCH_REPEATS", 11))

BENCH = {
    "q1": "SELECT SUM(value) FROM bench",
    "q2": "SELECT COUNT(*), SUM(value) FROM bench WHERE value > 0.5",
    "q3": "SELECT COUNT(*), SUM(value) FROM bench WHERE value > 0.1",
    "q4": "SELECT COUNT(*), SUM(value) FROM bench WHERE value > 0.99",
    "q5": "SELECT SUM(id + 1) FROM bench",
    "q6": "SELECT grp, COUNT(*), SUM(value) FROM bench GROUP BY grp",
    "q7": "SELECT grp_hi, COUNT(*), SUM(value) FROM bench GROUP BY grp_hi",
}
CATALOGUE = ("flagship", "bench_q2_filter_agg", "group_low", "group_high", "index_pk_hit", "filter_mixed_parens", "group_filtered_events")


def seconds(run) -> float:
    for _ in range(WARM):
        run()
    took = []
    for _ in range(REPEATS):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return statistics.median(took)


def quietly(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def over(db: Database, n: int, parts: int) -> tuple[dict[str, float], dict[str, float]]:
    """Seconds of q1 to q7 over n rows, held hot and as the engine stored them."""
    rows = bench_table(db.spark, n).repartition(parts).select("id", "grp", "grp_hi", "value")
    name = f"bench_{n}"
    db.create_table(table_of(name, rows.schema))
    db.append(name, rows)
    db.flush()
    hot = db.catalog.rows(name).cache()
    hot.count()
    db.attach(f"hot_{n}", hot)
    both, connection = [], db.connect()
    for source in (f"hot_{n}", name):
        figures = {}
        for query, sql in BENCH.items():
            prepared = connection.prepare(sql.replace("FROM bench", f"FROM {source}"))
            # Each run plans anew and does all the work: a frame that has run once would begin at its last shuffle.
            # Counting the result's rows on the executors keeps their transfer out of the figure for q6 and q7.
            figures[query] = seconds(lambda: connection.execute(prepared).frame.collect() if query < "q6" else quietly(connection.execute(prepared).frame))
        both.append(figures)
        hot.unpersist(blocking=True)  # else Spark would answer for the stored rows from memory
    return both[0], both[1]


def main() -> None:
    parts = str(max(1, int(CPUS)))
    spark = session(
        f"local[{CPUS}]", "bench", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=parts, spark__driver__memory="8g",
        spark__sql__files__maxPartitionBytes="16m", spark__sql__files__openCostInBytes="1m", spark__log__level="ERROR", spark__sql__inMemoryColumnarStorage__compressed="false", spark__sql__inMemoryColumnarStorage__batchSize="65536",
    )
    root = tempfile.mkdtemp(prefix="kolumna-bench-")
    try:
        db = Database(spark, root)
        medium, medium_stored = over(db, MEDIUM_ROWS, int(parts)) if MEDIUM_ROWS else ({}, {})
        found, stored = over(db, ROWS, int(parts))
        for name in CATALOGUE:
            frame = queries.QUERIES[name](spark, SF_DIR)
            found[name] = seconds(lambda: quietly(frame))  # a write plans and runs all of it anew
    finally:
        shutil.rmtree(root, ignore_errors=True)
    short = lambda figures: {k: round(v, 4) for k, v in figures.items()}
    rate = lambda figures, rows: {k: round(rows / figures[k]) for k in BENCH if k in figures}
    print(json.dumps({
        "metric": "sum of the queries' median seconds", "value": round(sum(found.values()), 4), "unit": "sec", "queries": short(found), "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "bench_rows": ROWS, "rows_per_sec": rate(found, ROWS), "stored": short(stored), "medium_rows": MEDIUM_ROWS, "medium": short(medium), "medium_rows_per_sec": rate(medium, MEDIUM_ROWS), "medium_stored": short(medium_stored),
    }))


if __name__ == "__main__":
    main()
