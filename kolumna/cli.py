"""A small shell: ``python -m kolumna --db FOLDER``; statements come from the arguments or from standard input."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator

from kolumna.database import Config, Connection, Database, Result
from kolumna.errors import EngineError
from kolumna.schema import table_of
from kolumna.session import session
from kolumna.sources import scan_table

ROWS_SHOWN = 100


def show(result: Result, silent: bool, with_digest: bool) -> None:
    if result.kind == "EXPLAIN":
        print(result.text)
    elif result.frame is None:
        print(f"{result.kind}: {result.affected_rows} rows")
    else:
        if not silent:
            print(" | ".join(f"{c.name} {c.type.value}" for c in result.columns))
            rows = result.frame.take(ROWS_SHOWN + 1)
            for row in rows[:ROWS_SHOWN]:
                print(" | ".join(map(str, row)))
            if len(rows) > ROWS_SHOWN:
                print("...")
        if with_digest:
            print(f"digest {result.digest()}")


def run(connection: Connection, sql: str, silent: bool, with_digest: bool) -> bool:
    began = time.time()
    try:
        show(connection.query(sql), silent, with_digest)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return False
    print(f"{time.time() - began:.3f} s", file=sys.stderr)
    return True


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kolumna", description=__doc__)
    p.add_argument("--db", required=True, help="folder of the database, in any store that Spark reads")
    p.add_argument("--master", help="for a session without a cluster, such as local[4]")
    p.add_argument("--threads", type=int, help="the same as --master local[THREADS]")
    p.add_argument("--mode", choices=("auto", "single", "multi"), default="auto")
    p.add_argument("--partitions", type=int, help="tasks of a result that run at a time in mode multi")
    p.add_argument("--gen-table", metavar="NAME", help="make a table (id BIGINT, value DOUBLE) first")
    p.add_argument("--rows", type=int, default=4_000_000, help="rows of that table")
    p.add_argument("--load-batch", type=int, metavar="N", help="append that table N rows at a time; all at once by default")
    p.add_argument("--unlock", metavar="NAME", help="remove the lock of a table whose writer was lost")
    p.add_argument("--compact", metavar="NAME", help="make few files of a table's many first")
    p.add_argument("--drop-table", metavar="NAME", help="drop a table first")
    p.add_argument("--silent", action="store_true", help="do not show rows")
    p.add_argument("--digest", action="store_true", help="show a digest of each result")
    p.add_argument("sql", nargs="*", help="statements; without any they are read from standard input, one a line; a terminal gets a prompt")
    a = p.parse_args(arguments)
    master = a.master or (f"local[{a.threads}]" if a.threads else None)
    with Database(session(master), a.db, Config(a.mode, a.partitions)) as db:
        if a.unlock:
            db.unlock(a.unlock)
        if a.compact:
            db.compact(a.compact)
        if a.drop_table:
            db.drop_table(a.drop_table)
        if a.gen_table:
            rows = scan_table(db.spark, a.rows)
            db.create_table(table_of(a.gen_table, rows.schema))
            step = a.load_batch or max(a.rows, 1)
            print(f"{sum(db.append(a.gen_table, rows.where(f'id >= {k} and id < {k + step}')) for k in range(0, max(a.rows, 1), step))} rows")
            db.flush(a.gen_table)
        connection = db.connect()
        good = [run(connection, line, a.silent, a.digest) for line in a.sql or _lines() if line.strip()]
    return int(not all(good))


def _lines() -> Iterator[str]:
    """Statements from standard input, after a prompt at a terminal, until its end or ``exit``."""
    asks = sys.stdin.isatty()
    while True:
        if asks:
            print("kolumna> ", end="", file=sys.stderr, flush=True)
        line = sys.stdin.readline()
        if not line or line.strip().rstrip(";").lower() in ("exit", "quit"):
            return
        yield line
