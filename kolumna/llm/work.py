"""Written work tables: results that later jobs read again without recomputing.

A table in the shared checkpoint folder survives lost executors, cuts the
lineage and is read by every job of a run.  The folder is the session's
``spark.checkpoint.dir``; where that is unset (tests, local sessions) a folder
of this process stands in.

Tables that an operator's result still reads are removed when the process of
the application's driver ends, the others on the way.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import pathlib
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolumna.session import shared_folder
from kolumna.sources.files import remove_at_exit


@functools.cache
def _own() -> str:
    path = tempfile.mkdtemp(prefix="kolumna-work-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def folder(spark: SparkSession) -> str:
    return shared_folder(spark) or _own()


#: Bytes of an Arrow batch on its way to Python. Spark's own limit is a number of rows, which long texts make large.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


_sent: set[str] = set()


def _send(spark: SparkSession) -> None:
    """Give this package to the application's Python workers, which may run where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    files = sorted(package.rglob("*.py"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    archive = f"{tempfile.mkdtemp(prefix='kolumna-package-')}/{package.name}-{mark}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in files:
            z.write(p, p.relative_to(package.parent).as_posix())
    sc.addPyFile(archive)
    _sent.add(sc.applicationId)


def modest(df: DataFrame) -> DataFrame:
    """``df``, ready for Python stages: its workers have this package, and from now on its session
    sends them batches of bounded size, unless its own bound is lower."""
    _send(df.sparkSession)
    conf = df.sparkSession.conf
    now = conf.get(_BATCH)
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind tables that are written: it does so once the driver's collector has found
    that nothing refers to them. The last execution is referred to until the next one, so that is a job of one row."""
    spark.range(1).collect()
    spark._jvm.System.gc()


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/kolumna-{tag}-{uuid.uuid4().hex}"
    for made in _open[-1:]:
        made.append(path)
    remove_at_exit(spark, path)
    release(spark)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Tables written since each :func:`settled` that is under way began.
_open: list[list[str]] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` gives, written and read back; the tables that were written on the way are removed."""
    _open.append([])
    kept = None
    try:
        found = saved(make(), tag)
        kept = _paths[found]
        return found
    finally:
        for path in _open.pop():
            if path != kept:
                _remove(spark, path)
        if kept and _open:
            _open[-1].append(kept)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Remove tables that :func:`saved` wrote and that no frame still to be run reads; other frames are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            _remove(table.sparkSession, path)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chance(key: Column, most: int, of: int) -> Column:
    """Whether a row falls in a sample of about nine tenths of ``most`` of ``of`` rows, by a hash of its key; all of them if they are no more than ``most``.

    No sort and no rows at the driver: the same rows are chosen however they are dealt."""
    if of <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < int(0.9 * most / of * (1 << 40))
