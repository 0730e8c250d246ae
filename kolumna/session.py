"""A Spark session with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic raises on overflow; names of columns tell case apart; AQE splits skewed joins.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; None on one machine that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "local") or "local"
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/") if found else None


def session(master: str | None = None, app: str = "kolumna", **more: str) -> SparkSession:
    """A session; ``master`` only where there is no cluster to say it. ``more``: settings with __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
