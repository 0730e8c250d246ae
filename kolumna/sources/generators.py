"""Made-up tables as Spark ranges: the same rows for the same numbers, at any size and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fraction(*seed) -> object:
    """A number in [0, 1) from a hash of the row's number."""
    return F.pmod(F.xxhash64("id", *map(F.lit, seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def scan_table(spark: SparkSession, rows: int = 4_000_000, seed: int = 20240910) -> DataFrame:
    """(id BIGINT, value DOUBLE in [0, 1))."""
    return spark.range(rows).select("id", _fraction(seed).alias("value"))


def bench_table(spark: SparkSession, rows: int) -> DataFrame:
    """(id BIGINT, grp INT, grp_hi INT, value DOUBLE): 1,024 and 65,536 groups, values of a fixed rule."""
    i = F.col("id")
    return spark.range(rows).select(i, (i % 1024).cast("int").alias("grp"), (i % 65536).cast("int").alias("grp_hi"), ((i * 48271) % 1000003 / F.lit(1000003.0)).alias("value"))


#: Kinds of goods, and words that their names are made of.
CATEGORIES = ("books", "clothing", "electronics", "food", "garden", "home", "sports", "toys")
ADJECTIVES, NOUNS = ("basic", "classic", "compact", "deluxe", "modern", "premium", "simple", "smart"), ("bag", "box", "chair", "lamp", "pack", "set", "table", "tool")


def goods_table(spark: SparkSession, rows: int = 500_000, seed: int = 20260909) -> DataFrame:
    """(id INT, name VARCHAR, category VARCHAR, price DOUBLE, stock INT, rating DOUBLE)."""
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.floor(_fraction(seed, salt) * len(words)) + 1).cast("int"))
    return spark.range(1, rows + 1).select(
        F.col("id").cast("int").alias("id"),
        F.concat_ws(" ", pick(ADJECTIVES, 1), pick(NOUNS, 2), F.col("id").cast("string")).alias("name"),
        pick(CATEGORIES, 3).alias("category"),
        F.round(1 + _fraction(seed, 4) * 999, 2).alias("price"),
        F.floor(_fraction(seed, 5) * 1000).cast("int").alias("stock"),
        F.round(1 + _fraction(seed, 6) * 4, 1).alias("rating"),
    )
