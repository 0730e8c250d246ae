"""Connected components of a table of links, in a few joins a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.work import forget, saved


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: neighbours hang on the least neighbour of a node."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    floor = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(floor, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.unionByName(floor.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: not null, of one type); a component is named by its least node.

    Alternates large-star and small-star until no link changes; each round is written and read again.
    An empty table gives an empty table."""
    now = saved(links.where("a <> b").select("a", "b").distinct(), "links")
    mark = None
    while True:
        last, now = now, saved(_round(now), "links")
        forget(last)
        then = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(then) == mark:
            break
        mark = tuple(then)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component")).distinct()
