"""Mixes of sources at target weights, by Pareto order sampling of whole documents.

Documents differ in affinity, by default the number of binary digits of their
size, so that a text of twice the words is wanted one step more.  In a source
the expected number of copies of a document is its affinity times a rate, or
the cap where that is above it; the rate is the one at which the expected words
are the source's target (the excess of the capped is shared anew, from the
greatest affinity down).  Whole copies are certain.  The fraction left is an
inclusion probability p, unequal between documents, and the documents are
ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)): the
first in that order, up to the words that the target still lacks, get one copy
more.  The size is fixed in words, so a source misses its target by half a
document at most, and no document exceeds the cap.

Everything is DataFrame expressions.  u comes from an MD5 of seed and id, so
reruns and other engines agree.  A source may hold most rows, so it is never
ordered as a whole: ranks fall in ``BINS`` bins, bin totals find the one bin
in which the source's words run out, that bin is parted in the same way until
few rows are left in it, and only those are ordered.  All passes but the last
read a table of ids, sources and sizes; the last compares each document with
the key at which its source ends.

Targets: sources ordered by code point, null last, have the weights in turn
and share all words; a target stops at ``CAP`` times its source's size and the
excess is shared anew by weight until none is above.  The table of sources is
one row for each; rounds of it run as aggregates.

Defined cases: a null text has size 0; documents of size 0 are taken 0 times;
a null id is hashed as the text "null"; rows that agree in id and size are
alike, and which of them is taken does not show; an affinity that is null is 1,
and its digits beyond the eighth binary one do not count; an empty table gives
none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kolumna.llm.work import forget, saved, width

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Binary digits of ranks, of them those that part a bin, and rows of a bin that are ordered in one task.
RANK_BITS, BIN_BITS, EDGE = 44, 11, 100_000
BINS = 1 << BIN_BITS


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ ; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row for each source comes in."""
    order = (F.col("source").isNull(), F.col("source"))
    dealt = saved(sizes.repartitionByRange(width(sizes.sparkSession), *order).withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each partition
    place = (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1) % len(weights)
    base = dealt.join(F.broadcast(starts), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int") + 1).cast("long"))
    base = saved(base.select("source", "source_size", "weight"), "sources")
    forget(dealt)
    total = base.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, heavy = 0, None
    share = None
    while True:  # the sources above their cap at the present share are settled there; each round settles more or ends
        above = F.lit(False) if share is None else F.col("weight") * F.lit(share) > cap * F.col("source_size")
        held, rest, n = base.agg(F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count(F.when(above, 1))).first()
        if n == heavy or not rest:
            break
        heavy, capped = n, held
        share = float(total - capped) / float(rest)
    return base.select("source", "source_size", F.least(F.col("weight") * F.lit(share or 0.0), (cap * F.col("source_size")).cast("double")).alias("target"))


def unit(id_: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the id: 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rates(classes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, like, words, target) for each affinity of a source to (source, rate): copies are rate x like, ``cap`` at most.

    Counted from the greatest affinity down, the first class that stays within the cap sets the rate; without one there is no row, and all copies are ``cap``."""
    down = Window.partitionBy("source").orderBy(F.desc("like"))
    held = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    mass = F.sum(F.col("words") * F.col("like")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = classes.select("source", "like", "target", held.cast("double").alias("held"), mass.cast("double").alias("mass")).where("mass > 0")
    found = found.withColumn("rate", (F.col("target") - F.col("held")) / F.col("mass")).where(F.col("rate") * F.col("like") <= cap)
    return found.groupBy("source").agg(F.max_by("rate", "like").alias("rate"))


def _ranked(rows: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """``rows`` with source_size, target, __whole (certain copies) and __rank and __place of each document for one more; null if it is not to have one."""
    joined = rows.join(goals, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    joined = joined.withColumn("__expected", F.when(F.col("source_size") > 0, F.least(F.coalesce(F.col("__rate") * F.col("__like"), F.lit(float(cap))), F.lit(float(cap)))).otherwise(0.0))
    u, p = F.col("__u"), F.col("__expected") - F.floor("__expected")
    odds = (u * (1 - p)) / ((1 - u) * p)
    ranked = joined.withColumn("__whole", F.floor("__expected").cast("long")).withColumn("__rank", F.when((p > 0) & (F.col("__size") > 0), odds / (1 + odds)))
    return ranked.drop("__u", "__rate", "__expected").withColumn("__place", F.floor(F.col("__rank") * float(1 << RANK_BITS)).cast("long"))


def _ends(ranked: DataFrame) -> tuple[DataFrame, int]:
    """Where each source's words run out: (__s, __cut: the bin; __key: the last (rank, id, size) in it that gets a copy, null if none does;
    __alike: rows of that key; __taken: those of them that get one), and by how many digits a place is cut to its bin."""
    source = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    lacks = ranked.groupBy("__source").agg((F.max("target") - F.sum(F.col("__whole") * F.col("__size"))).alias("left")).select(F.col("__source").alias("__s"), "left", F.lit(0).cast("long").alias("__cut"))
    shift = RANK_BITS
    now = saved(lacks, "cuts")
    while True:
        inside = ranked.where("__rank is not null").join(now, source("__source", "__s")).where(F.shiftright("__place", shift) == F.col("__cut"))
        shift -= BIN_BITS
        bins = inside.groupBy("__s", F.shiftright("__place", shift).alias("bin")).agg(F.sum("__size").alias("words"), F.count("*").alias("n"), F.max("left").alias("left"))
        past = F.sum("words").over(Window.partitionBy("__s").orderBy("bin"))
        run = bins.withColumn("before", past - F.col("words")).where("before < left")
        cut = run.groupBy("__s").agg(F.max(F.struct("bin", (F.col("left") - F.col("before")).alias("left"), "n")).alias("c"))
        last, now = now, saved(cut.select("__s", F.col("c.left").alias("left"), F.col("c.bin").alias("__cut"), F.col("c.n").alias("n")), "cuts")
        forget(last)
        if shift < BIN_BITS or (now.agg(F.max("n")).first()[0] or 0) <= EDGE:
            break
    # Only that bin is put in order: a document gets the copy if that brings the sum nearer to what is lacking, so one key parts those that do.
    inside = ranked.where("__rank is not null").join(now.drop("n"), source("__source", "__s")).where(F.shiftright("__place", shift) == F.col("__cut"))
    order = Window.partitionBy("__s").orderBy("__rank", "__id", "__size")
    before = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = inside.select("__s", "__cut", F.struct("__rank", "__id", "__size").alias("key"), (before + F.col("__size") / 2.0 <= F.col("left")).alias("in"))
    keys = edge.groupBy("__s", "__cut", "key").agg(F.count("*").alias("n"), F.count_if("in").alias("taken"))
    ends = keys.groupBy("__s", "__cut").agg(F.max(F.when(F.col("taken") > 0, F.struct("key", "n", "taken"))).alias("e"))
    found = saved(ends.select("__s", "__cut", F.col("e.key").alias("__key"), F.col("e.n").alias("__alike"), F.col("e.taken").alias("__taken")), "ends")
    forget(now)
    return found, shift


def _sized(docs: DataFrame, keep: list[str], doc_id: str, text: str, source: str, affinity: Column | None, seed: str) -> DataFrame:
    """``keep``, __id, __source, __size, __u and __like of each document."""
    size = words(F.col(text))
    rows = docs.select(*keep, F.col(doc_id).alias("__id"), F.col(source).alias("__source"), size.alias("__size"), unit(F.col(doc_id), seed).alias("__u"), *([] if affinity is None else [F.coalesce(affinity.cast("double"), F.lit(1.0)).alias("__like")]))
    if affinity is None:
        return rows.withColumn("__like", F.length(F.bin(F.greatest("__size", F.lit(1)))).cast("long"))
    step = F.pow(F.lit(2.0), F.floor(F.log2("__like")) - 7)
    return rows.withColumn("__like", F.when(F.col("__like") > 0, F.floor(F.col("__like") / step) * step).otherwise(0.0))


def _allotted(rows: DataFrame, narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``rows`` (at least __id, __source, __size, __u, __like) with source_size, target and __copies, decided on ``narrow``, a written table of just those."""
    classes = saved(narrow.groupBy(F.col("__source").alias("source"), F.col("__like").alias("like")).agg(F.sum("__size").alias("words")), "classes")
    goals = saved(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap), "targets")
    wanted = classes.join(goals.select(F.col("source").alias("__s"), "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    known = rates(wanted, cap).select(F.col("source").alias("__r"), F.col("rate").alias("__rate"))
    aims = saved(goals.join(known, F.col("source").eqNullSafe(F.col("__r")), "left").select(F.col("source").alias("__s"), "source_size", "target", "__rate"), "rates")
    forget(classes, goals)
    ends, shift = _ends(_ranked(narrow, aims, cap))
    ends = ends.withColumnRenamed("__s", "__e")

    placed = _ranked(rows, aims, cap).join(ends, F.col("__source").eqNullSafe(F.col("__e")), "left").drop("__e")
    mine, bin_ = F.struct("__rank", "__id", "__size"), F.shiftright("__place", shift)
    extra = (bin_ < F.col("__cut")) | ((bin_ == F.col("__cut")) & (mine <= F.col("__key")))
    placed = placed.withColumn("__extra", F.coalesce(extra.cast("long"), F.lit(0).cast("long")))
    parted = ends.where("__taken < __alike")
    if not parted.isEmpty():  # of rows that are alike, some get a copy
        among = F.coalesce((bin_ == F.col("__cut")) & (mine == F.col("__key")) & (F.col("__taken") < F.col("__alike")), F.lit(False))
        number = F.row_number().over(Window.partitionBy("__source").orderBy("__rank"))
        some = placed.where(among).withColumn("__extra", (number <= F.col("__taken")).cast("long"))
        placed = placed.where(~among).unionByName(some)
    done = placed.withColumn("__copies", F.when(F.col("__size") > 0, F.col("__whole") + F.col("__extra")).otherwise(F.lit(0)).cast("long"))
    return done.drop("__whole", "__rank", "__place", "__cut", "__key", "__alike", "__taken", "__extra")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", affinity: Column | None = None, seed: str = SEED, **how) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken.

    ``affinity``: positive; a document of twice the affinity is to have twice the copies, as far as the cap lets it."""
    narrow = saved(_sized(docs, [], doc_id, text, source, affinity, seed), "sizes")
    found = _allotted(narrow, narrow, **how)
    return found.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", affinity: Column | None = None, seed: str = SEED, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy`` (from 1; a column of that name is replaced)."""
    keep = [c for c in docs.columns if c != "copy"]
    clash = {c: f"__doc_{c}" for c in keep if c in ("source_size", "target")}
    named = lambda c: clash.get(c, c)
    rows = _sized(docs.withColumnsRenamed(clash), [named(c) for c in keep], named(doc_id), named(text), named(source), affinity, seed)
    narrow = saved(_sized(docs, [], doc_id, text, source, affinity, seed), "sizes")
    found = _allotted(rows, narrow, **how)
    forget(narrow)
    found = found.where("__copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return found.select(*(F.col(named(c)).alias(c) for c in keep), "copy")
