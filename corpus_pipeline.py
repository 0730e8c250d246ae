"""The corpus pipeline: stages over the documents, each on all that the one before it kept.

1. quality: documents that the quality classifier scores under one half go;
2. near_duplicates: one document of each near-duplicate group stays (five-word shingles, similarity 0.8 or more);
3. decontamination: documents that hold a benchmark passage go, however short it is beside the rest;
4. secrets: secrets in texts are replaced by a mark, and ``n_chars`` follows; no document goes;
5. mixing: documents are taken whole, none or several times, so that sources meet their target weights.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, the last adds ``copy``, from 1 for each
time a document is taken.  Between stages the rows are written as Parquet, and
what a stage wrote on its way is removed.

Defined cases: an empty table gives an empty table; null texts are empty ones
to every stage (and are scored, grouped and mixed as such); rows without an id
pass the near-duplicate stage, which judges by id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolumna.llm import decontam, mixing, near_dup, quality, secrets
from kolumna.llm.work import forget, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), share=None)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Boosted trees, MinHash groups and tagged spans are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settled(spark, functools.partial(stage, spark, docs, sf_dir), name)
        forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
