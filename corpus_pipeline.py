"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All stages but the last return the columns of documents.  A stage works on all rows that its
predecessor kept.

In all stages: extra columns pass through, whatever their names (the last stage has its own columns alone); texts count whole,
however long; an empty table gives an empty table; repeated rows are judged alike, and null ids are no obstacle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphwright.llm import decontam, mixing, ngram_join, quality, sharding
from graphwright.plans.scratch import Settled, lifetime, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule or repeat too much of themselves; null and empty texts have no words and fail."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram similarity links, one stays: the smallest id's (ids before nulls); rows without words all stay."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain passages of the benchmark; null and empty texts stay, and null or empty items reject nothing."""
    small_batches(spark)
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for: not at all, once, or repeated; a null source is a source, and rows without words aren't taken."""
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each row in a shard, with a slot; null ids are one key, and repeated rows have slots of their own."""
    return sharding.numbered(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("sharding", shards),
]

#: The quality rules measure characters under several n-gram lengths, and components are iterative: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with lifetime() as kept:  # what a stage settles on its way goes when its rows are written
            after = Settled(stage(spark, docs, sf_dir), spark)
            kept.append(after)
        if before:
            before.drop()
        docs, before = after.df, after
    return docs
