"""The subpackage's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm import chat, decontam, licenses, lm_score, mixing, ngram_join, quality, sharding, substring, tokens
from graphwright.plans.scratch import small_batches

#: The public vocabulary that token counts use; the file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    found = lm_score.score(docs, lm_score.train(docs, good))
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_matches", "licenses", "best", F.round("best_coverage", 6).alias("best_coverage"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.numbered(table(spark, sf_dir, "documents"))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = chat.conversations(table(spark, sf_dir, "conversations"))
    return chat.summary(chat.format_pairs(chat.replayed(talks)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), drop_text=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.counts(table(spark, sf_dir, "documents"), tokens.read_ranks(VOCABULARY))
    return found.select("doc_id", "n_bytes", "n_words", "n_tokens", F.round("log_prob", 3).alias("log_prob"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_license_scan, op3_sharding, op4_preference_formatting, op5_decontamination, op6_ngram_join, op7_substring_dedup, op8_mixing, op9_quality, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op4_preference_formatting": chat.QUERY_SQL, "op3_sharding": sharding.QUERY_SQL, "op5_decontamination": decontam.QUERY_SQL, "op6_ngram_join": ngram_join.QUERY_SQL, "op7_substring_dedup": substring.QUERY_SQL, "op8_mixing": mixing.QUERY_SQL}
