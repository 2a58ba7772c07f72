"""Counts per chunk. Every one is a partial aggregation down to few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.spec import check_chunk_count


def response_stats(parsed: DataFrame) -> DataFrame:
    failed = F.col("fail_reason").isNotNull()
    return parsed.groupBy("chunk_id").agg(
        F.count_if(~failed).alias("n_ok"),
        F.count_if(failed).alias("n_failed"),
        F.count(F.lit(1)).alias("n_total"),
    )


def failures_by_reason(parsed: DataFrame) -> DataFrame:
    """Failed lines and failed ids; the first can be more, some have no id."""
    return (
        parsed.where(F.col("fail_reason").isNotNull())
        .groupBy("stage", "fail_reason")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.count("item_id").alias("n_ids"))
    )


def cache_stats(marked: DataFrame) -> DataFrame:
    """From posts marked as decided or not (see mark_cached)."""
    return marked.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~F.col("cached")).alias("n_uncached"),
        F.count_if("cached").alias("n_cached"),
    )


def run_stats(
    spark: SparkSession, n: int, marked: DataFrame, parsed: DataFrame, merged: DataFrame
) -> DataFrame:
    """One row per chunk, also for chunks without posts.

    n_missing is expected minus merged, so posts that share an id count as
    missing here although none of them lacks a verdict.
    """
    check_chunk_count(n)
    chunks = spark.range(n).select(F.col("id").cast("int").alias("chunk_id"))
    answers = response_stats(parsed).select("chunk_id", "n_ok", "n_failed")
    have = merged.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_merged"))
    counts = ["n_total", "n_uncached", "n_cached", "n_ok", "n_failed", "n_merged"]
    return (
        chunks.join(cache_stats(marked), "chunk_id", "left")
        .join(answers, "chunk_id", "left")
        .join(have, "chunk_id", "left")
        .select("chunk_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
        .withColumn("n_missing", F.col("n_total") - F.col("n_merged"))
    )


def absent_chunks(spark: SparkSession, n: int, present: DataFrame) -> DataFrame:
    """Chunk numbers below n that have no row in present."""
    check_chunk_count(n)
    chunks = spark.range(n).select(F.col("id").cast("int").alias("chunk_id"))
    return chunks.join(present.select("chunk_id").distinct(), "chunk_id", "left_anti")
