"""From answer lines to verdicts and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import answers as A
from siftwell.schemas import FAILURE_COLUMNS, VERDICT_COLUMNS


def answer_lines(responses: DataFrame) -> DataFrame:
    """Checks every line's structure; empty lines are skipped.

    Adds parsed (the envelope), carries_key, item_id and item_url. A line that
    is no JSON object, or one without a key, has no item_id.
    """
    lines = responses.where(F.col("submit_error").isNotNull() | (F.col("line") != ""))
    return (
        lines.withColumn("elements", A.elements(F.col("line"), A.ENVELOPE))
        .withColumn("parsed", A.sole(F.col("elements")))
        .drop("elements")
        .withColumn("carries_key", F.coalesce(A.has_key(F.col("parsed"), F.col("line")), F.lit(False)))
        .withColumn(
            "item_id",
            F.when(F.col("submit_error").isNotNull(), F.col("key")).otherwise(
                F.when(F.col("carries_key"), F.coalesce(F.col("parsed.key"), F.lit("None")))
            ),
        )
        .withColumn("item_url", F.when(F.col("carries_key"), F.coalesce("parsed.tweet_url", F.lit(""))))
    )


def with_answer_text(lines: DataFrame) -> DataFrame:
    text = A.answer_text(F.col("parsed"), F.col("line"))
    return lines.withColumn("answer", F.when(F.col("carries_key"), text))


def with_verdict(lines: DataFrame) -> DataFrame:
    """Adds raw (the answer's JSON object), its key map, and whether it is valid."""
    return (
        lines.withColumn("bare", A.without_fences(F.col("answer")))
        .withColumn("raw", A.object_text(F.col("bare")))
        .withColumn("elements", A.elements(F.col("raw"), A.OBJECT))
        .withColumn("values", A.sole(F.col("elements")))
        .drop("bare", "elements")
        .withColumn("is_verdict", A.has_required_keys(F.col("values")))
    )


def parse_responses(responses: DataFrame, criteria_hash: str | None = None) -> DataFrame:
    """One row per line with a verdict, or with stage and fail_reason.

    A single narrow pass: nothing is shuffled, and good and failed rows stay
    in one table so that a later write can part them by folder.
    """
    lines = with_verdict(with_answer_text(answer_lines(responses)))
    reason = (
        F.when(F.col("submit_error").isNotNull(), "submit_failed")
        .when(~F.col("carries_key"), "bad_line")
        .when(F.col("answer").isNull(), "no_text")
        .when(~F.col("is_verdict"), "bad_verdict")
    )
    stage = F.when(F.col("submit_error").isNotNull(), "submit").when(F.col("fail_reason").isNotNull(), "parse")
    # Asking for the partition id changes no value, but it keeps a later filter on
    # fail_reason above this point. Pushed below, it would parse every line again.
    once = F.when(F.spark_partition_id() >= 0, reason)
    good = F.col("fail_reason").isNull()
    value = lambda key: A.last_value(F.col("values"), key)
    return lines.withColumn("fail_reason", once).select(
        "item_id",
        "item_url",
        F.when(good, A.string_list(value("explicit_words"))).alias("explicit_words"),
        F.when(good, value("reason_for_flag")).alias("reason"),
        F.when(good, A.string_list(value("topic_of_tweet"))).alias("topics"),
        F.when(good, value("deletion")).alias("deletion"),
        F.when(good, A.other_keys(F.col("values"))).alias("extras"),
        F.when(good, F.col("raw")).alias("raw"),
        stage.alias("stage"),
        "fail_reason",
        F.when(~good, F.coalesce("line", "submit_error")).alias("line"),
        "chunk_id",
        F.lit(criteria_hash).cast("string").alias("criteria_hash"),
        "ord",
    )


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fail_reason").isNull()).select(VERDICT_COLUMNS)


def failed(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fail_reason").isNotNull()).select(FAILURE_COLUMNS)
