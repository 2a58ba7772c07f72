"""Report rows and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.fixed_values import NOT_DECIDED


def report(verdicts: DataFrame, fields: list[str]) -> DataFrame:
    """The narrow report: decided verdicts that have a link.

    Only link and decision are known here; other configured fields stay blank.
    """
    known = {"tweet_url": F.col("item_url"), "deletion": F.col("deletion")}
    decided = ~F.col("deletion").eqNullSafe(NOT_DECIDED)
    linked = F.coalesce("item_url", F.lit("")) != ""
    columns = [known.get(f, F.lit(None).cast("string")).alias(f) for f in fields]
    return verdicts.where(decided & linked).select(*columns, "chunk_id")


def full_report_lines(verdicts: DataFrame) -> DataFrame:
    """Every verdict as one JSON line: the answer's own object plus id and link.

    The answer's text is kept as it is, so extra keys and odd types survive. A
    raw line break can only be white space in valid JSON and becomes a blank.
    """
    own = F.to_json(F.struct(F.col("item_id").alias("tweet_id"), F.col("item_url").alias("tweet_url")))
    parts = verdicts.select("chunk_id", F.translate("raw", "\r\n", "  ").alias("body"), own.alias("own"))
    opened = F.substring("body", F.lit(1), F.length("body") - 1)
    line = F.concat(opened, F.lit(","), F.substring("own", F.lit(2), F.length("own")))
    return parts.select("chunk_id", line.alias("value"))
