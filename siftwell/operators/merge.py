"""Last verdict per key, and the union of new and stored verdicts.

Both are aggregations with a partial step on the map side, so however often a
key repeats, each task passes on one row of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.schemas import VERDICT_COLUMNS


def newest(log: DataFrame, columns: list[str]) -> DataFrame:
    """Keep-last: these columns of the newest row of each store key."""
    last = F.max_by(F.struct(*columns), F.struct("written_at", "run_id", "ord"))
    return log.groupBy("store_key").agg(last.alias("v")).select("store_key", "v.*")


def latest_by_key(log: DataFrame) -> DataFrame:
    """The newest verdict of each store key."""
    return newest(log, VERDICT_COLUMNS)


def union_verdicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New before stored, each with its priority."""
    a = new.select(VERDICT_COLUMNS).withColumn("priority", F.lit(0))
    b = stored.select(VERDICT_COLUMNS).withColumn("priority", F.lit(1))
    return a.unionByName(b)


def merge_verdicts(new: DataFrame, stored: DataFrame, scope: str = "all") -> DataFrame:
    """Keep-first over new, then stored, by id; rows without an id all stay.

    scope "all" keeps one verdict per id, "chunk" one per id and chunk. A row
    without an id is its own group, keyed by where it came from.
    """
    if scope not in ("all", "chunk"):
        raise ValueError(f"scope must be 'all' or 'chunk', not {scope!r}")
    no_id = F.coalesce(F.col("item_id"), F.lit("")) == ""
    keyed = (
        union_verdicts(new, stored)
        .withColumn("own_group", F.when(no_id, F.struct("priority", "ord")))
        .withColumn("group_id", F.when(~no_id, F.col("item_id")))
    )
    groups = ["group_id", "own_group"] + (["chunk_id"] if scope == "chunk" else [])
    first = F.min_by(F.struct(*VERDICT_COLUMNS), F.struct("priority", "ord"))
    return keyed.groupBy(*groups).agg(first.alias("v")).select("v.*")
