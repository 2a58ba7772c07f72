"""Joins of posts with the verdict store.

The store side is made unique with a partial aggregation first, so a key that
was decided very often reaches the join once. The post side may still hold one
id for a large share of its rows. Such a key is split at run time by the skew
join rule of adaptive execution, which only looks at shuffles that exist for
the join itself. The extra key column (a hash of the id, known on both sides)
keeps the join from reusing the aggregation's partitioning and so gives it
shuffles of its own. Nothing is hinted: a small store is broadcast by its
measured size, a large one never.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.ids import store_key

_KEYS = ["store_key", "key_hash"]


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("key_hash", F.xxhash64("store_key"))


def store_ids(log: DataFrame) -> DataFrame:
    """The distinct keys of a verdict log; reads this one column."""
    return log.select("store_key").distinct()


def pending_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts without a verdict."""
    return _hashed(items).join(_hashed(ids), _KEYS, "left_anti").select(items.columns)


def cached_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts that already have a verdict."""
    return _hashed(items).join(_hashed(ids), _KEYS, "left_semi").select(items.columns)


def split_pending(items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pending_items(items, ids), cached_items(items, ids)


def mark_cached(items: DataFrame, ids: DataFrame) -> DataFrame:
    """One pass over the posts that only tells which of them are decided."""
    known = _hashed(ids).withColumn("cached", F.lit(True))
    joined = _hashed(items.select("item_id", "store_key", "chunk_id")).join(known, _KEYS, "left")
    return joined.select("item_id", "chunk_id", F.coalesce("cached", F.lit(False)).alias("cached"))


def cached_lookup(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Stored verdict of every decided post, with the post's chunk."""
    posts = _hashed(items.select("store_key", "chunk_id"))
    stored = _hashed(latest.drop("chunk_id"))
    return posts.join(stored, _KEYS).drop(*_KEYS)


def missing_items(items: DataFrame, merged: DataFrame) -> DataFrame:
    """Ids of posts that ended up without a verdict, each once. Ids are compared as the store does."""
    expected = items.select("item_id", "chunk_id", store_key(F.col("item_id")).alias("store_key")).distinct()
    have = merged.select(store_key(F.col("item_id")).alias("store_key")).distinct()
    return _hashed(expected).join(_hashed(have), _KEYS, "left_anti").select("item_id", "chunk_id")
