"""Posts: ids, chunk numbers, and what is dropped for want of an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.ids import is_valid_id, resolve_id, store_key
from siftwell.schemas import FAILURE_COLUMNS
from siftwell.spec import check_chunk_count, check_chunk_id


def resolve_ids(df: DataFrame, id_str: str = "id_str", id_: str = "id") -> DataFrame:
    """Adds item_id and the key under which the verdict store knows it."""
    item_id = resolve_id(F.col(id_str).cast("string"), F.col(id_).cast("string"))
    return df.withColumn("item_id", item_id).withColumn("store_key", store_key(F.col("item_id")))


def assign_chunks(df: DataFrame, n: int, by: str = "position") -> DataFrame:
    """Round robin by position, or by a hash of the id. Both are row-local.

    The position is a post's number over all files where the rows have one, as those
    of an archive do, else its place within its source.
    """
    check_chunk_count(n)
    number: dict[str, Column] = {
        "position": F.col("number" if "number" in df.columns else "pos"),
        "hash": F.xxhash64("item_id"),
    }
    if by not in number:
        raise ValueError(f"by must be one of {sorted(number)}, not {by!r}")
    return df.withColumn("chunk_id", F.pmod(number[by], F.lit(n)).cast("int"))


def select_chunk(df: DataFrame, chunk_id: int, n: int) -> DataFrame:
    check_chunk_id(chunk_id, n)
    return df.where(F.col("chunk_id") == chunk_id)


def drop_invalid_ids(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a usable id, and the rest as failures of stage "id".

    A dropped post is told by its file and position; its text is left where it
    is, so that finding these few posts reads the id columns only.
    """
    valid = F.coalesce(is_valid_id(F.col("item_id")), F.lit(False))
    dropped = items.where(~valid).select(
        "item_id",
        F.lit("id").alias("stage"),
        F.lit("no_id").alias("fail_reason"),
        F.lit(None).cast("string").alias("line"),
        "chunk_id",
        F.struct(
            F.col("src_file").alias("file"),
            F.lit(0).cast("long").alias("block"),
            F.col("pos").cast("long").alias("row"),
        ).alias("ord"),
    )
    return items.where(valid), dropped.select(FAILURE_COLUMNS)
