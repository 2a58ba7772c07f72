"""Answer files of a model service, and the written output of a client run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.schemas import SCORED


def _chunk_of_path(path: Column) -> Column:
    """Chunk number from a folder chunk_id=3 or a file name with chunk_3, the last of them in the path; null if it is no int."""
    return F.regexp_extract(path, r"^.*chunk_(?:id=)?(\d+)", 1).try_cast("int")


def file_lines(lines: DataFrame) -> DataFrame:
    """Line, file and block of a text scan, batch or streaming."""
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def as_responses(lines: DataFrame) -> DataFrame:
    """Common layout for file lines.

    The row number is taken right after the scan, where it grows along each
    file block.
    """
    row = F.monotonically_increasing_id().alias("row")
    return lines.select(F.struct("file", "block", row).alias("ord"), "line").select(
        "ord",
        "line",
        _chunk_of_path(F.col("ord.file")).alias("chunk_id"),
        F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("string").alias("submit_error"),
    )


def scan_responses(spark: SparkSession, path: str) -> DataFrame:
    """Answer lines. Lines end at \\n only; a \\r is part of its line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    return as_responses(file_lines(lines))


def scan_scored(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a client run as written by write_scored."""
    return spark.read.schema(SCORED).parquet(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.lit(0).cast("long").alias("block"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("ord"),
        "line",
        "chunk_id",
        "key",
        "submit_error",
    )
