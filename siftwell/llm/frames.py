"""Helpers shared by the operators: Arrow maps over bounded slices, written intermediates, named columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.session import new_folder

#: Bytes of text that one step of a Python task holds at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, codec: str = "zstd", by: Iterable[str] = ()) -> DataFrame:
    """df written once below the shared folder and read again, so that a lost executor repeats no more than a file."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, label: str, **named: str | Column) -> DataFrame:
    """These columns and row_key, a number of each row that stays the same whenever the frame is read.

    Rows of a Parquet scan are numbered by file and place. Others have no address, and their order may
    change when they are computed again, so they are written and then are such a scan.
    """
    columns = [(df[c] if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    address = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        rows = df.select(*columns, *address)
    except AnalysisException:
        rows = written(df.select(*columns), label).select(*named, *address)
    counted = rows.groupBy("_file").agg(F.count("*").alias("n"))
    # One row per file is all that this window sees.
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counted.select(F.col("_file").alias("_of"), before.alias("_before")), label)
    return rows.join(starts, F.col("_file") == F.col("_of")).select(*named, (F.col("_before") + F.col("_row")).alias("row_key"))


def only(df: DataFrame, **named: str | Column) -> DataFrame:
    """A frame of just these columns: extra ones, whatever their names, can't clash with an operator's own."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in named.items()])


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each has at most `most` bytes in column text, or one row."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        sizes = [x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()]
        held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """step gets slices of bounded size and gives columns by name, as lists or arrays, for each batch it wants to emit."""
    fields = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, most):
            for columns in step(piece):
                yield record_batch(columns, fields)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def dealt(df: DataFrame, *by: str | Column) -> DataFrame:
    """Rebalanced by Spark to its advised size; frequent keys are split."""
    return df.hint("rebalance", *by) if by else df.hint("rebalance")


def tasks(df: DataFrame, weight: int, per_task: int) -> int:
    """How many tasks hold `weight` units at `per_task` each; at least one."""
    return max(1, -(-int(weight) // per_task))


def crc32_text(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))
