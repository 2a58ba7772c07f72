"""Chunk reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.fixed_values import CHUNK_REPORT_GLOB
from siftwell.spec import check_chunk_count

_OPTIONS = {"header": True, "multiLine": True, "escape": '"'}


def _with_order(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(
        *fields,
        F.col("_metadata.file_path").alias("src_file"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_reports(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Reports as written by write_report: all files share one header.

    Adds chunk_id, src_file and row.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    schema = schema.add("chunk_id", T.IntegerType())
    reader = spark.read.options(**_OPTIONS, lineSep="\n").schema(schema)
    return _with_order(reader.csv(path), [*fields, "chunk_id"])


def reported_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id of every chunk folder that holds a file, by the listing alone; no rows if there is no such folder."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "chunk_id int")
    return files.select(F.regexp_extract("path", r"/chunk_id=(\d+)/[^/]*$", 1).try_cast("int").alias("chunk_id")).dropna().distinct()


def count_report_files(spark: SparkSession, path: str, n: int, pattern: str = CHUNK_REPORT_GLOB) -> None:
    """Checks that a folder holds n single-file chunk reports, files with just a header included."""
    check_chunk_count(n)
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").count()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"{path} holds no chunk reports") from e
        raise
    if not found:
        raise FileNotFoundError(f"{path} holds no chunk reports")
    if found != n:
        raise ValueError(f"Expected {n} chunks, found {found}")


def scan_report_files(spark: SparkSession, path: str, pattern: str = CHUNK_REPORT_GLOB) -> DataFrame:
    """All single-file reports of a folder under the columns of the first, by name; adds src_file and row.

    One scan for any number of files and headers. A first one, of lines, finds the most
    cells a row can have. Rows are then read without headers; the first row of each file is
    its header, by which its cells are found. Columns that the first file lacks are dropped,
    those another file lacks stay blank. A name that a header has twice is its first.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    most = (lines.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1) + 1
    while True:
        cells = [f"c{k}" for k in range(most)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
        raw = spark.read.option("pathGlobFilter", pattern).options(**_OPTIONS | {"header": False}).schema(schema).csv(path)
        rows = _with_order(raw, cells).select("src_file", "row", F.array(*cells).alias("cells"))
        heads = rows.groupBy("src_file").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("at"))
        first = heads.agg(F.min_by("head", "src_file").alias("head"), F.bool_or(F.get("head", F.lit(most - 1)).isNotNull()).alias("full")).first()
        if not first["full"]:
            break
        # A header with line breaks in its names has more cells than any of its lines.
        most *= 2
    wanted = list(dict.fromkeys(c for c in first["head"] or [] if c is not None))
    named = heads.select(F.col("src_file").alias("of_file"), "head", "at")
    own = rows.join(named, F.col("src_file") == F.col("of_file")).where(F.col("row") > F.col("at"))
    # A cell that isn't there, or isn't named, is null.
    return own.select(*[F.get("cells", F.nullif(F.array_position("head", F.lit(c)), F.lit(0)).cast("int") - 1).alias(c) for c in wanted], "src_file", (F.col("row") - 1).alias("row"))
