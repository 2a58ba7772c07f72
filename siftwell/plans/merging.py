"""Merging the chunk reports into one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.fixed_values import CHUNK_REPORT_GLOB
from siftwell.operators.numbering import number_rows
from siftwell.operators.stats import absent_chunks
from siftwell.sinks.writers import write_merged
from siftwell.sources.reports import count_report_files, reported_chunks, scan_report_files, scan_reports
from siftwell.spec import AuditSpec

#: Chunks that an error names.
_NAMED = 20


def _names(chunks: DataFrame) -> list[str]:
    return [str(r["chunk_id"]) for r in chunks.orderBy("chunk_id").limit(_NAMED).collect()]


def check_chunks(spark: SparkSession, n: int, present: DataFrame, what: str = "stats") -> None:
    """All chunks must be there, be it with no posts, and no others. present: a column chunk_id."""
    own = present.select("chunk_id").distinct()
    found = own.filter(F.col("chunk_id").between(0, n - 1)).count()
    if not found:
        raise FileNotFoundError(f"No chunk of {n} is in the {what}")
    if beyond := _names(own.filter(~F.col("chunk_id").between(0, n - 1))):
        raise ValueError(f"Expected {n} chunks, found more: {', '.join(beyond)}")
    if found < n:
        raise ValueError(f"Expected {n} chunks, found {found} in the {what}; absent: {', '.join(_names(absent_chunks(spark, n, own)))}")


def merge_reports(spark: SparkSession, out_dir: str, n: int, fields: list[str], ordered: bool = False, numbered: bool = False) -> DataFrame:
    """All rows of the chunk reports an audit wrote; repeats stay.

    The chunks that were to be reported, those that were counted and those whose files
    are there must be the same. With numbered, rows have a number, by file name and row,
    for which nothing is sorted; with ordered they are sorted by it.
    """
    try:
        stats = spark.read.parquet(f"{out_dir}/stats")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"{out_dir} holds no audit that has ended") from e
        raise
    check_chunks(spark, n, stats)
    check_chunks(spark, n, reported_chunks(spark, f"{out_dir}/report"), "report folders")
    return _placed(scan_reports(spark, f"{out_dir}/report", fields), fields, ordered, numbered)


def _placed(rows: DataFrame, columns: list[str], ordered: bool, numbered: bool) -> DataFrame:
    if not ordered and not numbered:
        return rows.select(*columns)
    placed = number_rows(rows).select(*columns, "number")
    placed = placed.orderBy("number") if ordered else placed
    return placed if numbered else placed.drop("number")


def merge_report_files(
    spark: SparkSession, path: str, n: int, ordered: bool = False, numbered: bool = False, pattern: str = CHUNK_REPORT_GLOB
) -> DataFrame:
    """The same for a folder with one CSV file per chunk, under the first file's columns."""
    count_report_files(spark, path, n, pattern)
    rows = scan_report_files(spark, path, pattern)
    return _placed(rows, [c for c in rows.columns if c not in ("src_file", "row")], ordered, numbered)


def publish_merged(spark: SparkSession, spec: AuditSpec, out_dir: str, files: bool = False, single: bool = False) -> DataFrame:
    """Merges the reports of an audit, or with files a folder of one CSV per chunk, writes the result under
    the name that the settings give, and reads it back."""
    if files:
        rows = merge_report_files(spark, out_dir, spec.number_of_chunks, numbered=True, pattern=spec.merge_pattern)
    else:
        rows = merge_reports(spark, out_dir, spec.number_of_chunks, spec.report_fields, numbered=True)
    path = f"{out_dir.rstrip('/')}/{spec.merge_output_name}"
    write_merged(rows, path, single)
    columns = [c for c in rows.columns if c != "number"]
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return spark.read.options(header=True, multiLine=True, escape='"', lineSep="\n").schema(schema).csv(path)
