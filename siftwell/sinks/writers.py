"""Requests, answers of a client run, reports and failed ids.

Per-chunk outputs are folders chunk_id=K. Wide rows (requests, full verdicts,
failures with their lines) are not shuffled for it: every task writes its share of
each chunk. Narrow rows (report) are rebalanced by chunk, so that their files come
out near the session's advisory size: one per chunk for little data, many for much.

Given the number of chunks, a writer leaves something for each of them: a chunk without
rows gets a file with the header, or with an empty JSON array, both of which read as no
rows. An output is moved into place as a whole when all its files are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.report import full_report_lines, report
from siftwell.operators.stats import absent_chunks
from siftwell.sinks.publish import published

_CSV = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _by_chunk(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", F.col("chunk_id"))


def write_requests(requests: DataFrame, path: str, max_records: int = 0) -> None:
    """Request lines per chunk; max_records bounds the size of one file."""
    (
        requests.select("chunk_id", F.to_json(F.struct("key", "tweet_url", "request")).alias("value"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_records)
        .partitionBy("chunk_id")
        .text(path)
    )


def write_scored(responses: DataFrame, path: str) -> None:
    """Keeps paid answers before anything is made of them."""
    responses.write.mode("overwrite").parquet(path)


def _header(fields: list[str]) -> str:
    quoted = lambda f: '"' + f.replace('"', '""') + '"'
    return ",".join(quoted(f) if any(c in f for c in '",\r\n') else f for f in fields)


def _fill(rows: DataFrame, n: int | None, line: str, path: str) -> None:
    """A file with this line for each of n chunks that has no rows."""
    if n is not None:
        empty = absent_chunks(rows.sparkSession, n, rows).select("chunk_id", F.lit(line).alias("value"))
        _by_chunk(empty).write.mode("append").partitionBy("chunk_id").text(path)


def write_report(verdicts: DataFrame, fields: list[str], path: str, per_chunk: bool = True, n: int | None = None) -> None:
    """The narrow CSV report with a header in every file.

    Without per_chunk the header is there even if there are no rows; with it, given the
    number n of chunks, for those without rows too.
    """
    rows = report(verdicts, fields)

    def write(folder: str) -> None:
        if per_chunk:
            _by_chunk(rows).write.options(**_CSV).partitionBy("chunk_id").csv(folder)
            _fill(rows, n, _header(fields), folder)
        else:
            rows.drop("chunk_id").write.options(**_CSV).csv(folder)

    published(verdicts.sparkSession, path, write)


def write_full_report(verdicts: DataFrame, path: str, n: int | None = None) -> None:
    """All verdicts, unfiltered, as JSON lines per chunk."""

    def write(folder: str) -> None:
        full_report_lines(verdicts).write.partitionBy("chunk_id").text(folder)
        _fill(verdicts, n, "[]", folder)

    published(verdicts.sparkSession, path, write)


def write_failures(failures: DataFrame, path: str, n: int | None = None) -> None:
    """Failed ids with stage, reason and line, per chunk."""

    def write(folder: str) -> None:
        failures.write.partitionBy("chunk_id").json(folder)
        _fill(failures, n, "[]", folder)

    published(failures.sparkSession, path, write)


def write_merged(rows: DataFrame, path: str, single: bool = False) -> None:
    """The merged report, ordered by its column number: a folder of CSV files in order, or one file.

    A single file passes through one writer; it is meant for reports that a person opens.
    """
    columns = [c for c in rows.columns if c != "number"]
    ordered = rows.repartitionByRange("number").sortWithinPartitions("number").select(*columns)

    def write(folder: str) -> None:
        # coalesce(1) reads the ranges one after another, in order.
        (ordered.coalesce(1) if single else ordered).write.options(**_CSV).csv(folder)

    published(rows.sparkSession, path, write, single)
