"""The answer ledger of a run: what a model service was asked, what it said, and what is to be asked again.

A row is an answer line, a mark (this request was part of a batch that was answered), or a
fault (it was part of one that failed, at which attempt, and when it may be tried again). All
rows of a batch come from one task, and the files of a task are in the ledger as soon as it is
done, whatever becomes of the job: so a run that lost its driver in the middle has what was paid
for. Requests are known by a hash of their line. Answers come without one, as services may
give them in any number and order.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.schemas import LEDGER

ANSWER, MARK, FAULT = "answer", "mark", "fault"
#: Files are moved in task by task, not at the end of the job.
_AS_TASKS_END = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class AnswerLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _rows(self, kind: str) -> DataFrame:
        rows = self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(self.path)
        return rows.where(F.col("kind") == kind)

    def is_new(self) -> bool:
        """Nothing was ever asked."""
        try:
            return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(self.path).isEmpty()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return True
            raise

    def write(self, rows: DataFrame) -> None:
        """Asks, as rows are asked for by being written; done tasks stay written if the job dies."""
        rows.write.options(**_AS_TASKS_END).parquet(f"{self.path}/{uuid.uuid4().hex}")

    def asked(self) -> DataFrame:
        """request: hashes of all requests in answered batches."""
        return self._rows(MARK).select("request").distinct()

    def faults(self) -> DataFrame:
        """The last fault of each request that has no answer yet: request, key, chunk_id, attempt, error, again, due, and its address."""
        file, row = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        rows = self._rows(FAULT).select("request", "key", "chunk_id", "attempt", "submit_error", "again", "due", file, row)
        last = F.max_by(F.struct("key", "chunk_id", "attempt", "submit_error", "again", "due", "file", "row"), F.struct("attempt", "due"))
        latest = rows.groupBy("request").agg(last.alias("f")).select("request", "f.*")
        return latest.join(self.asked(), "request", "left_anti")

    def queue(self, max_attempts: int) -> DataFrame:
        """Requests to be tried again: request, attempt, due (seconds of the clock)."""
        return self.faults().where(F.col("again") & (F.col("attempt") < max_attempts)).select("request", "attempt", "due")

    def given_up(self, max_attempts: int) -> DataFrame:
        return self.faults().where(~F.col("again") | (F.col("attempt") >= max_attempts))

    def responses(self, max_attempts: int) -> DataFrame:
        """Answer lines, and a row with submit_error for each request that was given up, as scan_scored gives them."""
        empty = F.lit(0).cast("long").alias("block")
        answers = self._rows(ANSWER).select(
            F.struct(F.col("_metadata.file_path").alias("file"), empty, F.col("_metadata.row_index").alias("row")).alias("ord"),
            "line",
            "chunk_id",
            "key",
            "submit_error",
        )
        lost = self.given_up(max_attempts).select(F.struct("file", empty, "row").alias("ord"), F.lit(None).cast("string").alias("line"), "chunk_id", "key", "submit_error")
        return answers.unionByName(lost)
