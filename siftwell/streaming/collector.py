"""Answers that arrive later: a file stream into the verdict store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.responses import parse_responses
from siftwell.sources.responses import as_responses, file_lines
from siftwell.sources.store import VerdictStore

#: Under this name Spark tells a batch the id of its query, which outlives restarts.
_QUERY_ID = "sql.streaming.queryId"


def collect_responses(
    spark: SparkSession,
    in_dir: str,
    store: VerdictStore,
    checkpoint: str,
    name: str = "collect",
    criteria_hash: str | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Parses the answer files that have landed since the last call, then stops.

    Each batch goes to a run id of its own, made of name, the id that Spark gives the
    collection and keeps in its checkpoint, and batch number. A batch that is replayed
    after a failure replaces what it wrote before, so every answer is stored once; a new
    checkpoint is a new collection, be it at the path of an old one, and never writes
    over another's. There is no shuffle and no state.
    """
    lines = (
        spark.readStream.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .text(in_dir)
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        collection = batch.sparkSession.sparkContext.getLocalProperty(_QUERY_ID).replace("-", "")
        store.append(parse_responses(as_responses(batch), criteria_hash), f"{name}-{collection}-{batch_id}")

    return (
        file_lines(lines)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
