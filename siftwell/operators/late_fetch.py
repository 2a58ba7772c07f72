"""Winners by address: which stored verdicts count is decided on narrow rows, then they are fetched.

A verdict's payload (its lists, extras and the answer's own JSON) is wide, and deciding which
verdict of a key is the newest, whether a post asks for it and whether a new one goes
before it takes several shuffles. So these run on addresses: key, order, and the file and row
where the verdict lies. The payload is read once, by the addresses that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.merge import newest
from siftwell.schemas import VERDICT_COLUMNS

ADDRESS = ["file", "row"]


def addresses(log: DataFrame) -> DataFrame:
    """store_key, item_id, chunk_id, ord, run_id and written_at of a scan of the log, with file and row. Reads no payload."""
    file = F.col("_metadata.file_name").alias("file")
    return log.select("store_key", "item_id", "chunk_id", "ord", "run_id", "written_at", file, F.col("_metadata.row_index").alias("row"))


def latest_addresses(found: DataFrame) -> DataFrame:
    """Keep-last on addresses."""
    return newest(found, ["item_id", "chunk_id", "ord", *ADDRESS])


def first_addresses(new: DataFrame, stored: DataFrame, scope: str = "all") -> DataFrame:
    """Keep-first on addresses, as merge_verdicts does it on verdicts: chunk_id, file and row of those that stay."""
    if scope not in ("all", "chunk"):
        raise ValueError(f"scope must be 'all' or 'chunk', not {scope!r}")
    columns = ["item_id", "chunk_id", "ord", *ADDRESS]
    both = new.select(*columns, F.lit(0).alias("priority")).unionByName(stored.select(*columns, F.lit(1).alias("priority")))
    no_id = F.coalesce(F.col("item_id"), F.lit("")) == ""
    keyed = both.withColumn("own_group", F.when(no_id, F.struct("priority", "ord"))).withColumn("group_id", F.when(~no_id, F.col("item_id")))
    groups = ["group_id", "own_group"] + (["chunk_id"] if scope == "chunk" else [])
    first = F.min_by(F.struct("chunk_id", *ADDRESS), F.struct("priority", "ord"))
    return keyed.groupBy(*groups).agg(first.alias("v")).select("v.*")


def fetch(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The verdicts at the wanted addresses, each with the chunk that asks for it; a verdict may be asked for by several."""
    own = [c for c in VERDICT_COLUMNS if c != "chunk_id"]
    rows = log.select(*own, F.col("_metadata.file_name").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    at = wanted.select("chunk_id", *ADDRESS)
    return rows.join(at, (F.col("at_file") == F.col("file")) & (F.col("at_row") == F.col("row"))).select(*VERDICT_COLUMNS)
