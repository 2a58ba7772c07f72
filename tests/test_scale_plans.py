"""Plans that must hold when one key has a third of all rows."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators.items import resolve_ids
from siftwell.operators.merge import latest_by_key, merge_verdicts
from siftwell.operators.pending import cached_items, cached_lookup, mark_cached, pending_items
from siftwell.operators.responses import parse_responses
from siftwell.schemas import ANSWERS, VERDICT_COLUMNS
from tests.helpers import answer

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    posts = spark.range(0, 60_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id_str"),
        F.lit(None).cast("string").alias("id"),
        F.sha2(F.col("id").cast("string"), 512).alias("item_text"),
        F.lit(0).alias("chunk_id"),
        F.col("id").alias("pos"),
    )
    yield resolve_ids(posts)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def log(spark, n=30_000):
    """A log in which every third row decides the same post anew."""
    rows = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("item_id"),
        F.col("id").cast("string").alias("deletion"),
        F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("id").alias("row")).alias("ord"),
    )
    full = [
        F.col(c) if c in rows.columns else F.lit(None).cast(ANSWERS[c].dataType).alias(c) for c in VERDICT_COLUMNS
    ]
    return rows.select(
        *full, F.col("item_id").alias("store_key"), F.lit(None).cast("timestamp").alias("written_at"), F.lit("r").alias("run_id")
    )


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_post_is_split_in_every_join(spark, skewed):
    ids = log(spark).select("store_key").distinct()
    joins = {
        "anti": (pending_items(skewed, ids), lambda i: i % 3 and i >= 30_000),
        "semi": (cached_items(skewed, ids), lambda i: i % 3 == 0 or i < 30_000),
        "left": (mark_cached(skewed, ids), lambda i: True),
        "inner": (cached_lookup(skewed, latest_by_key(log(spark))), lambda i: i % 3 == 0 or i < 30_000),
    }
    for name, (frame, belongs) in joins.items():
        assert len(frame.collect()) == sum(1 for i in range(60_000) if belongs(i)), name
        assert "skew=true" in final_plan(frame), name


@pytest.mark.parametrize("name", ["latest", "merge"])
def test_hot_key_is_combined_before_the_shuffle(spark, name):
    rows = log(spark)
    frame = latest_by_key(rows) if name == "latest" else merge_verdicts(rows, rows)
    got = {r.item_id: r.deletion for r in frame.collect()}
    assert len(got) == 20_001
    assert got["hot"] == ("29997" if name == "latest" else "0")
    plan = frame._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "partial_max_by" in text or "partial_min_by" in text
    assert "Window" not in text
    # Of 10,000 rows of the hot key at most one per task reaches the shuffle.
    inputs = rows.rdd.getNumPartitions() * (1 if name == "latest" else 2)
    written = shuffle_rows(frame)
    assert written <= (20_000 if name == "latest" else 40_000) + inputs


def shuffle_rows(df):
    """Rows written to the first shuffle of a finished adaptive plan."""

    def stages(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleQueryStageExec":
            yield node
        if name.endswith("QueryStageExec"):
            yield from stages(node.plan())
        children = node.children()
        for i in range(children.size()):
            yield from stages(children.apply(i))

    final = df._jdf.queryExecution().executedPlan().executedPlan()
    stage = next(stages(final))
    return stage.shuffle().metrics().get("shuffleRecordsWritten").get().value()


def test_rows_without_id_do_not_meet_in_one_group(spark):
    rows = log(spark, 3000).withColumn("item_id", F.lit(None).cast("string"))
    merged = merge_verdicts(rows, rows.limit(0))
    assert merged.count() == 3000


def test_pending_reads_one_column_of_the_store(spark, tmp_path, posts, responses):
    from siftwell.sources.store import VerdictStore

    store = VerdictStore.open(spark, str(tmp_path / "s"))
    store.append(parse_responses(responses([answer("a"), "junk"])), "r1")
    plan = final_plan(pending_items(posts([("a", "t")]), store.ids()))
    assert "ReadSchema: struct<store_key:string>" in plan
    assert "PartitionFilters: [isnotnull(outcome" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def exchanges_with(df, column):
    """How many exchanges of the plan carry a column."""
    import re

    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", text)
    assert inputs
    return sum(bool(re.search(rf"\b{column}#", i)) for i in inputs)


def test_stored_answers_cross_one_exchange_at_most(spark, skewed, tmp_path):
    from siftwell.operators.late_fetch import addresses, fetch, first_addresses, latest_addresses
    from siftwell.sources.store import VerdictStore

    store = VerdictStore.open(spark, str(tmp_path / "store"))
    rows = log(spark, 3000).withColumn("raw", F.lit("{}"))
    full = [F.col(c) if c in rows.columns else F.lit(None).cast(ANSWERS[c].dataType).alias(c) for c in ANSWERS.names]
    for run in ("r1", "r2"):
        store.append(rows.select(*full), run)
    stored = cached_lookup(skewed, latest_addresses(addresses(store.log(without_run="r2"))))
    winners = first_addresses(addresses(store.log(run_id="r2")), stored)
    found = fetch(store.log(), winners)
    assert exchanges_with(found, "raw") <= 1 and exchanges_with(winners, "item_text") == 0
    late = {(r.item_id, r.deletion) for r in found.collect()}
    whole = merge_verdicts(store.verdicts(run_id="r2"), cached_lookup(skewed, store.latest(without_run="r2")))
    assert late == {(r.item_id, r.deletion) for r in whole.collect()} and len(late) == found.count()


def test_failures_are_written_where_they_are_and_the_log_is_zstd(spark, posts, responses, tmp_path, monkeypatch):
    """Failed lines are as wide as answers: no exchange carries them to their chunk's files."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from siftwell.operators.responses import parse_responses
    from siftwell.sinks import writers
    from siftwell.sources.store import VerdictStore

    store = VerdictStore.open(spark, str(tmp_path / "store"))
    store.append(parse_responses(responses([answer("a"), "no answer", "{}"])), "r1")
    files = [f for f in (tmp_path / "store" / "log").rglob("*.parquet") if "b-none" not in str(f)]
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    wide = store.failures().repartition(3)
    writers.write_failures(wide, str(tmp_path / "failures"))
    # Both rows stay in the tasks that held them.
    assert len(list(Path(tmp_path / "failures" / "chunk_id=0").glob("part-*"))) == wide.select(F.spark_partition_id()).distinct().count()
