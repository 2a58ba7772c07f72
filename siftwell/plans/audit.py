"""The audit job: from posts and a verdict store to reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.items import assign_chunks, drop_invalid_ids, resolve_ids
from siftwell.operators.late_fetch import addresses, fetch, first_addresses, latest_addresses
from siftwell.operators.pending import cached_lookup, mark_cached, missing_items, pending_items
from siftwell.operators.report import report
from siftwell.operators.requests import render_requests
from siftwell.operators.responses import parse_responses
from siftwell.operators.scoring import Client, ask_until_done, score_rules
from siftwell.operators.stats import run_stats
from siftwell.sinks.writers import write_failures, write_full_report, write_report
from siftwell.schemas import FAILURE_COLUMNS, VERDICT_COLUMNS
from siftwell.sources.archive import import_archive
from siftwell.sources.ledger import AnswerLedger
from siftwell.sources.store import CODEC, VerdictStore
from siftwell.spec import AuditSpec

# Posts that need a verdict, and the run's own folder, to rows as parse_responses
# gives them.
Scorer = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class AuditResult:
    """What a run left behind; every frame reads written tables."""

    merged: DataFrame
    report: DataFrame
    failures: DataFrame
    stats: DataFrame
    missing: DataFrame


def rule_scorer(spec: AuditSpec) -> Scorer:
    return lambda pending, folder: score_rules(pending, spec.criteria, spec.url)


def client_scorer(
    spec: AuditSpec,
    client_factory: Callable[[], Client],
    partitions: int | None = None,
    batch_size: int = 1000,
) -> Scorer:
    """Asks a model service. What it answered is in the run's ledger batch by batch.

    A run that is repeated under its id, because it died or for its reports, asks only for
    what its ledger has no answer to. Other criteria have a ledger of their own.
    """

    def score(pending: DataFrame, folder: str) -> DataFrame:
        ledger = AnswerLedger(pending.sparkSession, f"{folder}/ledger-{spec.criteria.digest}")
        render = lambda posts: render_requests(posts, spec.criteria, spec.url)
        found = ask_until_done(pending, render, client_factory, ledger, spec.max_retries, batch_size, partitions)
        return parse_responses(found, spec.criteria.digest)

    return score


def run_audit(
    items: DataFrame,
    store: VerdictStore,
    scorer: Scorer,
    spec: AuditSpec,
    out_dir: str,
    run_id: str,
    scope: str = "all",
    match_criteria: bool = False,
) -> AuditResult:
    """Scores the posts that have no verdict yet and reports on all of them.

    items come with ids and chunks. The store is read as it was before this
    run, so repeating a run id repeats the run and replaces what it wrote. The
    posts' text is shuffled at most once, for the join with the store; later
    steps handle ids and verdicts only.
    """
    spark = items.sparkSession
    criteria_hash = spec.criteria.digest if match_criteria else None
    known = dict(without_run=run_id, criteria_hash=criteria_hash)
    posts, dropped = drop_invalid_ids(items)

    pending = pending_items(posts, store.ids(**known))
    store.append(scorer(pending, f"{out_dir}/work"), run_id)

    # Which verdicts count is decided on their addresses; only those are read in full.
    new = addresses(store.log(run_id=run_id))
    stored = cached_lookup(posts, latest_addresses(addresses(store.log(**known))))
    winners = first_addresses(new, stored, scope)
    fetch(store.log(), winners).write.mode("overwrite").option("compression", CODEC).parquet(f"{out_dir}/merged")
    merged = spark.read.parquet(f"{out_dir}/merged")

    n = spec.number_of_chunks
    write_full_report(merged, f"{out_dir}/full", n)
    write_report(merged, spec.report_fields, f"{out_dir}/report", n=n)
    failures = store.failures(run_id).select(FAILURE_COLUMNS).unionByName(dropped)
    write_failures(failures, f"{out_dir}/failures", n)

    marked = mark_cached(posts, store.ids(**known))
    stats = run_stats(spark, spec.number_of_chunks, marked, store.answers(run_id), merged)
    stats.write.mode("overwrite").parquet(f"{out_dir}/stats")
    return AuditResult(
        merged=merged.select(VERDICT_COLUMNS),
        report=report(merged, spec.report_fields),
        failures=failures,
        stats=spark.read.parquet(f"{out_dir}/stats"),
        missing=missing_items(posts, merged),
    )


def retry_pending(items: DataFrame, store: VerdictStore, max_rounds: int) -> DataFrame:
    """Posts without a verdict that have failed in fewer than max_rounds runs."""
    if max_rounds <= 0:
        raise ValueError("max_rounds must be > 0")
    tried = (
        store.failures()
        .where(F.col("store_key").isNotNull())
        .select("store_key", "run_id")
        .distinct()
        .groupBy("store_key")
        .agg(F.count(F.lit(1)).alias("rounds"))
    )
    given_up = tried.where(F.col("rounds") >= max_rounds).select("store_key")
    return pending_items(pending_items(items, store.ids()), given_up)


def audit_archive(spark: SparkSession, spec: AuditSpec, scorer: Scorer, run_id: str) -> AuditResult:
    """The whole way from an archive on disk, as set out in the settings."""
    store = VerdictStore.open(spark, spec.store_path)
    if spec.clear_store:
        store.clear(run_id)
    out_dir = f"{spec.output_path}/{run_id}"
    posts = import_archive(spark, spec.archive_path, f"{out_dir}/work/items")
    items = assign_chunks(resolve_ids(posts), spec.number_of_chunks)
    return run_audit(items, store, scorer, spec, out_dir, run_id)
