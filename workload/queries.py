"""One query per operator, each over whole tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.ids import is_valid_id, request_key
from siftwell.functions.prompts import prompt
from siftwell.functions.urls import permalink
from siftwell.functions.words import join_words, token_runs
from siftwell.operators import items as items_ops
from siftwell.operators import merge, pending, report, requests, responses, scoring, stats
from siftwell.operators.items import resolve_ids
from siftwell.plans.audit import audit_archive, client_scorer, retry_pending, rule_scorer, run_audit
from siftwell.plans.merging import merge_report_files as merge_files
from siftwell.plans.merging import merge_reports as merge_reports_plan
from siftwell.plans.merging import publish_merged
from siftwell.session import new_folder
from siftwell.sinks import writers
from siftwell.sources.archive import scan_archive as read_archive
from siftwell.sources.ledger import AnswerLedger
from siftwell.sources.reports import reported_chunks, scan_reports
from siftwell.sources.responses import scan_responses as read_responses
from siftwell.sources.store import VerdictStore
from siftwell.streaming.collector import collect_responses as collect
from workload import inputs as I

SPEC = I.SPEC
CRITERIA, URL = SPEC.criteria, SPEC.url


def _joined(name: str) -> F.Column:
    return F.array_join(F.array_sort(name), ",")


# Sources


def scan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = read_archive(spark, I.archive(spark, sf_dir))
    return items_ops.resolve_ids(posts).select("item_id", "pos", "item_text")


def scan_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's raw text as lines of a file."""
    path = new_folder(spark, "lines")
    I.table(spark, sf_dir, "documents").select("text").write.text(path)
    return read_responses(spark, path).select("line")


# Ids, links, chunks


def _odd_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids are empty, absent, zero, blank around, or plain."""
    odd = F.pmod("doc_id", F.lit(7))
    number = F.col("doc_id").cast("string")
    id_str = (
        F.when(odd == 0, F.lit("")).when(odd.isin(1, 2, 3), F.lit(None)).when(odd == 4, F.concat(F.lit(" \u00a0"), number, F.lit("\t")))
        .when(odd == 5, F.lit("unknown")).otherwise(number)
    )
    id_ = F.when(odd.isin(0, 1), F.concat(F.lit("n"), number)).when(odd == 2, F.lit("0")).when(odd == 3, F.lit(None)).otherwise(F.lit("other"))
    docs = I.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("item_text"), F.lit("documents").alias("src_file"), F.col("doc_id").alias("pos"),
        id_str.alias("id_str"), id_.alias("id"),
    )
    return items_ops.assign_chunks(items_ops.resolve_ids(docs), I.CHUNKS)


def resolve_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_ids(spark, sf_dir).select(
        "doc_id", "item_id", "store_key", request_key(F.col("item_id")).alias("request_key")
    )


def drop_invalid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = items_ops.drop_invalid_ids(_odd_ids(spark, sf_dir))
    kept = kept.select(F.col("pos").alias("doc_id"), "item_id", F.lit("kept").alias("outcome"))
    return kept.unionByName(dropped.select(F.col("ord.row").alias("doc_id"), "item_id", F.col("fail_reason").alias("outcome")))


def build_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.items(spark, sf_dir).select("item_id", permalink(F.col("item_id"), URL).alias("tweet_url"))


def assign_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.items(spark, sf_dir).select("item_id", "chunk_id")


def assign_chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of many small files: posts are numbered over all of them, so chunks are even."""
    posts = read_archive(spark, I.archive(spark, sf_dir, I.SMALL_PART_ROWS))
    chunked = items_ops.assign_chunks(items_ops.resolve_ids(posts), I.MANY_CHUNKS)
    return chunked.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_posts"))


def select_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk on its own, put side by side again."""
    posts = I.items(spark, sf_dir)
    parts = [items_ops.select_chunk(posts, k, I.CHUNKS).withColumn("chosen", F.lit(k)) for k in range(I.CHUNKS)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("chosen", "item_id")


# Requests


def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.items(spark, sf_dir).select("item_id", prompt(F.col("item_text"), CRITERIA).alias("prompt"))


def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = requests.render_requests(I.items(spark, sf_dir), CRITERIA, URL)
    text = F.col("request.contents")[0]["parts"][0]["text"]
    return built.select("key", "tweet_url", text.alias("prompt"), "chunk_id")


def requests_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "requests")
    writers.write_requests(requests.render_requests(I.items(spark, sf_dir), CRITERIA, URL), path, max_records=100_000)
    shape = "key string, tweet_url string, request struct<contents: array<struct<parts: array<struct<text: string>>>>>"
    lines = spark.read.schema("value string, chunk_id int").option("lineSep", "\n").text(path)
    request = lines.select("chunk_id", F.from_json("value", shape).alias("r"))
    text = F.get(F.get(F.col("r.request.contents"), F.lit(0))["parts"], F.lit(0))["text"]
    return request.select("chunk_id", "r.key", "r.tweet_url", text.alias("prompt"))


# Scoring


def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = scoring.score_rules(I.items(spark, sf_dir), CRITERIA, URL)
    return verdicts.select("item_id", _joined("explicit_words").alias("words"), "deletion")


def score_with_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = client_scorer(SPEC, I.rule_client_factory(), partitions=spark.sparkContext.defaultParallelism)
    answers = score(I.items(spark, sf_dir), new_folder(spark, "scored"))
    return responses.good(answers).select("item_id", "item_url", _joined("explicit_words").alias("words"), "deletion")


def score_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose job dies while other tasks are answered, and the one that goes on: every post has one answer."""
    posts, ledger = I.items(spark, sf_dir), AnswerLedger(spark, new_folder(spark, "ledger"))
    render = lambda rows: requests.render_requests(rows, CRITERIA, URL)
    try:
        scoring.ask_until_done(posts, render, I.dying_client_factory(), ledger, partitions=spark.sparkContext.defaultParallelism)
    except Exception as e:
        if I.LOST not in str(e):
            raise
    found = scoring.ask_until_done(posts, render, I.rule_client_factory(), ledger, partitions=spark.sparkContext.defaultParallelism)
    answers = responses.good(responses.parse_responses(found, CRITERIA.digest))
    return answers.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_answers"), F.max("deletion").alias("deletion"))


def score_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service that is busy at first for one chunk, always for a second, and fails for a third."""
    ledger, service = AnswerLedger(spark, new_folder(spark, "ledger")), I.BusyService()
    render = lambda rows: requests.render_requests(rows, CRITERIA, URL)
    found = scoring.ask_until_done(I.items(spark, sf_dir), render, service, ledger, max_attempts=3, clock=I.no_time, sleep=service.wait)
    parsed = responses.parse_responses(found, CRITERIA.digest)
    tries = ledger.given_up(3).select(F.col("key").alias("of_key"), "attempt")
    whole = parsed.join(tries, F.col("item_id") == F.col("of_key"), "left")
    return whole.select("item_id", "chunk_id", "deletion", "fail_reason", "attempt")


def match_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words of the benchmark as a dictionary, looked up in all posts."""
    pairs = I.table(spark, sf_dir, "benchmark").select(F.explode(token_runs(F.lower("text"), [(2, True)])).alias("entry")).distinct()
    entries = pairs.select("entry", F.lit(2).alias("n"), F.lit(True).alias("words_only"), F.lit(0).alias("place"), F.col("entry").alias("shown"))
    rows = I.items(spark, sf_dir).select("item_id", F.lower("item_text").alias("lower"))
    found = join_words(rows, "lower", entries)
    return found.select("item_id", F.size("explicit_words").alias("n_found"), F.md5(F.array_join("explicit_words", ",")).alias("found_md5"))


# Answers


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = responses.answer_lines(I.responses(spark, sf_dir))
    return lines.select("chunk_id", "item_id", "carries_key")


def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that echo the post's whole text, every third without a link."""
    path = new_folder(spark, "echo")
    key = F.col("item_id")
    url = permalink(key, URL)
    echo = F.when(F.pmod("pos", F.lit(3)) == 0, I._envelope(key, None, F.col("item_text"))).otherwise(
        I._envelope(key, url, F.col("item_text"))
    )
    I.items(spark, sf_dir).select(echo.alias("value")).write.text(path)
    lines = responses.with_answer_text(responses.answer_lines(read_responses(spark, path)))
    return lines.select("item_id", "item_url", "answer")


def validate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = responses.with_answer_text(responses.answer_lines(I.responses(spark, sf_dir)))
    return responses.with_verdict(lines).where(F.col("item_id").isNotNull()).select("item_id", "is_verdict")


def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.good(I.parsed(spark, sf_dir)).select(
        "item_id",
        "item_url",
        _joined("explicit_words").alias("words"),
        "reason",
        F.array_join("topics", ",").alias("topics"),
        "deletion",
        F.array_join(F.array_sort(F.map_keys("extras")), ",").alias("extra_keys"),
        F.col("extras")["note"].alias("note"),
        "chunk_id",
    )


def response_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.response_stats(I.parsed(spark, sf_dir))


def failures_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.failures_by_reason(I.parsed(spark, sf_dir))


def failed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "failed")
    writers.write_failures(responses.failed(I.parsed(spark, sf_dir)), path)
    back = spark.read.schema("item_id string, fail_reason string, stage string, chunk_id int").json(path)
    return back.where(F.col("item_id").isNotNull()).select("chunk_id", "item_id", "stage", "fail_reason")


def collect_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answer files through the file stream, twice; the second finds none."""
    path = I.answer_folder(spark, I.items(spark, sf_dir))
    store, checkpoint = I.new_store(spark), new_folder(spark, "checkpoint")
    for _ in range(2):
        collect(spark, path, store, checkpoint, criteria_hash=CRITERIA.digest, max_files=2).awaitTermination()
    verdicts = store.verdicts().select("item_id", F.lit("verdict").alias("outcome"), "deletion")
    failures = store.failures().select("item_id", F.col("fail_reason").alias("outcome"), F.lit(None).cast("string").alias("deletion"))
    return verdicts.unionByName(failures)


# Store


def collect_two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections of one name over the same files at once, each with a checkpoint and a handle of its own: both stay."""
    path, store = I.answer_folder(spark, I.items(spark, sf_dir)), I.new_store(spark)
    handles = [VerdictStore.open(spark, store.path) for _ in range(2)]
    streams = [collect(spark, path, h, new_folder(spark, "checkpoint"), criteria_hash=CRITERIA.digest, max_files=2) for h in handles]
    for stream in streams:
        stream.awaitTermination()
    return VerdictStore.open(spark, store.path).verdicts().select("item_id", "deletion")


def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's verdicts first, people's labels over them."""
    store = I.new_store(spark)
    store.append(scoring.score_rules(I.items(spark, sf_dir), CRITERIA, URL), "r0-rules")
    store.append(I.label_verdicts(spark, sf_dir), "r1-labels")
    return store.latest().select("item_id", "deletion", "reason")


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is written twice counts once; the last line of an id wins."""
    store = I.new_store(spark)
    answers = I.parsed(spark, sf_dir)
    for _ in range(2):
        store.append(answers, "r0")
    latest = store.latest().select("store_key", "deletion")
    rows = store.verdicts().groupBy("store_key").agg(F.count("*").alias("n_rows"))
    return latest.join(rows, "store_key")


def store_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = I.new_store(spark)
    store.append(scoring.score_rules(I.items(spark, sf_dir), CRITERIA, URL), "r0-rules")
    store.clear("r1-labels")
    store.append(I.label_verdicts(spark, sf_dir), "r1-labels")
    store.clear("r1-labels")
    return store.latest().select("item_id", "deletion")


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = I.new_store(spark)
    store.append(scoring.score_rules(I.items(spark, sf_dir), CRITERIA, URL), "r0-rules")
    store.append(I.label_verdicts(spark, sf_dir), "r1-labels")
    store.compact("r2-compact")
    return store.verdicts().select("item_id", "deletion", "run_id")


# Joins with the store


def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = pending.pending_items(I.items(spark, sf_dir), I.warm_store(spark, sf_dir).ids())
    return left.select("item_id", "chunk_id", "item_text")


def cached_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = pending.cached_items(I.items(spark, sf_dir), I.warm_store(spark, sf_dir).ids())
    return known.select("item_id", "chunk_id")


def cached_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pending.cached_lookup(I.items(spark, sf_dir), I.warm_store(spark, sf_dir).latest())
    return found.select("item_id", "chunk_id", "deletion", "reason")


def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose answers were of no use."""
    have = responses.good(I.parsed(spark, sf_dir))
    return pending.missing_items(I.items(spark, sf_dir), have).select("item_id", "chunk_id")


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pending.mark_cached(I.items(spark, sf_dir), I.warm_store(spark, sf_dir).ids())
    return stats.cache_stats(marked)


# Merge


def merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First assistant turn of a conversation, else its first other turn."""
    turns = I.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("item_id"),
        F.col("role").alias("deletion"),
        F.col("text").alias("reason"),
        F.struct(F.lit("conversations").alias("file"), F.lit(0).alias("block"), F.col("turn").alias("row")).alias("ord"),
    )
    new = I.as_answers(turns.where(F.col("deletion") == "assistant"))
    stored = I.as_answers(turns.where(F.col("deletion") != "assistant"))
    merged = merge.merge_verdicts(new, stored)
    return merged.select("item_id", F.col("ord.row").alias("turn"), F.col("deletion").alias("role"), F.col("reason").alias("text"))


def merge_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first within a chunk: conversations chunked by role."""
    turns = I.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("item_id"),
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).alias("chunk_id"),
        F.struct(F.lit("conversations").alias("file"), F.lit(0).alias("block"), F.col("turn").alias("row")).alias("ord"),
    )
    turns = I.as_answers(turns)
    merged = merge.merge_verdicts(turns, turns, scope="chunk")
    return merged.select("item_id", "chunk_id", F.col("ord.row").alias("turn"))


def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last turn of every conversation, by the order that the store uses."""
    turns = I.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("item_id"),
        F.col("role").alias("deletion"),
        F.col("text").alias("reason"),
        F.struct(F.lit("conversations").alias("file"), F.lit(0).alias("block"), F.col("turn").alias("row")).alias("ord"),
    )
    log = I.as_answers(turns).select(
        "*", F.col("item_id").alias("store_key"), F.lit(None).cast("timestamp").alias("written_at"), F.lit("r0").alias("run_id")
    )
    last = merge.latest_by_key(log)
    return last.select("item_id", F.col("ord.row").alias("turn"), F.col("deletion").alias("role"), F.col("reason").alias("text"))


# Reports


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "report")
    writers.write_report(responses.good(I.parsed(spark, sf_dir)), SPEC.report_fields, path)
    return scan_reports(spark, path, SPEC.report_fields).select("chunk_id", "tweet_url", "deletion")


def report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "full")
    writers.write_full_report(responses.good(I.parsed(spark, sf_dir)), path)
    shape = "tweet_id string, tweet_url string, deletion string, reason_for_flag string, explicit_words string, confidence double, chunk_id int"
    back = spark.read.schema(shape).json(path)
    return back.select(
        "chunk_id", "tweet_id", "tweet_url", "deletion", F.col("reason_for_flag").alias("reason"),
        F.col("explicit_words").alias("words_json"), "confidence",
    )


def empty_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that fill four chunks of many: every chunk has a report, a full report and a list of failures."""
    langs = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 13).when(F.col("lang") == "de", 26).otherwise(39)
    posts = resolve_ids(I.posts(spark, sf_dir)).withColumn("chunk_id", langs)
    out_dir = new_folder(spark, "audit")
    run_audit(posts, I.new_store(spark), rule_scorer(I.FEW_FULL), I.FEW_FULL, out_dir, "r1")
    found = [reported_chunks(spark, f"{out_dir}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("report", "full", "failures")]
    kinds = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_outputs"))
    rows = scan_reports(spark, f"{out_dir}/report", SPEC.report_fields).groupBy(F.col("chunk_id").alias("of_chunk")).agg(F.count(F.lit(1)).alias("n"))
    whole = kinds.join(rows, F.col("chunk_id") == F.col("of_chunk"), "left")
    return whole.select("chunk_id", "n_outputs", F.coalesce("n", F.lit(0)).alias("n_rows"))


def chunk_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, of many, in which the rule flags no post."""
    verdicts = scoring.score_rules(I.items(spark, sf_dir, I.MANY_CHUNKS), CRITERIA, URL)
    return stats.absent_chunks(spark, I.MANY_CHUNKS, verdicts.where(F.col("deletion") == "DELETE"))


# Jobs


def _audit(spark: SparkSession, sf_dir: str, out_dir: str):
    store = I.warm_store(spark, sf_dir)
    return run_audit(I.items(spark, sf_dir), store, rule_scorer(SPEC), SPEC, out_dir, "r1")


def run_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents keep their verdict, the others get the rule's."""
    merged = _audit(spark, sf_dir, new_folder(spark, "audit")).merged
    return merged.select("item_id", "chunk_id", F.col("item_url").alias("tweet_url"), "deletion", "reason")


def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run over a warm store whose answers are partly of no use."""
    out_dir, store = new_folder(spark, "audit"), I.warm_store(spark, sf_dir)
    return run_audit(I.items(spark, sf_dir), store, I.bent_scorer, SPEC, out_dir, "r1").stats


def merge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = new_folder(spark, "audit")
    _audit(spark, sf_dir, out_dir)
    return merge_reports_plan(spark, out_dir, I.CHUNKS, SPEC.report_fields)


def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged report's rows with their numbers: by file, so by chunk."""
    out_dir = new_folder(spark, "audit")
    _audit(spark, sf_dir, out_dir)
    rows = merge_reports_plan(spark, out_dir, I.CHUNKS, SPEC.report_fields, numbered=True)
    doc_id = F.regexp_extract("tweet_url", r"(\d+)$", 1).cast("long")
    return rows.select("number", F.pmod(doc_id, F.lit(I.CHUNKS)).cast("int").alias("chunk_id"))


def merge_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged report as it is read from where it was written."""
    out_dir = new_folder(spark, "audit")
    _audit(spark, sf_dir, out_dir)
    return publish_merged(spark, SPEC, out_dir)


def merge_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file per chunk, with columns in different order, missing or more: the first file's columns count."""
    folder = I.report_files(spark, sf_dir)
    return merge_files(spark, folder, I.CHUNKS)


def audit_from_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from an archive on disk."""
    spec = dataclasses.replace(SPEC, archive_path=I.archive(spark, sf_dir), store_path=new_folder(spark, "store"), output_path=new_folder(spark, "out"))
    return audit_archive(spark, spec, rule_scorer(spec), "r1").merged.select("item_id", F.col("item_url").alias("tweet_url"), "deletion", "reason")


def audit_new_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose verdicts were made under other criteria, or none: all posts are decided anew."""
    store, out_dir = I.warm_store(spark, sf_dir), new_folder(spark, "audit")
    run = run_audit(I.items(spark, sf_dir), store, rule_scorer(SPEC), SPEC, out_dir, "r1", match_criteria=True)
    return run.merged.select("item_id", "deletion", "reason")


def run_audit_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with partly useless answers, then a second one for what is missing."""
    posts, store = I.items(spark, sf_dir), I.new_store(spark)
    run_audit(posts, store, I.bent_scorer, SPEC, new_folder(spark, "audit"), "r1")
    second = run_audit(posts, store, rule_scorer(SPEC), SPEC, new_folder(spark, "audit"), "r2")
    return second.merged.select("item_id", "deletion", "reason")


def retry_what_is_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one round allowed, only posts whose failure has no id come again."""
    posts, store = I.items(spark, sf_dir), I.new_store(spark)
    store.append(I.bent_scorer(posts, ""), "r1")
    return retry_pending(posts, store, max_rounds=1).select("item_id")


QUERIES = {
    f.__name__: f
    for f in [
        scan_archive, scan_responses, resolve_id, drop_invalid_ids, build_url, assign_chunk, select_chunk,
        render_prompt, build_requests, requests_jsonl, score_rules, score_with_client, response_lines,
        extract_text, validate_verdict, parse_verdict, response_stats, failures_by_reason, failed_ids,
        collect_responses, store_latest, store_upsert, store_clear, store_compact, pending_anti_join,
        cached_semi_join, cached_lookup, missing_items, cache_stats, merge_dedupe, merge_by_chunk, keep_last,
        report_csv, report_full, chunk_completeness, coverage_stats, merge_reports, run_audit_rerun,
        retry_what_is_missing, score_resumed, score_with_failures, match_dictionary, collect_two_streams,
        assign_chunk_parts, empty_chunks, merge_ordered, merge_written, merge_report_files, audit_from_archive,
        audit_new_criteria,
    ]
} | {"run_audit": run_audit_query}
