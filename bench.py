"""Times the headline stages and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Inputs that a stage
reads (archive, answer files, warm store) are written beforehand and not timed.
Every stage runs once unmeasured and then BENCH_ROUNDS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from siftwell.operators import merge, pending, requests, responses, scoring  # noqa: E402
from siftwell.operators.items import assign_chunks, resolve_ids  # noqa: E402
from siftwell.plans.audit import client_scorer, rule_scorer, run_audit  # noqa: E402
from siftwell.plans.merging import merge_reports  # noqa: E402
from siftwell.session import RECOMMENDED_CONF, new_folder  # noqa: E402
from siftwell.sinks.writers import write_requests  # noqa: E402
from siftwell.sources.archive import scan_archive  # noqa: E402
from siftwell.sources.responses import scan_responses  # noqa: E402
from siftwell.streaming.collector import collect_responses  # noqa: E402
from workload import inputs as I  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "2"))
SPEC = I.SPEC


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("siftwell-bench")
    conf = {
        **RECOMMENDED_CONF,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": CPUS,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="siftwell-bench-"),
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark: SparkSession) -> dict:
    posts = I.items(spark, SF_DIR)
    archive = I.archive(spark, SF_DIR)
    answers = I.answer_folder(spark, posts)
    warm = I.warm_store(spark, SF_DIR)
    answered = I.new_store(spark)
    answered.append(responses.parse_responses(scan_responses(spark, answers)), "r0")
    done = new_folder(spark, "audit")
    run_audit(posts, answered, rule_scorer(SPEC), SPEC, done, "r1")
    folder = lambda: new_folder(spark, "bench")
    client = client_scorer(SPEC, I.rule_client_factory(), partitions=int(CPUS))
    fresh = lambda: responses.parse_responses(scan_responses(spark, answers))

    def archive_to_requests():
        items = assign_chunks(resolve_ids(scan_archive(spark, archive)), I.CHUNKS)
        write_requests(requests.render_requests(items, SPEC.criteria, SPEC.url), folder())

    def collect():
        collect_responses(spark, answers, I.new_store(spark), folder()).awaitTermination()

    return {
        "scan_archive": lambda: drain(scan_archive(spark, archive)),
        "archive_to_requests": archive_to_requests,
        "render_requests": lambda: drain(requests.request_lines(requests.render_requests(posts, SPEC.criteria, SPEC.url))),
        "score_rules": lambda: drain(scoring.score_rules(posts, SPEC.criteria, SPEC.url)),
        "score_with_client": lambda: drain(client(posts, folder())),
        "parse_responses": lambda: drain(fresh()),
        "parse_to_store": lambda: I.new_store(spark).append(fresh(), "r0"),
        "collect_responses": collect,
        "pending_anti_join": lambda: drain(pending.pending_items(posts, warm.ids())),
        "cached_lookup": lambda: drain(pending.cached_lookup(posts, warm.latest())),
        "store_latest": lambda: drain(answered.latest()),
        "merge_dedupe": lambda: drain(merge.merge_verdicts(answered.verdicts("r0"), answered.verdicts("r1"))),
        "merge_reports": lambda: drain(merge_reports(spark, done, I.CHUNKS, SPEC.report_fields)),
        "run_audit_cold": lambda: run_audit(posts, I.new_store(spark), rule_scorer(SPEC), SPEC, folder(), "b"),
        "run_audit_warm": lambda: run_audit(posts, warm, rule_scorer(SPEC), SPEC, folder(), "b"),
        "run_audit_rerun": lambda: run_audit(posts, answered, rule_scorer(SPEC), SPEC, folder(), "b"),
    }


def main() -> None:
    spark = session()
    n_posts = I.items(spark, SF_DIR).count()
    seconds = {}
    for name, stage in stages(spark).items():
        stage()
        taken = []
        for _ in range(ROUNDS):
            start = time.perf_counter()
            stage()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "audit_stages_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "posts": n_posts,
                "posts_per_sec": {k: round(n_posts / v) for k, v in seconds.items()},
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
