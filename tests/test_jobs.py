import json
import os

import pytest

from siftwell.operators.requests import render_requests
from siftwell.operators.scoring import score_rules, score_with_client
from siftwell.plans.audit import audit_archive, client_scorer, retry_pending, rule_scorer, run_audit
from siftwell.plans.merging import merge_reports
from siftwell.sources.responses import scan_scored
from siftwell.sources.store import VerdictStore
from siftwell.spec import load_spec
from siftwell.streaming.collector import collect_responses
from tests.helpers import answer, keep_all_factory


@pytest.fixture
def store(spark, tmp_path):
    return VerdictStore.open(spark, str(tmp_path / "store"))


def requests(posts, spec, n=20):
    items = posts([(f"p{i}", f"text {i}") for i in range(n)])
    return render_requests(items, spec.criteria, spec.url)


def asked(folder):
    return sorted(int(open(os.path.join(folder, f)).read()) for f in os.listdir(folder))


def test_word_rule(posts, spec):
    texts = ["Darn it", "darned", "oh heck, DARN!", "x_heck_y", "", None, "hêck heck-ish", "HECK2"]
    rows = score_rules(posts([(str(k), t) for k, t in enumerate(texts)]), spec.criteria, spec.url).collect()
    got = {int(r.item_id): (r.explicit_words, r.deletion) for r in rows}
    assert got == {
        0: (["darn"], "DELETE"),
        1: ([], "KEEP"),
        2: (["darn", "heck"], "DELETE"),
        3: (["heck"], "DELETE"),
        4: ([], "KEEP"),
        5: ([], "KEEP"),
        6: (["heck"], "DELETE"),
        7: ([], "KEEP"),
    }
    assert json.loads(rows[0].raw)["explicit_words"] == rows[0].explicit_words


def test_word_rule_with_phrases_and_without_words(posts, spec):
    from siftwell.spec import Criteria

    items = posts([("0", "Hot, garbage here"), ("1", "hot garbages"), ("2", "plain hot")])
    score = lambda words: {
        r.item_id: r.explicit_words for r in score_rules(items, Criteria(words), spec.url).collect()
    }
    assert score(["hot garbage", "hot"]) == {"0": ["hot", "hot garbage"], "1": ["hot"], "2": ["hot"]}
    assert score([]) == {"0": [], "1": [], "2": []}


def test_client_is_asked_in_batches_of_one_chunk(posts, spec, tmp_path):
    rows = score_with_client(
        requests(posts, spec).coalesce(1), keep_all_factory(str(tmp_path)), batch_size=3
    ).collect()
    assert sorted(json.loads(r.line)["key"] for r in rows) == sorted(f"p{i}" for i in range(20))
    assert asked(tmp_path) == [1] * 5 + [3] * 5
    assert all(r.chunk_id == int(json.loads(r.line)["key"][1:]) % 5 for r in rows)


def test_rate_limits_are_tried_again_with_growing_waits(posts, spec, tmp_path):
    waits = tmp_path / "waits"
    waits.mkdir()

    def sleep(seconds):
        import uuid

        (waits / f"{seconds}-{uuid.uuid4().hex}").touch()

    one_chunk = requests(posts, spec).where("chunk_id = 0").coalesce(1)
    rows = score_with_client(one_chunk, keep_all_factory(fail_first=2), max_retries=3, sleep=sleep).collect()
    assert len(rows) == 4 and all(r.submit_error is None for r in rows)
    assert sorted(x.name.split("-")[0] for x in waits.iterdir()) == ["1", "2"]


@pytest.mark.parametrize("error, calls", [("RESOURCE_EXHAUSTED", 3), ("bad request", 1)])
def test_lost_batches_become_failures(spark, posts, spec, store, tmp_path, error, calls):
    log = tmp_path / "log"
    log.mkdir()
    factory = keep_all_factory(str(log), fail_first=99, error=error)
    one_chunk = requests(posts, spec).where("chunk_id = 0").coalesce(1)
    rows = score_with_client(one_chunk, factory, max_retries=3, sleep=lambda s: None)
    rows.write.parquet(str(tmp_path / "answers"))
    assert len(asked(log)) == calls
    from siftwell.operators.responses import failed, parse_responses

    lost = failed(parse_responses(scan_scored(spark, str(tmp_path / "answers")))).collect()
    assert sorted((r.item_id, r.stage, r.fail_reason, r.chunk_id) for r in lost) == [
        (f"p{i}", "submit", "submit_failed", 0) for i in (0, 10, 15, 5)
    ]
    assert all(error in r.line for r in lost)


def test_no_posts_no_call(posts, spec, tmp_path):
    none = requests(posts, spec).where("key = 'absent'")
    assert score_with_client(none, keep_all_factory(str(tmp_path))).collect() == []
    assert asked(tmp_path) == []


def test_second_run_asks_for_nothing(spark, posts, spec, store, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    items = posts([(f"p{i}", f"text {i}") for i in range(30)])
    scorer = client_scorer(spec, keep_all_factory(str(log)), partitions=3)
    first = run_audit(items, store, scorer, spec, str(tmp_path / "o1"), "r1")
    assert first.report.count() == 30 and sum(asked(log)) == 30
    second = run_audit(items, store, scorer, spec, str(tmp_path / "o2"), "r2")
    assert sum(asked(log)) == 30
    assert sorted(second.report.collect()) == sorted(first.report.collect())
    assert {(r.n_uncached, r.n_cached, r.n_missing) for r in second.stats.collect()} == {(0, 6, 0)}


def test_repeating_a_run_id_replaces_the_run(posts, spec, store, tmp_path):
    items = posts([(f"p{i}", "heck") for i in range(7)])
    for _ in range(2):
        result = run_audit(items, store, rule_scorer(spec), spec, str(tmp_path / "o"), "r1")
    assert result.report.count() == 7 and store.verdicts().count() == 7
    assert [r.n_uncached for r in result.stats.orderBy("chunk_id").collect()] == [2, 2, 1, 1, 1]


def test_run_reports_and_counts(spark, posts, spec, store, responses, tmp_path):
    from siftwell.operators.responses import parse_responses

    store.append(parse_responses(responses([answer("p0", deletion="DELETE")])), "r0")
    items = posts([("p0", "t"), ("p1", "heck"), ("p2", "t"), (None, "no id"), ("p1", "again")])

    def scorer(pending, folder):
        lines = ["junk"] + [answer(r.item_id) for r in pending.collect() if r.item_id != "p2"]
        return parse_responses(responses(lines))

    result = run_audit(items, store, scorer, spec, str(tmp_path / "o"), "r1")
    assert sorted((r.item_id, r.deletion) for r in result.merged.collect()) == [("p0", "DELETE"), ("p1", "KEEP")]
    assert [r.item_id for r in result.missing.collect()] == ["p2"]
    assert sorted((r.stage, r.fail_reason) for r in result.failures.collect()) == [("id", "no_id"), ("parse", "bad_line")]
    stats = {r.chunk_id: r for r in result.stats.collect()}
    assert set(stats) == set(range(5))
    assert (stats[0].n_total, stats[0].n_cached, stats[0].n_ok, stats[0].n_failed) == (1, 1, 2, 1)
    assert (stats[2].n_total, stats[2].n_missing, stats[3].n_total) == (1, 1, 0)
    merged = merge_reports(spark, str(tmp_path / "o"), 5, spec.report_fields, ordered=True)
    assert merged.columns == spec.report_fields and merged.count() == 2
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["failures", "full", "merged", "report", "stats"]


def test_all_cached_still_reports(spark, posts, spec, store, responses, tmp_path):
    from siftwell.operators.responses import parse_responses

    store.append(parse_responses(responses([answer("a"), answer("b")])), "r0")
    result = run_audit(posts([("a", "t"), ("b", "t")]), store, rule_scorer(spec), spec, str(tmp_path / "o"), "r1")
    assert result.report.count() == 2
    assert merge_reports(spark, str(tmp_path / "o"), 5, spec.report_fields).count() == 2


def test_changed_criteria_only_matter_when_matched(posts, spec, store, tmp_path):
    from dataclasses import replace

    from siftwell.spec import Criteria

    items = posts([("a", "fudge"), ("b", "t")])
    run_audit(items, store, rule_scorer(spec), spec, str(tmp_path / "o1"), "r1")
    changed = replace(spec, criteria=Criteria(["fudge"]))
    stale = run_audit(items, store, rule_scorer(changed), changed, str(tmp_path / "o2"), "r2")
    assert {r.deletion for r in stale.report.collect()} == {"KEEP"}
    fresh = run_audit(items, store, rule_scorer(changed), changed, str(tmp_path / "o3"), "r3", match_criteria=True)
    assert {r.tweet_url[-1]: r.deletion for r in fresh.report.collect()} == {"a": "DELETE", "b": "KEEP"}


def test_retry_stops_at_the_bound(posts, store, responses):
    from siftwell.operators.responses import parse_responses
    from tests.helpers import envelope

    items = posts([("a", "t"), ("b", "t"), ("c", "t")])
    store.append(parse_responses(responses([answer("a"), envelope("b", "no"), envelope("b", "no")])), "r1")
    assert sorted(r.item_id for r in retry_pending(items, store, 2).collect()) == ["b", "c"]
    store.append(parse_responses(responses([envelope("b", "no"), envelope("c", "no")])), "r2")
    assert sorted(r.item_id for r in retry_pending(items, store, 2).collect()) == ["c"]
    assert sorted(r.item_id for r in retry_pending(items, store, 3).collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        retry_pending(items, store, 0)


def test_collector_takes_each_file_once(spark, store, tmp_path):
    inbox, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    inbox.mkdir()
    run = lambda: collect_responses(spark, str(inbox), store, checkpoint).awaitTermination()
    (inbox / "answers_chunk_0.jsonl").write_text(answer("a") + "\n" + answer("b") + "\njunk\n")
    run()
    run()
    assert store.verdicts().count() == 2 and store.failures().first()["chunk_id"] == 0
    (inbox / "answers_chunk_1.jsonl").write_text(answer("b", deletion="DELETE"))
    run()
    assert {r.item_id: r.deletion for r in store.latest().collect()} == {"a": "KEEP", "b": "DELETE"}
    runs = sorted(r.run_id for r in store.verdicts().select("run_id").distinct().collect())
    assert [r.split("-")[0] + "-" + r.split("-")[2] for r in runs] == ["collect-0", "collect-1"] and len({r.split("-")[1] for r in runs}) == 1


def test_replayed_batch_leaves_one_copy(spark, store, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "answers_chunk_0.jsonl").write_text(answer("a") + "\n" + answer("b"))
    checkpoint = tmp_path / "cp"
    collect_responses(spark, str(inbox), store, str(checkpoint)).awaitTermination()
    for commit in (checkpoint / "commits").glob("*0*"):  # batch 0 was stored but never committed
        commit.unlink()
    collect_responses(spark, str(inbox), store, str(checkpoint)).awaitTermination()
    assert store.verdicts().count() == 2


def test_collections_of_two_folders_are_both_kept(spark, store, tmp_path):
    for name, ids in (("x", "ab"), ("y", "cd")):
        inbox = tmp_path / name
        inbox.mkdir()
        (inbox / "answers_chunk_0.jsonl").write_text("\n".join(answer(i) for i in ids))
        collect_responses(spark, str(inbox), store, str(tmp_path / f"cp-{name}")).awaitTermination()
    assert sorted(r.item_id for r in store.verdicts().collect()) == ["a", "b", "c", "d"]


def settings(tmp_path, **changes):
    raw = {
        "criteria": {
            "forbidden_words": ["heck"],
            "topics_to_exclude": [],
            "tone_requirements": [],
            "additional_instructions": "",
        },
        "cache": {"directory": "store", "enabled": True},
        "processing": {"number_of_chunks": 3, "default_csv_fields": ["tweet_url", "deletion"]},
        "model": {"primary": "m1", "secondary": "m2", "max_retries": 3},
        "batch_files": {"directory": "batches"},
        "run_defaults": {"file_path": "posts.js", "output_path": "out", "clear_cache": False},
        "url_builder": {"user": "me", "base_url": "https://posts.example/{user}/{id}"},
    }
    raw.update(changes)
    file = tmp_path / "settings.json"
    file.write_text(json.dumps({k: v for k, v in raw.items() if v is not None}))
    return file


def test_settings_file(tmp_path):
    spec = load_spec(settings(tmp_path))
    assert spec.criteria.forbidden_words == ["heck"] and spec.number_of_chunks == 3
    assert spec.archive_path == str((tmp_path / "posts.js").resolve())
    assert spec.store_path == str((tmp_path / "store").resolve())


def test_bad_settings(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_spec(tmp_path / "absent.json")
    with pytest.raises(TypeError, match="criteria"):
        load_spec(settings(tmp_path, criteria=None))
    with pytest.raises(TypeError):
        load_spec(settings(tmp_path, url_builder={"user": "me"}))
    with pytest.raises(ValueError, match="number_of_chunks"):
        load_spec(settings(tmp_path, processing={"number_of_chunks": 0, "default_csv_fields": []}))
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(ValueError):
        load_spec(tmp_path / "broken.json")


def test_from_archive_to_report(spark, tmp_path):
    archive = [{"tweet": {"id_str": str(i), "full_text": "heck" if i % 4 == 0 else "fine"}} for i in range(10)]
    (tmp_path / "posts.js").write_text("window.p = " + json.dumps(archive))
    spec = load_spec(settings(tmp_path))
    audit_archive(spark, spec, rule_scorer(spec), "r1")
    rows = merge_reports(spark, f"{spec.output_path}/r1", 3, spec.report_fields).collect()
    assert {r.tweet_url: r.deletion for r in rows} == {
        f"https://posts.example/me/{i}": "DELETE" if i % 4 == 0 else "KEEP" for i in range(10)
    }
    again = audit_archive(spark, spec, rule_scorer(spec), "r2")
    assert {r.n_uncached for r in again.stats.collect()} == {0}
    cleared = load_spec(settings(tmp_path, run_defaults={"file_path": "posts.js", "output_path": "out", "clear_cache": True}))
    fresh = audit_archive(spark, cleared, rule_scorer(cleared), "r3")
    assert sum(r.n_uncached for r in fresh.stats.collect()) == 10
