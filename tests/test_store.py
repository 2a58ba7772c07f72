import pytest

from siftwell.operators.pending import cached_lookup, missing_items, split_pending
from siftwell.operators.responses import good, parse_responses
from siftwell.sources.store import VerdictStore
from tests.helpers import answer


@pytest.fixture
def store(spark, tmp_path):
    return VerdictStore.open(spark, str(tmp_path / "store"))


def decisions(df):
    return {r.item_id: r.deletion for r in df.collect()}


def test_new_store_is_empty(store):
    assert store.latest().count() == 0
    assert store.ids().count() == 0
    assert store.failures().count() == 0


def test_opening_again_keeps_what_is_there(spark, store, responses):
    store.append(parse_responses(responses([answer("a")])), "r1")
    again = VerdictStore.open(spark, store.path)
    assert decisions(again.latest()) == {"a": "KEEP"}


def test_last_write_wins(store, responses):
    store.append(parse_responses(responses([answer("a"), answer("b"), answer("b", deletion="DELETE")])), "r1")
    assert decisions(store.latest()) == {"a": "KEEP", "b": "DELETE"}
    store.append(parse_responses(responses([answer("a", deletion="DELETE")])), "r2")
    assert decisions(store.latest()) == {"a": "DELETE", "b": "DELETE"}
    assert decisions(store.latest(without_run="r2")) == {"a": "KEEP", "b": "DELETE"}


def test_same_run_replaces_its_rows(store, responses):
    store.append(parse_responses(responses([answer("a"), "junk"])), "r1")
    store.append(parse_responses(responses([answer("b")])), "r1")
    assert decisions(store.verdicts()) == {"b": "KEEP"}
    assert store.failures().count() == 0


def test_numeric_run_ids_stay_text(store, responses):
    store.append(parse_responses(responses([answer("a")])), "007")
    assert store.verdicts(run_id="007").count() == 1
    assert store.verdicts().first()["run_id"] == "007"
    with pytest.raises(ValueError):
        store.append(parse_responses(responses([answer("a")])), "../x")


def test_failures_lie_apart_from_verdicts(store, responses):
    store.append(parse_responses(responses([answer("a"), "junk", answer("b")[:-5]])), "r1")
    assert decisions(store.latest()) == {"a": "KEEP"}
    assert [r.fail_reason for r in store.failures().collect()] == ["bad_line", "bad_line"]
    plan = store.ids()._jdf.queryExecution().executedPlan().toString()
    assert "outcome" in plan and "PartitionFilters" in plan


def test_clear_starts_anew_and_is_idempotent_per_run(spark, store, responses):
    store.append(parse_responses(responses([answer("a"), answer("b")])), "r1")
    assert store.clear("r2") is True
    assert store.latest().count() == 0
    store.append(parse_responses(responses([answer("c")])), "r2")
    assert store.clear("r2") is False
    assert decisions(store.latest()) == {"c": "KEEP"}
    assert VerdictStore.open(spark, store.path).generation == 1


def test_compaction_keeps_the_latest(spark, store, responses):
    store.append(parse_responses(responses([answer("a"), answer("b"), answer("a", deletion="DELETE")])), "r1")
    store.append(parse_responses(responses([answer("b", deletion="N/A"), "junk"])), "r2")
    before = store.latest().drop("ord").collect()
    store.compact("c1")
    assert store.verdicts().count() == 2
    key = lambda r: r.store_key
    assert sorted(store.latest().drop("ord").collect(), key=key) == sorted(before, key=key)


def test_criteria_can_be_matched(store, responses):
    store.append(parse_responses(responses([answer("a")]), "old"), "r1")
    store.append(parse_responses(responses([answer("b")]), "new"), "r2")
    assert decisions(store.latest()) == {"a": "KEEP", "b": "KEEP"}
    assert decisions(store.latest(criteria_hash="new")) == {"b": "KEEP"}


def test_split_by_store(store, posts, responses):
    items = posts([(f"post_{i}", "t") for i in range(10)] + [("post_1", "again"), (" post_2 ", "blank around")])
    store.append(parse_responses(responses([answer("post_1"), answer("post_2"), answer("other")])), "r1")
    pending, cached = split_pending(items, store.ids())
    assert sorted(r.item_id for r in pending.collect()) == sorted(f"post_{i}" for i in range(10) if i not in (1, 2))
    assert sorted(r.item_id for r in cached.collect()) == [" post_2 ", "post_1", "post_1", "post_2"]
    assert pending.columns == items.columns


def test_empty_store_leaves_all_pending_and_full_store_none(store, posts, responses):
    items = posts([("a", "t"), ("b", "t")])
    assert split_pending(items, store.ids())[0].count() == 2
    store.append(parse_responses(responses([answer("a"), answer("b")])), "r1")
    assert split_pending(items, store.ids())[0].count() == 0


def test_lookup_takes_the_posts_chunk(store, posts, responses):
    items = posts([("a", "t"), ("b", "t"), ("c", "t")])
    store.append(parse_responses(responses([answer("b"), answer("b", deletion="DELETE")], chunk_id=4)), "r1")
    rows = cached_lookup(items, store.latest()).collect()
    assert [(r.item_id, r.chunk_id, r.deletion) for r in rows] == [("b", 1, "DELETE")]


def test_missing_are_listed_once(posts, responses):
    items = posts([("a", "t"), ("b", "t"), ("c", "t"), ("c", "t")], n=1)
    have = good(parse_responses(responses([answer("a"), "junk"])))
    assert sorted(r.item_id for r in missing_items(items, have).collect()) == ["b", "c"]


def test_missing_items_compares_ids_as_the_store_does(spark, posts):
    items = posts([(" 4", "x"), ("5", "y")])
    have = spark.createDataFrame([("4",)], "item_id string")
    assert [r.item_id for r in missing_items(items, have).collect()] == ["5"]


def test_clear_after_a_failed_compaction_is_empty(spark, store, responses, monkeypatch):
    store.append(parse_responses(responses([answer("a"), answer("b")])), "r1")

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(VerdictStore, "_commit", lost)
        store.compact("c1")
    assert VerdictStore.open(spark, store.path).verdicts().count() == 2
    again = VerdictStore.open(spark, store.path)
    again.clear("r2")
    assert again.verdicts().count() == 0
    assert VerdictStore.open(spark, store.path).verdicts().count() == 0


def test_answers_appended_after_a_compaction_by_another_job_are_kept(spark, store, responses):
    store.append(parse_responses(responses([answer("a"), answer("b")])), "r1")
    held = VerdictStore.open(spark, store.path)
    assert held.ids().count() == 2
    VerdictStore.open(spark, store.path).compact("c1")
    held.append(parse_responses(responses([answer("c"), answer("d"), answer("a", deletion="DELETE")])), "r2")
    now = VerdictStore.open(spark, store.path)
    assert decisions(now.latest()) == {"a": "DELETE", "b": "KEEP", "c": "KEEP", "d": "KEEP"}
    assert decisions(held.latest()) == decisions(now.latest())
    now.compact("c2")
    assert decisions(VerdictStore.open(spark, store.path).latest()) == {"a": "DELETE", "b": "KEEP", "c": "KEEP", "d": "KEEP"}


def test_a_compaction_keeps_times_and_runs(spark, store, responses):
    """Rows that were appended while a compaction ran stay newer than what it folded."""
    store.append(parse_responses(responses([answer("a"), answer("b")])), "r1")
    store.append(parse_responses(responses([answer("a", deletion="DELETE")])), "r2")
    times = {r.store_key: r.written_at for r in store.verdicts().orderBy("written_at").collect()}
    store.compact("c1")
    assert {r.store_key: (r.run_id, r.written_at) for r in store.verdicts().collect()} == {k: ("c1", t) for k, t in times.items()}
    assert decisions(store.verdicts(run_id="r2")) == {"a": "DELETE"}
    assert decisions(store.latest(without_run="r2")) == {"b": "KEEP"}
    store.append(parse_responses(responses([answer("z")])), "r2")
    again = VerdictStore.open(spark, store.path)
    assert decisions(again.latest()) == {"b": "KEEP", "z": "KEEP"}


def test_a_compaction_is_void_if_the_store_was_cleared_meanwhile(spark, store, responses, monkeypatch):
    store.append(parse_responses(responses([answer("a")])), "r1")
    real = VerdictStore._record

    def cleared_first(self, known, kind, *rest, **more):
        if kind == "fold":
            other = VerdictStore.open(spark, store.path)
            other.clear("r9")
            other.append(parse_responses(responses([answer("n")])), "r9")
        real(self, known, kind, *rest, **more)

    with monkeypatch.context() as m:
        m.setattr(VerdictStore, "_record", cleared_first)
        store.compact("c1")
    assert decisions(VerdictStore.open(spark, store.path).latest()) == {"n": "KEEP"}


def test_two_compactions_at_once_count_once(spark, store, responses):
    store.append(parse_responses(responses([answer("a"), answer("b")])), "r1")
    one, two = (VerdictStore.open(spark, store.path) for _ in range(2))
    one.compact("c1")
    stale = two.snapshot
    assert stale.batches()
    two.compact("c2")
    assert VerdictStore.open(spark, store.path).verdicts().count() == 2


def test_a_handle_works_on_what_it_opened(spark, store, responses):
    store.append(parse_responses(responses([answer("a")])), "r1")
    held = VerdictStore.open(spark, store.path)
    assert held.ids().count() == 1
    store.append(parse_responses(responses([answer("b")])), "r2")
    store.clear("r3")
    assert decisions(held.latest()) == {"a": "KEEP"}
    assert decisions(VerdictStore.open(spark, store.path).latest()) == {}


def test_readers_list_committed_folders_only(spark, store, responses):
    store.append(parse_responses(responses([answer("a")])), "r1")
    store.append(parse_responses(responses([answer("b")])), "r2")
    folder = f"{store.path}/log/batch=b-dead/outcome=verdict"
    spark.createDataFrame([("x",)], "store_key string").write.text(folder)
    spark.createDataFrame([("no parquet",)], "value string").write.mode("overwrite").text(folder)
    again = VerdictStore.open(spark, store.path)
    assert decisions(again.latest()) == {"a": "KEEP", "b": "KEEP"}
    store.compact("c1")
    files = VerdictStore.open(spark, store.path).ids().inputFiles()
    [batch] = VerdictStore.open(spark, store.path).snapshot.batches()
    assert files and all(f"batch={batch}/" in f for f in files)


def test_snapshots_don_t_depend_on_the_order_commits_are_read(spark):
    import itertools

    from siftwell.sources.store import APPEND, CLEAR, FOLD, Commit, Snapshot

    events = [
        Commit(1, "a", APPEND, "r1", "b1"),
        Commit(2, "b", APPEND, "r2", "b2"),
        Commit(3, "c", FOLD, "c1", "b3", ["b1", "b2"], ["r1", "r2"]),
        Commit(3, "d", APPEND, "r2", "b4"),
        Commit(5, "e", CLEAR, "r5", None, ["b4"]),
    ]
    seen = {tuple(Snapshot.of(list(p)).batches()) for p in itertools.permutations(events)}
    assert seen == {("b3",)}
    assert Snapshot.of(events).replaced == {"b3": {"r2"}}


def test_a_commit_passes_through_no_python_worker(spark, responses, tmp_path, monkeypatch):
    """A stream commits each of its batches, so a commit's own cost counts; what it says is kept as it is."""
    from siftwell.operators.responses import parse_responses

    store = VerdictStore.open(spark, str(tmp_path / "store"))
    answers = parse_responses(responses([answer("a")]))

    def refuse(*_, **__):
        raise AssertionError("rows from the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    for run in ("r-1.a", "r2"):
        store.append(answers, run)
    store.compact("r3")
    assert VerdictStore.open(spark, store.path).snapshot == store.snapshot
    assert [c.runs for c in store.snapshot.commits.values()] == [["r-1.a", "r2"]]
