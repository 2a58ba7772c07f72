"""What a client was paid for stays paid for, and what failed is tried again at its time."""

import json
import os
import uuid
from collections import Counter

import pytest

from siftwell.operators.requests import render_requests
from siftwell.operators.responses import parse_responses
from siftwell.operators.scoring import ask_until_done
from siftwell.plans.audit import client_scorer, run_audit
from siftwell.sources.ledger import AnswerLedger
from siftwell.sources.store import VerdictStore
from tests.helpers import answer


def note(folder, *keys):
    for key in keys:
        open(os.path.join(folder, f"{key}-{uuid.uuid4().hex}"), "w").close()


def asked(folder):
    return Counter(f.rsplit("-", 1)[0] for f in os.listdir(folder))


def factory(folder, busy=None, broken=(), dies=None):
    """Clients that note what they are asked; busy: how often each key is refused; dies: the partition whose first client does."""

    class NotingClient:
        def run_batch(self, lines):
            keys = [json.loads(x)["key"] for x in lines]
            note(folder, *keys)
            seen = asked(folder)
            for k in keys:
                if k in broken:
                    raise ValueError("bad request")
                if seen[k] <= (busy or {}).get(k, 0):
                    raise RuntimeError("429 RESOURCE_EXHAUSTED")
            return [answer(k) for k in keys]

    def make():
        import time

        from pyspark import TaskContext

        if dies is not None and TaskContext.get().partitionId() == dies[0] and not os.path.exists(dies[1]):
            open(dies[1], "w").close()
            # The others are done by then, and their files are in place.
            time.sleep(4)
            raise RuntimeError("driver lost")
        return NotingClient()

    return make


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def outcome(responses):
    rows = parse_responses(responses).collect()
    return sorted(r.item_id for r in rows if not r.fail_reason), sorted((r.item_id, r.fail_reason, r.line) for r in rows if r.fail_reason)


def test_a_lost_run_goes_on_where_it_stopped(spark, posts, spec, log, tmp_path):
    items = posts([(f"p{i}", f"text {i}") for i in range(40)]).repartition(4)
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"))
    render = lambda rows: render_requests(rows, spec.criteria, spec.url)
    with pytest.raises(Exception, match="driver lost"):
        ask_until_done(items, render, factory(log, dies=(1, str(tmp_path / "died"))), ledger)
    first = asked(log)
    assert 20 <= sum(first.values()) < 40
    done, lost = outcome(ask_until_done(items, render, factory(log), ledger))
    assert done == sorted(f"p{i}" for i in range(40)) and not lost
    assert set(asked(log).values()) == {1} and len(asked(log)) == 40
    ask_until_done(items, render, factory(log), ledger)
    assert sum(asked(log).values()) == 40


def test_a_repeated_run_asks_for_nothing_and_other_criteria_for_all(spark, posts, spec, log, tmp_path):
    import dataclasses

    items = posts([(f"p{i}", f"text {i}") for i in range(9)])
    store = VerdictStore.open(spark, str(tmp_path / "store"))
    for _ in range(2):
        result = run_audit(items, store, client_scorer(spec, factory(log)), spec, str(tmp_path / "o"), "r1")
        assert result.report.count() == 9
    assert set(asked(log).values()) == {1}
    other = dataclasses.replace(spec, criteria=dataclasses.replace(spec.criteria, additional_instructions="new"))
    run_audit(items, store, client_scorer(other, factory(log)), other, str(tmp_path / "o"), "r1")
    assert set(asked(log).values()) == {2} and store.verdicts().count() == 9


def test_faults_wait_in_a_queue(spark, posts, spec, log, tmp_path):
    items = posts([(f"p{i}", f"text {i}") for i in range(6)])
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"))
    render = lambda rows: render_requests(rows, spec.criteria, spec.url)
    waits = []
    make = factory(log, busy={"p1": 1, "p2": 2, "p3": 99}, broken=("p4",))
    done, lost = outcome(ask_until_done(items, render, make, ledger, max_attempts=3, batch_size=1, clock=lambda: 0.0, sleep=waits.append))
    assert done == ["p0", "p1", "p2", "p5"]
    assert [(i, r) for i, r, _ in lost] == [("p3", "submit_failed"), ("p4", "submit_failed")]
    assert "429" in lost[0][2] and "bad request" in lost[1][2]
    assert asked(log) == {"p0": 1, "p1": 2, "p2": 3, "p3": 3, "p4": 1, "p5": 1}
    assert waits == [1.0, 2.0]
    assert sorted((r.key, r.attempt, r.again) for r in ledger.given_up(3).collect()) == [("p3", 3, True), ("p4", 1, False)]


def test_a_queue_left_by_a_lost_run_is_taken_up(spark, posts, spec, log, tmp_path):
    items = posts([(f"p{i}", f"text {i}") for i in range(4)])
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"))
    render = lambda rows: render_requests(rows, spec.criteria, spec.url)

    def lost(seconds):
        raise RuntimeError("driver lost")

    make = factory(log, busy={"p1": 1})
    with pytest.raises(RuntimeError, match="lost"):
        ask_until_done(items, render, make, ledger, batch_size=1, clock=lambda: 0.0, sleep=lost)
    done, failed = outcome(ask_until_done(items, render, make, ledger, batch_size=1, clock=lambda: 0.0, sleep=lambda s: None))
    assert len(done) == 4 and not failed
    assert asked(log) == {"p0": 1, "p1": 2, "p2": 1, "p3": 1}


def test_no_posts_leave_an_empty_ledger(spark, posts, spec, log, tmp_path):
    items = posts([("p", "t")]).where("false")
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"))
    found = ask_until_done(items, lambda rows: render_requests(rows, spec.criteria, spec.url), factory(log), ledger)
    assert found.collect() == [] and ledger.is_new() and not asked(log)


def test_no_more_than_a_call_s_lines_leave_a_batch(spec):
    """Chunks come in order, nulls last, and of 40 MB of lines only those of one call are Python texts at a time."""
    import tracemalloc

    import pyarrow as pa

    from siftwell.operators.scoring import ask

    n = 10_000
    rows = pa.RecordBatch.from_arrays(
        [
            pa.array([None if k % 5 == 4 else (7 * k) % 5 for k in range(n)], pa.int32()), pa.array([f"p{k}" for k in range(n)]),
            pa.array([f"{k} ".ljust(4000, "x") for k in range(n)]), pa.array([b"%d" % k for k in range(n)]), pa.array([0] * n, pa.int32()),
        ],
        ["chunk_id", "key", "line", "request", "attempt"],
    )

    class Client:
        def run_batch(self, lines):
            if lines[0].startswith("4 "):
                raise RuntimeError("429")
            return [x.split()[0] for x in lines]

    class Requests:
        def mapInArrow(self, run, schema):
            return run(iter([rows]))

    tracemalloc.start()
    out = list(ask(Requests(), Client, batch_size=500, clock=lambda: 1.0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20
    table = pa.Table.from_batches(out).to_pylist()
    answers = [r for r in table if r["kind"] == "answer"]
    assert [r["chunk_id"] for r in answers] == [c for c in (0, 1, 2, 4) for _ in range(2000)] + [None] * 1500
    faults = [r for r in table if r["kind"] == "fault"]
    assert len(faults) == 500 and {(r["chunk_id"], r["attempt"], r["again"], r["due"], r["submit_error"]) for r in faults} == {(None, 1, True, 2.0, "RuntimeError: 429")}
    assert len(answers) == n - 500 == sum(r["kind"] == "mark" for r in table)
    assert {r["line"] for r in answers} | {r["key"][1:] for r in faults} == {str(k) for k in range(n)}
    assert {r["request"].decode() for r in table if r["request"]} == {str(k) for k in range(n)}


def test_clients_are_handed_few_rows_at_a_time(spark, posts, spec, log, tmp_path):
    """While a client is asked Arrow batches are small, and the session is as before then; calls are as large as they may be."""
    setting, small = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    class Ledger(AnswerLedger):
        def write(self, rows):
            small.append(int(spark.conf.get(setting)))
            super().write(rows)

    def make():
        class Sizes:
            def run_batch(self, lines):
                note(log, f"n{len(lines)}")
                return [answer(json.loads(x)["key"]) for x in lines]

        return Sizes()

    before = spark.conf.get(setting)
    items = posts([(f"p{i}", "text") for i in range(6000)]).coalesce(1)
    found = ask_until_done(items, lambda rows: render_requests(rows, spec.criteria, spec.url), make, Ledger(spark, str(tmp_path / "ledger")), batch_size=500, partitions=1)
    assert small == [1000] and spark.conf.get(setting) == before
    # Five chunks of 1,200 posts each, of which a batch of 1,000 rows has 200 or so.
    assert asked(log) == {"n500": 10, "n200": 5}
    assert found.select("line").distinct().count() == 6000


def test_lines_that_wait_are_bounded(monkeypatch):
    import pyarrow as pa

    from siftwell.operators import scoring

    monkeypatch.setattr(scoring, "WAITING_BYTES", 100_000)
    rows = [pa.RecordBatch.from_pydict({"chunk_id": pa.array([(b + k) % 30 for k in range(40)], pa.int32()), "line": [f"{b} {k} ".ljust(1000, "x") for k in range(40)]}) for b in range(50)]
    read = 0

    def batches():
        nonlocal read
        for b in rows:
            read += b.num_rows
            yield b

    given, seen = 0, []
    for chunk, call in scoring._calls(batches(), 500):
        given += call.num_rows
        # What waits besides a batch of 40 rows.
        assert read - given <= 100 + 40 and set(call.column("chunk_id").to_pylist()) == {chunk}
        seen += call.column("line").to_pylist()
    assert sorted(seen) == sorted(x for b in rows for x in b.column("line").to_pylist())


def test_overlapping_runs_put_the_session_back(spark):
    from siftwell.session import arrow_rows

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    first, second = arrow_rows(spark, 50), arrow_rows(spark, 50)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(setting) == "50"
    sizes = spark.range(400).coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long")
    assert sizes.count() == 8
    second.__exit__(None, None, None)
    assert spark.conf.get(setting) == before and sizes.count() == 1
