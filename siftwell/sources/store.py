"""The verdict store: an append-only log of answers, read as last per key.

Layout:  <path>/commits/C                    one row: what was added or taken away
         <path>/log/batch=B/outcome=O        rows of one write; O is verdict or failure

A write makes a batch folder of its own and becomes part of the store by the commit
that names it, so a write that died is never seen. A compaction and a clear name the
batches they replace; nothing is deleted. Whoever holds the store open works on the
batches that it knew then, and on its own: readers list these folders only. What it appends
is in the store for everyone from its commit on, whatever was compacted or cleared meanwhile.

The folder level parts verdicts from failures, so neither a second parse nor a second
scan is needed, and readers of one kind never open files of the other.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.ids import store_key
from siftwell.operators.merge import latest_by_key, newest
from siftwell.operators.pending import store_ids
from siftwell.schemas import ANSWERS, COMMITS, FAILURE_COLUMNS, LOG, VERDICT_COLUMNS

OPEN, APPEND, FOLD, CLEAR = "open", "append", "fold", "clear"
#: Of what is written once and read by a few columns: an answer's texts take a good third less than by Spark's default.
CODEC = "zstd"
#: A batch without rows, for readers of an empty store.
NOTHING = "b-none"


@dataclass(frozen=True)
class Commit:
    at: int
    commit: str
    kind: str
    run_id: str
    batch: str | None = None
    drops: list[str] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)


@dataclass
class Snapshot:
    """The batches that are in the store after some commits, and for each the runs whose rows in it no longer count."""

    #: By batch, in the order of their commits.
    commits: dict[str, Commit] = field(default_factory=dict)
    replaced: dict[str, set[str]] = field(default_factory=dict)
    #: Compactions and clears that took effect.
    generation: int = 0
    last: int = 0

    @classmethod
    def of(cls, commits: list[Commit]) -> Snapshot:
        out = cls()
        for c in sorted(commits, key=lambda c: (c.at, c.commit)):
            out.add(c)
        return out

    def add(self, c: Commit) -> None:
        self.last = max(self.last, c.at)
        if c.kind == APPEND:
            for batch, other in list(self.commits.items()):
                if other.kind == APPEND and other.run_id == c.run_id:
                    del self.commits[batch]
                elif c.run_id in other.runs:
                    self.replaced.setdefault(batch, set()).add(c.run_id)
            self.commits[c.batch] = c
        elif c.kind == CLEAR or (c.kind == FOLD and all(b in self.commits for b in c.drops)):
            # A compaction of something that was replaced or cleared before it was done is void.
            for batch in c.drops:
                self.commits.pop(batch, None)
            self.generation += 1
            if c.kind == FOLD:
                self.commits[c.batch] = c

    def batches(self, run_id: str | None = None) -> list[str]:
        return [b for b, c in self.commits.items() if run_id is None or run_id == c.run_id or run_id in c.runs]


class VerdictStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._log = f"{self.path}/log"
        self._commits = f"{self.path}/commits"
        self._known: Snapshot | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VerdictStore:
        """The store at path, made if there is none yet."""
        store = cls(spark, path)
        try:
            store._events()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            spark.createDataFrame([], LOG).write.mode("append").parquet(store._folder(NOTHING))
            store._commit(Commit(0, uuid.uuid4().hex, OPEN, ""))
        return store

    def _folder(self, batch: str) -> str:
        return f"{self._log}/batch={batch}"

    def _events(self) -> list[Commit]:
        """All commits: a small row each, of which there is one per run, compaction and clear."""
        rows = self.spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(self._commits)
        return [Commit(**r.asDict()) for r in rows.collect()]

    def _commit(self, c: Commit) -> None:
        """One file in a folder of its own, so that commits of several jobs don't meet."""
        # A literal, since rows from the driver would pass through a Python worker, which a stream waits for in each batch.
        row = self.spark.range(0, 1, 1, 1).select(F.from_json(F.lit(json.dumps(asdict(c))), COMMITS).alias("c"))
        row.select("c.*").write.parquet(f"{self._commits}/{c.commit}")

    def _record(self, known: Snapshot, kind: str, run_id: str, batch: str | None = None, drops: list[str] = (), runs: list[str] = ()) -> None:
        # Later than all that was seen, whatever the clocks of other machines say.
        at = max(known.last + 1, time.time_ns() // 1000)
        c = Commit(at, uuid.uuid4().hex, kind, run_id, batch, list(drops), list(runs))
        self._commit(c)
        known.add(c)
        self._known = known

    @property
    def snapshot(self) -> Snapshot:
        """What this handle works on, looked up once: a run so sees one state throughout, and its own writes.

        What other jobs commit shows when the store is opened again.
        """
        if self._known is None:
            self._known = Snapshot.of(self._events())
        return self._known

    @property
    def generation(self) -> int:
        """How many compactions and clears the store has seen."""
        return self.snapshot.generation

    def _new_batch(self, run_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
            raise ValueError(f"run_id may hold letters, digits and _.- only, not {run_id!r}")
        return f"b-{uuid.uuid4().hex}"

    def append(self, answers: DataFrame, run_id: str) -> None:
        """Writes a run's answers; writing the same run again replaces them."""
        batch = self._new_batch(run_id)
        outcome = F.when(F.col("fail_reason").isNull(), "verdict").otherwise("failure")
        rows = answers.select(
            *ANSWERS.names,
            store_key(F.col("item_id")).alias("store_key"),
            F.lit(run_id).alias("run_id"),
            F.lit(run_id).alias("origin"),
            F.current_timestamp().alias("written_at"),
            outcome.alias("outcome"),
        )
        rows.write.option("compression", CODEC).partitionBy("outcome").parquet(self._folder(batch))
        self._record(self.snapshot, APPEND, run_id, batch)

    def _rows(self, outcome: str | None, run_id: str | None = None, without_run: str | None = None) -> DataFrame:
        """Rows of the batches that this handle knows; only their folders are listed."""
        known = self.snapshot
        batches = known.batches(run_id)
        folders = [self._folder(b) for b in batches or [NOTHING]]
        rows = self.spark.read.schema(LOG).option("basePath", self._log).parquet(*folders)
        if outcome is not None:
            rows = rows.where(F.col("outcome") == outcome)
        if run_id is not None:
            rows = rows.where(F.col("origin") == run_id)
        if without_run is not None:
            rows = rows.where(F.col("origin") != without_run)
        for batch in batches:
            if gone := known.replaced.get(batch):
                rows = rows.where((F.col("batch") != batch) | ~F.col("origin").isin(*sorted(gone)))
        return rows

    def log(self, run_id: str | None = None, without_run: str | None = None, criteria_hash: str | None = None) -> DataFrame:
        """All verdicts with the columns of the log, of one set of criteria if asked for."""
        rows = self._rows("verdict", run_id, without_run)
        return rows.where(F.col("criteria_hash") == criteria_hash) if criteria_hash else rows

    def verdicts(self, run_id: str | None = None, without_run: str | None = None) -> DataFrame:
        """All verdicts in the log, repeats included."""
        return self.log(run_id, without_run).select(*VERDICT_COLUMNS, "store_key", "run_id", "written_at")

    def failures(self, run_id: str | None = None) -> DataFrame:
        return self._rows("failure", run_id).select(*FAILURE_COLUMNS, "store_key", "run_id")

    def answers(self, run_id: str) -> DataFrame:
        """Verdicts and failures of one run."""
        return self._rows(None, run_id).select(ANSWERS.names)

    def latest(self, without_run: str | None = None, criteria_hash: str | None = None) -> DataFrame:
        """The newest verdict per key, of one set of criteria if asked for."""
        return latest_by_key(self.log(without_run=without_run, criteria_hash=criteria_hash))

    def ids(self, without_run: str | None = None, criteria_hash: str | None = None) -> DataFrame:
        """Keys that have a verdict; reads just that column."""
        return store_ids(self.log(without_run=without_run, criteria_hash=criteria_hash))

    def clear(self, run_id: str) -> bool:
        """Empties the store of all that is in it now; a second clear by the same run does nothing.

        No file is deleted, so readers of what there was finish undisturbed.
        """
        events = self._events()
        known = Snapshot.of(events)
        if any(c.kind == CLEAR and c.run_id == run_id for c in events):
            self._known = known
            return False
        self._record(known, CLEAR, run_id, drops=known.batches())
        return True

    def compact(self, run_id: str) -> None:
        """Rewrites the newest verdict per key as one batch, with the run and time it comes from.

        The batch takes the place of those it was made from when it is complete. It is
        void if one of them was replaced or cleared in the meantime; what was appended in the
        meantime stays beside it. Failures are left out, so attempts are counted anew.
        """
        batch = self._new_batch(run_id)
        self._known = Snapshot.of(self._events())
        known = self._known
        rows = newest(self.log(), [*VERDICT_COLUMNS, "origin", "written_at"]).select(
            *[F.col(c) if c in VERDICT_COLUMNS else F.lit(None).cast(ANSWERS[c].dataType).alias(c) for c in ANSWERS.names],
            "store_key",
            F.lit(run_id).alias("run_id"),
            "origin",
            "written_at",
            F.lit("verdict").alias("outcome"),
        )
        rows.write.option("compression", CODEC).partitionBy("outcome").parquet(self._folder(batch))
        drops = known.batches()
        runs = {c.run_id for c in known.commits.values() if c.kind == APPEND}.union(*[set(c.runs) - known.replaced.get(b, set()) for b, c in known.commits.items()])
        self._record(Snapshot.of(self._events()), FOLD, run_id, batch, drops, sorted(runs))
