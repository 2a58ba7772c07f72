"""Verdicts for posts: by a model client, or by the word rule."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.fixed_values import DELETE, KEEP, RATE_LIMIT_MARKERS
from siftwell.functions.urls import permalink
from siftwell.functions.words import SHORT_LIST, dictionary, entry_table, found_words, join_words, lowered
from siftwell.operators.requests import request_lines
from siftwell.schemas import ANSWERS, LEDGER, SCORED
from siftwell.session import arrow_rows
from siftwell.sources.ledger import ANSWER, FAULT, MARK, AnswerLedger
from siftwell.spec import Criteria, UrlSpec

#: Rows that a client's task is handed at a time; two such batches are held while the next is read.
ARROW_ROWS = 1000
#: Bytes of request lines that wait in a task for others of their chunk.
WAITING_BYTES = 32 << 20
_SCORED = pa.schema([("chunk_id", pa.int32()), ("key", pa.string()), ("line", pa.string()), ("submit_error", pa.string())])
_LEDGER = pa.schema([
    ("kind", pa.string()), ("request", pa.binary()), ("chunk_id", pa.int32()), ("key", pa.string()), ("line", pa.string()),
    ("submit_error", pa.string()), ("attempt", pa.int32()), ("again", pa.bool_()), ("due", pa.float64()),
])


class Client(Protocol):
    """What a model client must offer; made once per task by its factory."""

    def run_batch(self, lines: list[str]) -> list[str]:
        """Takes request lines, gives answer lines (in any order or number)."""
        ...


def spread(items: DataFrame, partitions: int | None) -> DataFrame:
    """Even partitions for the model step, before prompts make the rows wide.

    The number of partitions bounds how many clients run at once. Round robin
    does not look at ids, so a frequent id does not crowd one client.
    """
    return items.repartition(partitions) if partitions else items


def _calls(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """Rows of one chunk, `size` of them at a time; fewer only at the end, or when rows that wait for others of their chunk pass WAITING_BYTES.

    Only the rows of a call, of those that wait and of the batch at hand are held, and only a call's become Python values.
    """
    waiting: dict[int | None, list[pa.RecordBatch]] = {}
    rows_of: dict[int | None, int] = {}
    bytes_of: dict[int | None, int] = {}

    def taken(chunk: int | None) -> tuple[int | None, pa.RecordBatch]:
        del rows_of[chunk], bytes_of[chunk]
        return chunk, pa.Table.from_batches(waiting.pop(chunk)).combine_chunks().to_batches()[0]

    def in_order(chunks: Iterable[int | None]) -> list[int | None]:
        return sorted(chunks, key=lambda c: (c is None, c or 0))

    for rows in batches:
        chunks = rows.column("chunk_id")
        for chunk in in_order(pc.unique(chunks).to_pylist()):
            own = pc.indices_nonzero(pc.is_null(chunks) if chunk is None else pc.equal(chunks, chunk))
            start = 0
            while start < len(own):
                part = rows.take(own.slice(start, size - rows_of.get(chunk, 0)))
                start += part.num_rows
                waiting.setdefault(chunk, []).append(part)
                rows_of[chunk] = rows_of.get(chunk, 0) + part.num_rows
                bytes_of[chunk] = bytes_of.get(chunk, 0) + part.nbytes
                if rows_of[chunk] == size:
                    yield taken(chunk)
        while sum(bytes_of.values()) > WAITING_BYTES:
            yield taken(max(bytes_of, key=bytes_of.__getitem__))
    for chunk in in_order(waiting):
        yield taken(chunk)


def _filled(schema: pa.Schema, n: int, **values: list | pa.Array) -> pa.RecordBatch:
    columns = [values.get(f.name, [None] * n) for f in schema]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def score_with_client(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    max_retries: int = 3,
    batch_size: int = 1000,
    sleep: Callable[[float], None] | None = None,
) -> DataFrame:
    """Answer lines of a model service, one row each.

    Rate-limit errors are tried again with growing waits; a batch that runs out
    of attempts, or fails otherwise, comes back as rows with submit_error set.
    Write the result before using it: every action over it asks the model anew.
    """
    if max_retries <= 0 or batch_size <= 0:
        raise ValueError("max_retries and batch_size must be > 0")
    markers = list(RATE_LIMIT_MARKERS)

    def ask(batches):
        import time

        wait = sleep or time.sleep
        client = None

        def submit(lines):
            error = None
            for attempt in range(max_retries):
                try:
                    return client.run_batch(lines), None
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                    if not any(m in error for m in markers):
                        break
                    wait(2**attempt)
            return [], error

        for chunk, batch in _calls(batches, batch_size):
            client = client_factory() if client is None else client
            answers, error = submit(batch.column("line").to_pylist())
            if error is None:
                yield _filled(_SCORED, len(answers), line=answers, chunk_id=[chunk] * len(answers))
            else:
                n = batch.num_rows
                yield _filled(_SCORED, n, key=batch.column("key"), submit_error=[error] * n, chunk_id=[chunk] * n)

    return request_lines(requests).mapInArrow(ask, SCORED)


def ask(requests: DataFrame, client_factory: Callable[[], Client], batch_size: int = 1000, clock: Callable[[], float] | None = None) -> DataFrame:
    """Asks once for each request and gives the rows of an answer ledger.

    requests: chunk_id, key, line, request (its hash) and attempt (how often it was
    asked for before). Nothing is tried again here: a batch that fails becomes faults, to be
    tried again after a wait that doubles with each attempt if the service was busy.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    markers = list(RATE_LIMIT_MARKERS)

    def run(batches):
        import time

        now = clock or time.time
        client = None
        for chunk, batch in _calls(batches, batch_size):
            client = client_factory() if client is None else client
            n, requests_ = batch.num_rows, batch.column("request")
            try:
                answers = client.run_batch(batch.column("line").to_pylist())
            except Exception as e:
                error, tried = f"{type(e).__name__}: {e}", batch.column("attempt").to_pylist()
                yield _filled(
                    _LEDGER, n, kind=[FAULT] * n, request=requests_, chunk_id=[chunk] * n, key=batch.column("key"), submit_error=[error] * n,
                    attempt=[t + 1 for t in tried], again=[any(m in error for m in markers)] * n, due=[now() + 2**t for t in tried],
                )
                continue
            yield _filled(_LEDGER, len(answers), kind=[ANSWER] * len(answers), line=answers, chunk_id=[chunk] * len(answers))
            yield _filled(_LEDGER, n, kind=[MARK] * n, request=requests_)

    return requests.mapInArrow(run, LEDGER)


def ask_until_done(
    pending: DataFrame,
    render: Callable[[DataFrame], DataFrame],
    client_factory: Callable[[], Client],
    ledger: AnswerLedger,
    max_attempts: int = 3,
    batch_size: int = 1000,
    partitions: int | None = None,
    clock: Callable[[], float] = time.time,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Asks for what the ledger has no answer to, in rounds, and gives the ledger's responses.

    A round asks for all requests that are new or due. What failed because the service was
    busy waits in the ledger until its time; no task is held up meanwhile. Running this again over
    the ledger of a run that died goes on where that stopped: nothing is asked twice.
    """
    if max_attempts <= 0 or batch_size <= 0:
        raise ValueError("max_attempts and batch_size must be > 0")

    def requests() -> DataFrame:
        lines = request_lines(render(pending))
        return lines.withColumn("request", F.unhex(F.sha2("line", 256)))

    def submit(todo: DataFrame) -> None:
        with arrow_rows(ledger.spark, ARROW_ROWS):
            ledger.write(ask(spread(todo, partitions), client_factory, batch_size, clock))

    if ledger.is_new():
        submit(requests().withColumn("attempt", F.lit(0)))
    else:
        # By address of the ledger alone: requests that were answered, or failed before, are not new.
        seen = ledger.asked().unionByName(ledger.faults().select("request"))
        submit(requests().join(seen, "request", "left_anti").withColumn("attempt", F.lit(0)))
    while (first := ledger.queue(max_attempts).agg(F.min("due")).first()[0]) is not None:
        sleep(max(0.0, first - clock()))
        due = ledger.queue(max_attempts).where(F.col("due") <= max(first, clock())).drop("due")
        submit(requests().join(due, "request"))
    return ledger.responses(max_attempts)


def score_rules(items: DataFrame, criteria: Criteria, url: UrlSpec) -> DataFrame:
    """Deterministic verdicts from the forbidden words alone.

    A stand-in where no model is attached; topics and tone are a model's task.
    """
    entries = dictionary(criteria.forbidden_words)
    rows = items.select("item_id", "chunk_id", "src_file", "pos", lowered(F.col("item_text")).alias("lower"))
    if len(entries) <= SHORT_LIST:
        found = rows.withColumn("explicit_words", found_words(F.col("lower"), entries))
    else:
        found = join_words(rows, "lower", entry_table(items.sparkSession, entries))
    hit = F.size("explicit_words") > 0
    verdict = F.struct(
        "explicit_words",
        F.col("reason").alias("reason_for_flag"),
        F.col("topics").alias("topic_of_tweet"),
        "deletion",
    )
    null = lambda name: F.lit(None).cast(ANSWERS[name].dataType).alias(name)
    return (
        found.select("item_id", "chunk_id", "src_file", "pos", "explicit_words")
        .withColumn("reason", F.when(hit, "Contains forbidden words").otherwise("No forbidden words"))
        .withColumn("topics", F.array().cast("array<string>"))
        .withColumn("deletion", F.when(hit, DELETE).otherwise(KEEP))
        .select(
            "item_id",
            permalink(F.col("item_id"), url).alias("item_url"),
            "explicit_words",
            "reason",
            "topics",
            "deletion",
            F.create_map().cast("map<string,string>").alias("extras"),
            F.to_json(verdict).alias("raw"),
            null("stage"),
            null("fail_reason"),
            null("line"),
            "chunk_id",
            F.lit(criteria.digest).alias("criteria_hash"),
            F.struct(
                F.col("src_file").alias("file"),
                F.lit(0).cast("long").alias("block"),
                F.col("pos").cast("long").alias("row"),
            ).alias("ord"),
        )
    )
