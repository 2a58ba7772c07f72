"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# What an audit wants from the session. Counts that depend on the cluster
# (shuffle partitions, executor sizes) are left to whoever runs it.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Speculative copies of a scoring task would pay for its answers twice.
    "spark.speculation": "false",
    # Chunked outputs: one open file per chunk instead of a sort by chunk.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "siftwell", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_lock = threading.Lock()
#: Sessions whose setting is lowered: how many hold it, and what it was.
_lowered: weakref.WeakKeyDictionary[SparkSession, tuple[int, str | None]] = weakref.WeakKeyDictionary()


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions begun meanwhile hand Python tasks so many rows at a time, or as few as the session says.

    Runs in one session may overlap: the first one lowers the setting and the last one puts it back.
    """
    with _lock:
        users, before = _lowered.get(spark, (0, None))
        if not users:
            before = spark.conf.get(_ARROW_ROWS, None)
            now = int(spark.conf.get(_ARROW_ROWS))
            spark.conf.set(_ARROW_ROWS, str(min(now, most) if now > 0 else most))
        _lowered[spark] = (users + 1, before)
    try:
        yield
    finally:
        with _lock:
            users, before = _lowered.pop(spark)
            if users > 1:
                _lowered[spark] = (users - 1, before)
            elif before is None:
                spark.conf.unset(_ARROW_ROWS)
            else:
                spark.conf.set(_ARROW_ROWS, before)
