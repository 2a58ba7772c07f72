"""Writes that appear as a whole: to a folder aside first, then moved into place."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def published(spark: SparkSession, path: str, write: Callable[[str], None], single: bool = False) -> None:
    """write(folder) may take several jobs; path changes when all are done, from what it was to all they wrote.

    With single, write must leave one part file, which itself becomes path.
    """
    path = path.rstrip("/")
    parent, name = path.rsplit("/", 1)
    mark = uuid.uuid4().hex
    # Readers of the parent folder skip names that begin with an underscore.
    aside, before = f"{parent}/_{name}-{mark}", f"{parent}/_{name}-{mark}-before"
    write(aside)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    source = at(aside)
    if single:
        parts = [s.getPath() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{len(parts)} part files instead of one for {path}")
        source = parts[0]
    if files.exists(at(path)):
        files.rename(at(path), at(before))
    if not files.rename(source, at(path)):
        raise OSError(f"{source} could not be moved to {path}")
    for left in (before, aside):
        files.delete(at(left), True)
