"""Runs queries next to their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import os
import time
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[str | None, int, float]:
    """What differs (None if nothing), the number of rows, and Spark's seconds."""
    start = time.time()
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    got = Counter(tuple(r[n] for n in names) for r in frame.collect())
    seconds = time.time() - start
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}", sum(got.values()), seconds
    order = [columns.index(n) for n in names]
    want = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    if got != want:
        extra, absent = got - want, want - got
        sample = lambda c: [str(r)[:300] for r in list(c)[:2]]
        return (
            f"{names}: {sum(extra.values())} rows too many {sample(extra)}, "
            f"{sum(absent.values())} rows absent {sample(absent)}"
        ), sum(got.values()), seconds
    return None, sum(got.values()), seconds
