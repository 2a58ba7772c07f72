"""Content-addressed archive of web records: payload bytes once, exact headers apart.

An archive is a folder of two Parquet tables:

* payloads: sha256, payload - each distinct payload once;
* headers: record (its place among equal rows), page_id, sha256, header - the exact
  header block of the WARC/1.1 record, with its closing empty line.

Payloads are addressed by SHA-256, and reading verifies it, the SHA-1 that the
header states and the length. A record is header + payload + two line ends;
records() rebuilds all of them by a join. Of rows with equal payloads the one
with the largest id is the response, the others are revisits of it whose headers
refer to it; payloads shorter than min_revisit are always responses.

Defined results: a null payload is empty; a null id counts as less than any other;
rows with equal id and payload are records of their own, of which one is the
response; a null url is an empty target; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.frames import mapped, only

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, record: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{record}>"


def header(page_id: int | None, record: int, url: str | None, sha1: str, length: int, refers_to: int | None, refers_record: int | None, revisit: bool, date: str = _DATE) -> bytes:
    target = quote(url or "", safe="%/:?#[]@!$&'()*+,;=-._~")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, record)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: text/html",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, refers_record)}", f"WARC-Profile: {_PROFILE}", f"X-Payload-Length: {length}", "Content-Length: 0"]
    else:
        lines.append(f"Content-Length: {length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parsed_header(block: bytes) -> dict:
    """The fields of a header block; raises ValueError if it isn't one."""
    lines = block.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or lines[-2:] != ["", ""]:
        raise ValueError("not a record header")
    fields = dict(x.split(": ", 1) for x in lines[1:-2])
    id_ = lambda name: re.fullmatch(r"<urn:page:(none|-?\d+):(\d+)>", fields[name]).group(1)
    number = lambda x: None if x == "none" else int(x)
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(id_("WARC-Record-ID")),
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["X-Payload-Length" if revisit else "Content-Length"]),
        "refers_to": number(id_("WARC-Refers-To")) if revisit else None,
    }


def _digested(pages: DataFrame, with_payload: bool) -> DataFrame:
    schema = "page_id long, url string, sha256 binary, sha1 string, length long, place binary" + ", payload binary" * with_payload

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
        sha256 = [hashlib.sha256(x).digest() for x in raw]
        named = zip(sha256, batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True)
        yield {
            # One key for payload, id and url, never null: what is joined by it need not be shuffled again to be grouped.
            "place": [hashlib.sha256(d + repr((i, u)).encode()).digest() for d, i, u in named],
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "sha256": sha256,
            "sha1": [base32_sha1(x) for x in raw],
            "length": [len(x) for x in raw],
            "payload": raw,
        }

    return mapped(pages, step, schema)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> None:
    """Writes pages as an archive at a new path. Payload bytes are shuffled once, and only those that are stored."""
    pages = only(pages, page_id=pages[id_col].cast("long"), url=pages[url_col].cast("string"), text=pages[payload_col].cast("string"))
    rows = _digested(pages, False)
    # Equal rows are counted, not kept apart by an unstable row number.
    counted = rows.groupBy("place", "sha256", "page_id", "url", "sha1", "length").agg(F.count("*").alias("copies"))
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("k"), F.col("page_id").isNotNull().alias("p"), "page_id", "url")
    owner = counted.groupBy("sha256").agg(F.max(order).alias("o")).select("sha256", F.col("o.page_id").alias("owner_id"), F.col("o.url").alias("owner_url"))
    # The hash of the digest is a second key: with it the join has shuffles of its own, in which a frequent payload is split.
    spread = F.xxhash64("sha256").alias("spread")
    named = counted.select("*", spread).join(owner.select("*", spread), ["sha256", "spread"]).withColumn("owns", F.col("page_id").eqNullSafe(F.col("owner_id")) & F.col("url").eqNullSafe(F.col("owner_url")))
    copies = named.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("record"))
    copies = copies.withColumn("revisit", (F.col("length") >= min_revisit) & ~(F.col("owns") & (F.col("record") == 1)))
    schema = "record long, page_id long, sha256 binary, header binary"

    def head(batch: pa.RecordBatch) -> Iterator[dict]:
        got = batch.to_pylist()
        yield {
            "record": batch.column("record"),
            "page_id": batch.column("page_id"),
            "sha256": batch.column("sha256"),
            "header": [header(r["page_id"], r["record"], r["url"], r["sha1"], r["length"], r["owner_id"], 1, r["revisit"]) for r in got],
        }

    mapped(copies, head, schema, text="url").write.option("compression", "zstd").parquet(f"{path}/headers")
    mine = named.filter("owns").select("place")
    stored = _digested(pages, True).select("place", "sha256", "payload").join(mine, "place")
    once = stored.groupBy("place").agg(F.first("sha256").alias("sha256"), F.first("payload").alias("payload")).select("sha256", "payload")
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the records state, joined with what their stored payloads are: fails on any difference."""
    schema = "page_id long, sha256 binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def parse(batch: pa.RecordBatch) -> Iterator[dict]:
        got = [parsed_header(x) for x in batch.column("header").to_pylist()]
        yield {"sha256": batch.column("sha256")} | {n: [g[n] for g in got] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}

    def verify(batch: pa.RecordBatch) -> Iterator[dict]:
        named, raw = batch.column("sha256").to_pylist(), batch.column("payload").to_pylist()
        if any(hashlib.sha256(x).digest() != n for n, x in zip(named, raw, strict=True)):
            raise ValueError("a payload differs from its address")
        yield {"sha256": named, "stored_bytes": [len(x) for x in raw], "stored_digest": [base32_sha1(x) for x in raw]}

    stated = mapped(spark.read.parquet(f"{path}/headers").select("header", "sha256"), parse, schema, text="header")
    stored = mapped(spark.read.parquet(f"{path}/payloads"), verify, "sha256 binary, stored_bytes long, stored_digest string", text="payload")
    both = stated.join(stored, "sha256", "left")
    same = F.coalesce((F.col("payload_bytes") == F.col("stored_bytes")) & (F.col("payload_digest") == F.col("stored_digest")), F.lit(False))
    return both.select("page_id", F.when(same, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record differs from its payload")).cast("long")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def records(spark: SparkSession, path: str, with_revisits: bool = False) -> DataFrame:
    """page_id, record, bytes: original records; revisits with their full payload when asked for, else header only."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    both = heads.join(payloads, "sha256", "left")
    full = F.lit(with_revisits) | ~F.contains("header", F.lit(b"\r\nWARC-Type: revisit\r\n"))
    end = F.lit(b"\r\n\r\n")
    return both.select("page_id", "record", F.concat("header", F.when(full, F.col("payload")).otherwise(F.lit(b"")), end).alias("bytes"))
