"""Token files: whole texts as ids, range-coded in blocks, in ascending order of their ids.

A token file is a folder of three Parquet tables, so that any store Spark reaches
can hold it and a lost task is written again alone:

* model: one row, the frequency of each id, shared by all blocks (range coder's table);
* blocks: part, block, payload (see rans.py), and for the documents that begin in
  the block their doc_id, n_tokens and place in the part;
* parts: part, start: ids before the part.

Parts are ranges of doc_id in ascending order, and so are the documents in a part.

Defined results: a null or empty text has only the end id; a null doc_id comes
first; equal doc_ids lie side by side, each with its own ids, ordered by a hash of
them; a table without rows gives a file without blocks; extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm import rans
from siftwell.llm.frames import arrow_schema, mapped, only, record_batch, tasks, written
from siftwell.llm.token_ids import encoder

#: Ids in a part, about; a part is written by one task.
PART_IDS = 16_000_000
_BLOCKS = "part int, block int, payload binary, doc_ids array<long>, sizes array<long>, begins array<long>"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, tie, ids (zstd of little-endian unsigned 16- or 32-bit numbers), one row per row of docs."""
    schema = "doc_id long, n_tokens long, tie long, wide boolean, ids binary"

    def step(piece: pa.RecordBatch) -> Iterator[dict]:
        ids, at = encoder(tokenizer).encode(piece.column("text"))
        pack = zstandard.ZstdCompressor(1)
        rows = [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(at, at[1:], strict=False)]
        wide = [bool(r.max() > 0xFFFF) for r in rows]
        raw = [r.astype("<u4" if w else "<u2").tobytes() for r, w in zip(rows, wide, strict=True)]
        yield {
            "doc_id": piece.column("doc_id"),
            "n_tokens": [len(r) for r in rows],
            "tie": [zlib.crc32(r) for r in raw],
            "wide": wide,
            "ids": [pack.compress(r) for r in raw],
        }

    return mapped(only(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), step, schema)


def _unpacked(packed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4" if wide else "<u2").astype(np.uint32)


def counts_of(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; bounded by the tokenizer's vocabulary."""
    schema = "id long, n long"
    fields = arrow_schema(tokens.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed, wide in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                got = np.bincount(_unpacked(packed, wide))
                if len(got) > len(total):
                    total = np.append(total, np.zeros(len(got) - len(total), np.int64))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield record_batch({"id": seen, "n": total[seen]}, fields)

    rows = tokens.select("wide", "ids").mapInArrow(count, schema).groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r.id for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_tokens(tokens: DataFrame, path: str, part_ids: int = PART_IDS) -> None:
    """Writes token_ids()'s rows, best read from a written table, as a token file at a new path."""
    spark = tokens.sparkSession
    freq = rans.scaled(counts_of(tokens))
    spark.createDataFrame([([int(x) for x in freq],)], "freq array<long>").coalesce(1).write.parquet(f"{path}/model")
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    fields = arrow_schema(spark, _BLOCKS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = rans.Coder(freq), TaskContext.get().partitionId()
        held, docs, n_held, done, block = [], [], 0, 0, 0  # done: ids of the part that are in blocks

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, docs, n_held, done, block
            ids = np.concatenate(held)
            take = len(ids) if last else len(ids) // rans.BLOCK_IDS * rans.BLOCK_IDS
            stop = done + take
            for payload in coder.encode(ids[:take]):
                done = min(done + rans.BLOCK_IDS, stop)
                here = [d for d in docs if d[2] < done]
                docs = docs[len(here) :]
                names = ("doc_ids", "sizes", "begins")
                yield record_batch({"part": [part], "block": [block], "payload": [payload]} | {n: [[d[k] for d in here]] for k, n in enumerate(names)}, fields)
                block += 1
            held, n_held = [ids[take:]], len(ids) - take

        for batch in batches:
            for doc_id, packed, wide in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ids", "wide")], strict=True):
                ids = _unpacked(packed, wide)
                docs.append((doc_id, len(ids), done + n_held))
                held.append(ids)
                n_held += len(ids)
                if n_held >= rans.BLOCK_IDS * 32:
                    yield from emit(False)
        if n_held:
            yield from emit(True)

    ordered = tokens.select("doc_id", "tie", "wide", "ids").repartitionByRange(tasks(tokens, total, part_ids), F.col("doc_id").asc_nulls_first(), "tie")
    blocks = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").mapInArrow(write, _BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One narrow row per part: a running sum over them is small however large the file is.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("part", before.alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The blocks decoded: a row for each stretch of a document within a block, in any order.

    part, begin (the document's place in the part), doc_id and size (null in a
    stretch that continues a document), offset (the stretch's place in the part),
    n, crc32 of its ids, and ids when asked for.
    """
    schema = "part int, begin long, doc_id long, size long, offset long, n long, crc32 long" + ", ids binary" * with_ids
    rows = spark.read.parquet(f"{path}/model").collect()
    freq = np.array(rows[0]["freq"], np.int64)
    fields = arrow_schema(spark, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq) if len(freq) else None
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32).to_pylist()
                decoded = coder.decode([r["payload"] for r in part])
                out = {f.name: [] for f in fields}
                for r, ids in zip(part, decoded, strict=True):
                    offset = r["block"] * rans.BLOCK_IDS
                    begins = [b for b in r["begins"]]
                    cuts = ([] if begins and begins[0] == offset else [(None, None, None)]) + list(zip(r["doc_ids"], r["sizes"], begins, strict=True))
                    places = [offset if b is None else b for _, _, b in cuts] + [offset + len(ids)]
                    for (doc_id, size, begin), a, b in zip(cuts, places, places[1:], strict=False):
                        raw = ids[a - offset : b - offset].astype("<u4").tobytes()
                        row = {"part": r["part"], "begin": begin, "doc_id": doc_id, "size": size, "offset": a, "n": b - a, "crc32": zlib.crc32(raw), "ids": raw}
                        for name in out:
                            out[name].append(row[name])
                yield record_batch(out, fields)

    return spark.read.parquet(f"{path}/blocks").select("part", "block", "payload", "doc_ids", "sizes", "begins").mapInArrow(read, schema)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@functools.cache
def _zeros(k: int) -> list[int]:
    """What 2**k zero bytes do to a crc32, as a matrix over its bits."""
    if k:
        half = _zeros(k - 1)
        return [_times(half, x) for x in half]
    power = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    for _ in range(3):
        power = [_times(power, x) for x in power]
    return power


def _crc_joined(first: int, second: int, n: int) -> int:
    """The crc32 of two byte strings one after the other, n the length of the second."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            first = _times(_zeros(k), first)
    return first ^ second


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the decoded blocks: doc_id, start, n_tokens, ids_crc32."""
    read = written(read_pieces(spark, path), "token-pieces")
    # A stretch that fills its document is done; only documents cut by a block's end meet their other stretches.
    whole = (F.col("doc_id").isNotNull() | F.col("size").isNotNull()) & (F.col("size") == F.col("n"))
    done = read.filter(whole).select("part", "begin", "doc_id", "size", "crc32")
    cut = read.filter(~F.coalesce(whole, F.lit(False)))
    before = Window.partitionBy("part").orderBy("offset", F.col("begin").isNotNull())
    owner = F.last("begin", ignorenulls=True).over(before)

    parts = cut.withColumn("begin", owner).groupBy("part", "begin").agg(
        F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("offset", "n", "crc32"))).alias("s")
    )
    schema = "part int, begin long, doc_id long, size long, crc32 long"
    fields = arrow_schema(spark, schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for size, stretches in zip(batch.column("size").to_pylist(), batch.column("s").to_pylist(), strict=True):
                crc, n = 0, 0
                for x in stretches:
                    crc, n = _crc_joined(crc, x["crc32"], 4 * x["n"]), n + x["n"]
                if n != size:
                    raise ValueError(f"a document of {size} ids is stored with {n}")
                sums.append(crc)
            yield record_batch({c: batch.column(c) for c in ("part", "begin", "doc_id", "size")} | {"crc32": sums}, fields)

    rows = done.unionByName(parts.mapInArrow(join, schema))
    starts = spark.read.parquet(f"{path}/parts")
    return rows.join(starts, "part").select("doc_id", (F.col("start") + F.col("begin")).alias("start"), F.col("size").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
