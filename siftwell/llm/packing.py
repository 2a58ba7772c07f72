"""Best-fit packing of token pieces into sequences: bounded-space online best-fit.

A packer keeps at most OPEN_BINS open bins. A bitset over free space, with a list
of bins for each amount, finds the open bin with the least free space that still
holds the next piece by one shift and one lowest-bit step. If none does and all
bins are in use, the fullest closes first. Pieces come one at a time, in an order
of hashed ids, and are never looked at again.

Packers work side by side, one per PACKER_TOKENS tokens. The bins that a packer
leaves open and not full are items for a second round of the same kind, of far
fewer packers, so that their number does not add to the number of sequences.

Defined results: a null or empty text is a piece of the end id alone; documents
longer than the sequence are cut into pieces of its size, the last one shorter;
repeated rows are packed each; a null doc_id is kept; extra columns are ignored;
no rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.frames import arrow_schema, mapped, only, record_batch, tasks, written
from siftwell.llm.token_ids import encoder

OPEN_BINS = 512
PACKER_TOKENS = 16_000_000


class Packer:
    """Bounded-space online best-fit over sizes of at most `size`."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS) -> None:
        self.size, self.open_bins = size, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.n_open = self.n_bins = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            free, bin_ = self.size, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return bin_, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return bin_

    def left_open(self) -> Iterable[tuple[int, int]]:
        """(bin, tokens in it) of the bins still open."""
        return [(b, self.size - free) for free, bins in enumerate(self.by_free) for b in bins]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, when asked for, ids (little-endian unsigned 32-bit)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, at = encoder(tokenizer).encode(batch.column("text"))
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:], strict=False):
            own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(own), size)):
                raw = own[start : start + size].tobytes()
                for name, value in zip(out, (doc_id, k, start, len(raw) // 4, zlib.crc32(raw), raw), strict=True):
                    out[name].append(value)
        yield out

    return mapped(only(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), step, schema)


def _round(items: DataFrame, size: int, open_bins: int, tokens: int) -> DataFrame:
    """items (item struct, length) put into bins: + packer, bin, offset, and rest: tokens in the bin if left open, else null.

    Which bins stay open is known only at the end of a packer, so its items are
    held as three numbers each until then; a packer's share of tokens bounds them.
    """
    n = tasks(items, tokens, PACKER_TOKENS)
    ordered = items.withColumn("h", F.xxhash64("item")).repartition(n, "h").sortWithinPartitions("h", "item")
    schema = f"item {items.schema['item'].dataType.simpleString()}, length long, packer int, bin long, offset long, rest long"
    fields = arrow_schema(items.sparkSession, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, id_ = Packer(size, open_bins), TaskContext.get().partitionId()
        held = []
        for batch in batches:
            put = [packer.put(x) for x in batch.column("length").to_pylist()]
            held.append((batch.column("item"), batch.column("length"), np.array([p[0] for p in put]), np.array([p[1] for p in put])))
        rest = np.full(packer.n_bins, -1, np.int64)
        for b, used in packer.left_open():
            rest[b] = used
        for item, length, bins, offsets in held:
            mine = rest[bins]
            yield record_batch({"item": item, "length": length, "packer": np.full(len(bins), id_), "bin": bins, "offset": offsets, "rest": pa.array(mine, mask=mine < 0)}, fields)

    return ordered.select("item", "length").mapInArrow(pack, schema)


def packed(parts: DataFrame, size: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """parts (doc_id, piece, start, length, ...), best read from a written table, with sequence_id and offset."""
    tokens = parts.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    names = parts.columns
    first = written(_round(parts.select(F.struct(*names).alias("item"), "length"), size, open_bins, tokens), "packed")
    open_ = first.filter("rest is not null").select(F.struct("packer", "bin").alias("item"), F.col("rest").alias("length")).distinct()
    left = open_.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    second = _round(open_, size, open_bins, left).select(
        F.col("item.packer").alias("p"), F.col("item.bin").alias("b"), F.col("packer").alias("packer2"), F.col("bin").alias("bin2"), F.col("offset").alias("shift")
    )
    # A sequence's number: the round in the lowest bit, then the packer, then its bin.
    number = lambda round_, packer, bin_: (F.col(bin_) * (1 << 24) + F.col(packer)) * 2 + round_
    whole = first.filter("rest is null").select("item.*", number(0, "packer", "bin").alias("sequence_id"), "offset")
    moved = first.filter("rest is not null").join(second, (F.col("packer") == F.col("p")) & (F.col("bin") == F.col("b")))
    return whole.unionByName(moved.select("item.*", number(1, "packer2", "bin2").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, open_bins: int = OPEN_BINS) -> DataFrame:
    """Every piece of every document with its sequence and place; ids too when asked for."""
    return packed(written(pieces(docs, tokenizer, size, end_id, id_col, text_col, with_ids), "pieces"), size, open_bins)
