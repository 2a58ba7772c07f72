"""Substring deduplication: windows of words that start anywhere twice, by prefix-partitioned suffix trees.

A suffix is what follows a word of a document. Suffixes that share `length` words hang below
one internal node of the corpus's suffix tree, at that depth or deeper; consecutive such
suffixes of a document spell its maximal repeats. The tree is never held as a whole:

1. Anchors. In each window the run of words with the least hash is its anchor; equal windows
   have equal anchors. Anchors are counted over the corpus, and a bitmap of those found twice
   goes to all tasks. It is of bounded size and only spares work: suffixes whose first window
   has an anchor found once are leaves at a depth less than `length` and need no tree.
2. Suffixes. Each other suffix becomes a path of symbols, one for every UNIT words, and its place;
   equal paths of a slice of text are one row, so a passage that all documents share comes
   to a tree once per slice. Rows are dealt by their first symbol and sorted by path.
3. Subtrees. A task reads its suffixes in order and cuts them into groups of GROUP rows: at a
   change of the first symbol, within a group too large for that at a change of the first two,
   and so on. So a variable-length prefix is a subtree that fits into memory. Longest common
   prefixes of neighbours give its internal nodes; leaves of those at full depth are repeats.
4. Their places come back to the documents as runs of words to remove.

Words are runs outside x20 and x09 to x0D, unchanged. A word's hash has 64 bits, a path 128 (64 for
windows of up to 7 words). Defined results: a null text has no words; a null id stays null; rows with equal ids
are documents of their own, and equal rows are repeats of each other, all of which go; windows
don't cross documents; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bit_filter import bitmap, holds
from siftwell.llm.frames import arrow_schema, mapped, numbered, record_batch, written
from siftwell.llm.word_arrays import EXACT, buffer_of, mix, sliding, words

LENGTH = 35
UNIT = 7
#: Rows of one subtree group, and bytes of text in which equal paths are one row.
GROUP = 200_000
SLICE = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.dtype([("row", "<i8"), ("start", "<i4")])


def widths(length: int) -> list[int]:
    """Bytes of a path's symbols, 16 in all, or 8 each where they are too few for that."""
    unit = min(UNIT, length)
    n = len([*range(0, length - unit, unit)]) + 1
    return [min(8, 16 // n + (k < 16 % n)) if n <= 16 else 1 for k in range(n)]


class Windows:
    """The windows of `length` words of a slice of texts."""

    def __init__(self, texts: pa.Array, length: int):
        data, offsets = buffer_of(texts)
        hashes, _, _, self.owner = words(data, offsets, alphabet=EXACT)
        self.unit = min(UNIT, length)
        n = len(hashes)
        self.of_unit = np.zeros(max(n - self.unit + 1, 0), np.uint64)
        for k in range(self.unit):
            self.of_unit = mix(self.of_unit * _STEP + hashes[k : k + len(self.of_unit)])
        self.count = max(n - length + 1, 0)
        self.inside = self.owner[: self.count] == self.owner[n - self.count :]
        self.length = length
        self.anchor_words = min(length, max(self.unit, length // 2 + 2))
        self.choices = length - self.anchor_words + 1

    def _starts(self, span: int) -> list[int]:
        """Where units lie that cover a span of words."""
        return [*range(0, span - self.unit, self.unit), span - self.unit]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of anchor_words words, and the least of them in each window."""
        n = self.count + self.choices - 1 if self.count else 0
        runs = np.zeros(n, np.uint64)
        for at in self._starts(self.anchor_words):
            runs = mix(runs * _STEP + self.of_unit[at : at + n])
        return runs, sliding(runs, self.choices, np.minimum)

    def chosen(self) -> np.ndarray:
        """Hash of each place that is the anchor of a window; ties are anchors all."""
        runs, least = self.anchors()
        pad = np.zeros(self.choices - 1, np.uint64)
        best = sliding(np.concatenate([pad, np.where(self.inside, least, 0), pad]), self.choices, np.maximum)
        return runs[runs == best[: len(runs)]]

    def paths(self, at: np.ndarray) -> np.ndarray:
        """(windows, bytes) the first bytes of each symbol, big-endian."""
        starts = self._starts(self.length)
        parts = [self.of_unit[at + k].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :w] for k, w in zip(starts, widths(self.length), strict=True)]
        return np.concatenate(parts, axis=1)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def repeated_anchors(rows: DataFrame, length: int) -> np.ndarray:
    """The bitmap of anchors found at two places or more."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        found, n = np.unique(Windows(batch.column("text"), length).chosen(), return_counts=True)
        yield {"h": found.view(np.int64), "n": n}

    counted = mapped(rows.select("text"), step, "h long, n long", most=SLICE).groupBy("h").agg(F.sum("n").alias("n"))
    return bitmap(written(counted.filter("n >= 2").select("h"), "anchors"))


def suffixes(rows: DataFrame, length: int) -> DataFrame:
    """path and places (row_key and start, packed) of the suffixes whose first window has a repeated anchor."""
    shared = rows.sparkSession.sparkContext.broadcast(repeated_anchors(rows, length))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        w = Windows(batch.column("text"), length)
        least = w.anchors()[1]
        at = np.flatnonzero(w.inside & holds(shared.value, least))
        paths = w.paths(at)
        mixed = np.zeros(len(at), np.uint64)
        for k in w._starts(length):
            mixed = mix(mixed * _STEP + w.of_unit[at + k])
        order = np.argsort(mixed, kind="stable")
        paths, at = paths[order], at[order]
        new = np.append(True, (paths[1:] != paths[:-1]).any(1))[: len(at)]
        cut = np.append(np.flatnonzero(new), len(at))
        places = np.zeros(len(at), _PLACE)
        places["row"] = batch.column("row_key").to_numpy()[w.owner[at]]
        places["start"] = at - np.searchsorted(w.owner, w.owner[at])
        width = paths.shape[1]
        yield {"path": _binary(paths[new].reshape(-1), np.arange(len(cut)) * width), "places": _binary(places.view(np.uint8), cut * _PLACE.itemsize)}

    return mapped(rows.select("row_key", "text"), step, "path binary, places binary", most=SLICE)


def groups(rows: Iterator[tuple[bytes, bytes]], sizes: list[int], most: int = GROUP) -> Iterator[list[tuple[bytes, bytes]]]:
    """Sorted (path, places) in lists of about `most`, cut where the shortest prefix changes that lets them fit.

    sizes: the bytes of a path's prefixes of one symbol, two, and so on.

    Rows of one path that don't fit by themselves come in several lists, the last row of
    each at the head of the next.
    """
    held: list[tuple[bytes, bytes]] = []
    for row in rows:
        held.append(row)
        if len(held) <= most:
            continue
        for size in sizes:
            last = held[-1][0][:size]
            cut = next((k for k in range(len(held) - 1, 0, -1) if held[k - 1][0][:size] != last), 0)
            if cut:
                yield held[:cut]
                held = held[cut:]
                break
        else:
            yield held
            held = held[-1:]
    if held:
        yield held


def deep_leaves(group: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Places of the leaves below internal nodes of full depth in the tree of a sorted group.

    A leaf lies below such a node if the longest common prefix with a neighbour is the
    whole path, or if it stands for several places itself.
    """
    paths = np.frombuffer(b"".join(p for p, _ in group), np.uint8).reshape(len(group), -1)
    same = (paths[1:] == paths[:-1]).all(1)
    sizes = np.array([len(x) for _, x in group])
    deep = np.append(same, False) | np.append(False, same) | (sizes > _PLACE.itemsize)
    places = np.frombuffer(b"".join(x for _, x in group), _PLACE)
    return places[np.repeat(deep, sizes // _PLACE.itemsize)]


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """row_key and start of each window whose words also start elsewhere, some of them twice. rows: row_key and text, a written table."""
    sizes = np.cumsum(widths(length)).tolist()
    fields = arrow_schema(rows.sparkSession, "row_key long, start int")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_order = ((p, x) for b in batches for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for group in groups(in_order, sizes):
            found = deep_leaves(group)
            yield record_batch({"row_key": np.ascontiguousarray(found["row"]), "start": np.ascontiguousarray(found["start"])}, fields)

    by_prefix = suffixes(rows, length).repartition(F.substring("path", 1, sizes[0])).sortWithinPartitions("path")
    return by_prefix.select("path", "places").mapInArrow(subtrees, "row_key long, start int")


def spans_of(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of words, end exclusive, that windows with these starts cover."""
    if not starts:
        return []
    at = np.unique(np.array(starts, np.int64))
    gap = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + length).tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (start and end of the removed runs, in words) and kept (the other words, one space between)."""
    if length < 1:
        raise ValueError("a window has one word at least")
    rows = numbered(docs, "substring-rows", doc_id=id_col, text=docs[text_col].cast("string"))
    found = repeats(rows, length).groupBy("row_key").agg(F.collect_list("start").alias("starts"))
    run = "array<struct<start: int, end: int>>"
    fields = arrow_schema(docs.sparkSession, f"key long, runs {run}")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "end": e} for s, e in spans_of(x, length)] for x in b.column("starts").to_pylist()]
            yield record_batch({"key": b.column("row_key"), "runs": spans}, fields)

    removed = written(found.mapInArrow(runs, f"key long, runs {run}"), "substring-runs")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, spans {run}, kept string"
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(removed.select(F.xxhash64("key").alias("h"))))

    def having(wanted: bool) -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def some(batch: pa.RecordBatch) -> Iterator[dict]:
            part = batch.filter(pa.array(holds(marked.value, batch.column("hash").to_numpy().view(np.uint64)) == wanted))
            yield {"doc_id": part.column("doc_id"), "text": part.column("text"), "row_key": part.column("row_key")} if wanted else cut_rows(part, [None] * part.num_rows)

        return some

    def cut_rows(batch: pa.RecordBatch, runs: list) -> dict:
        n, gone, kept, spans = [], [], [], []
        for text, own in zip(batch.column("text").to_pylist(), runs, strict=True):
            # On bytes, split() parts at exactly x20 and x09 to x0D.
            every = (text or "").encode().split()
            left, at = [], 0
            for s in own or []:
                left += every[at : s["start"]]
                at = s["end"]
            left += every[at:]
            n.append(len(every))
            gone.append(len(every) - len(left))
            kept.append(b" ".join(left).decode())
            spans.append(own or [])
        return {"doc_id": batch.column("doc_id"), "n_words": n, "n_removed": gone, "spans": spans, "kept": kept}

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        yield cut_rows(batch, batch.column("runs").to_pylist())

    # Texts of documents without a repeat are not shuffled for the join: the bitmap tells most of them apart.
    hashed = rows.withColumn("hash", F.xxhash64("row_key"))
    own = mapped(hashed, having(True), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, row_key long")
    whole = own.join(removed, F.col("row_key") == F.col("key"), "left").select("doc_id", "text", "runs")
    return mapped(whole, cut, schema).unionByName(mapped(hashed, having(False), schema))
