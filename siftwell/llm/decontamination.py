"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, character windows, exact edit verification.

Text and items are sequences of word hashes. From a window's first word a random
walk goes over it: at step t the embedding has the word under the walk, and a bit
drawn for (round, t, word) decides whether the walk moves on, so that sequences at
a small edit distance soon walk in step again and differ in few places (Chakraborty,
Goldenberg and Koucky). A round samples SAMPLES places of the first STEPS and keys
windows by them; ROUNDS rounds reach the recall wanted. Windows begin at every word
of every text, and at every STRIDE words of an item, so an item is found by any of
its stretches. A walk ends as soon as its key so far is no item's. Items of fewer
than FEW_WORDS words are keyed by all their steps.

Walks over words need a stretch of some eight words nearly unedited, which edits of
characters spread over an item don't leave. Items that may have an edit are therefore
looked for by item-sized windows of characters too: a window must share with the item
as many runs of q bytes as all but LOSS of the items keep that have MAX_SHARE of their
bytes edited at random places, and as many runs of FINE bytes as all but a tenth of
LOSS keep, at places that the edits allowed can bring into line. q is the longest in
RUNS of which two are kept. Edits that are spread evenly rather than at random may
leave fewer.

Every match is verified: the least edit distance of the whole item to any part of the
text around it, in characters, must be at most MAX_SHARE of the item's length. Letters
A-Z count as a-z, white space of any kind as a space.

Items are taken in blocks of at most BLOCK_CHARS characters, each a pass over the
documents, so what goes to the tasks is bounded. Defined results: null or empty texts
and items match nothing; a null id is kept; repeated rows are found each; extra
columns are ignored; equal items are found each under its own id.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.frames import mapped, only
from siftwell.llm.word_arrays import buffer_of, mix, words

ROUNDS = 4
STEPS = 16
SAMPLES = 7
STRIDE = 4
FEW_WORDS = 8
MAX_SHARE = 0.2
BLOCK_CHARS = 8_000_000
_SCHEMA = "doc_id long, item_id long, start long, end long, distance long"
_TABLE_BITS = np.uint64(48)
RUNS = (8, 7, 6, 5, 4, 3, 2)
#: The runs that an item must keep for the longest of RUNS to be taken, so that few texts share as many by chance.
KEPT = 4
FINE = 4
LOSS = 0.01
#: A run that more items have than this number and this share of them is common.
COMMON_ITEMS = 2
COMMON_SHARE = 0.01
#: Pairs of a run and an item counted at a time.
_COUNTED = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number, blanks behind the end; A-Z as a-z, white space as a space."""
    padded = np.concatenate([_LOWER[data], np.full(8, 32, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def _runs(eights: np.ndarray, q: int) -> np.ndarray:
    """The run of q bytes at each place."""
    return eights[: max(0, len(eights) - q + 1)] >> np.uint64(64 - 8 * q)


def _slot(runs: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Where a run's bit is in a table of 2**(64 - shift)."""
    return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def _rare(runs: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
    """Which runs are in few of the n items: those of everyday words, which any text shares, are not."""
    _, number = np.unique(runs, return_inverse=True)
    pairs = np.unique(number * (int(items.max()) + 1) + items) // (int(items.max()) + 1) if len(items) else number
    return np.bincount(pairs, minlength=len(runs))[number] <= max(COMMON_ITEMS, COMMON_SHARE * n)


@functools.cache
def kept_runs(size: int, q: int, loss: float, share: float = MAX_SHARE, counted: float = 1.0) -> int:
    """How many runs of q bytes all but a share `loss` of texts of this size keep when int(share * size) random bytes are edited.

    Only a share `counted` of the runs, at random places, counts.
    """
    if size < q:
        return 0
    rng = np.random.default_rng(31)
    edited = rng.random((2000, size)).argsort(1) < int(share * size)
    sums = np.concatenate([np.zeros((2000, 1), int), edited.cumsum(1)], 1)
    kept = (sums[:, q:] == sums[:, :-q]) & (rng.random((2000, size - q + 1)) < counted)
    return int(np.quantile(kept.sum(1), loss, method="lower"))


def edit_search(pattern: str, text: str, most: float) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of text nearest to pattern, by bit-parallel edit distance; None beyond `most`."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    distance, end = _scan(pattern, text, True)
    if distance > most:
        return None
    _, length = _scan(pattern[::-1], text[:end][::-1], False)
    return distance, end - length, end


def _scan(pattern: str, text: str, anywhere: bool) -> tuple[int, int]:
    """Least distance of pattern to a part of text that begins anywhere, or at its first character, and where that part ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    place: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        place[c] |= 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = place.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(h | up)), up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) | (0 if anywhere else 1)
        up = full & ((minus << 1) | ~(v | plus))
        down = plus & v & full
        if score < best:
            best, end = score, i + 1
    return best, end


class Index:
    """The sampled keys of a block of items, by class of walk and round."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.items = []
        sequences = []
        for item_id, text in items:
            data, offsets = buffer_of(pa.array([text]))
            found = words(data, offsets)[0]
            if len(found):
                self.items.append((item_id, plain(text).strip(), len(found)))
                sequences.append(found)
        shapes = sorted({n if n < FEW_WORDS else STEPS for _, _, n in self.items})
        #: Per walk: bit offset of its round, sampled steps, partial keys by number of samples, and entries by key.
        self.walks = []
        for steps in shapes:
            mine = [k for k, (_, _, n) in enumerate(self.items) if (n if n < FEW_WORDS else STEPS) == steps]
            for round_ in range(ROUNDS if steps == STEPS else 1):
                sampled = np.sort(rng.choice(steps, SAMPLES, replace=False)) if steps == STEPS else np.arange(steps)
                partial: list[set[int]] = [set() for _ in sampled]
                entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for k in mine:
                    n = len(sequences[k])
                    for begin in sorted({*range(0, max(1, n - FEW_WORDS + 1), STRIDE), max(0, n - FEW_WORDS)}):
                        keys = walk_keys(sequences[k], begin, round_, sampled)
                        if keys:
                            for s, key in zip(partial, keys, strict=True):
                                s.add(key)
                            entries[keys[-1]].append((k, begin))
                self.walks.append((round_, sampled, [_table(s) for s in partial], np.array(sorted(entries), np.uint64), dict(entries)))

        self._window()

    def _window(self) -> None:
        """Of each q: its items' sorted runs, and for each the items that have it and where; per item its size, the edits allowed and the runs to share."""
        #: Items of more bytes are rounded down, so that few sizes have to be drawn.
        sized = lambda m: m if m < 256 else min(2048, 1 << (m.bit_length() - 1) | (m & (7 << (m.bit_length() - 4))))
        data = [np.frombuffer(text.encode(), np.uint8) for _, text, _ in self.items]
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.edits = (MAX_SHARE * self.sizes).astype(np.int64)
        self.least = np.zeros(len(data), np.int64)
        by_q: dict[int, list[int]] = defaultdict(list)
        for k, m in enumerate(self.sizes.tolist()):
            if self.edits[k] >= 1:
                by_q[next((q for q in RUNS if kept_runs(sized(m), q, LOSS) >= KEPT), RUNS[-1])].append(k)
        #: Per item its runs of FINE bytes, sorted, where they lie in it, and how many a match has in line.
        self.fine: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for k, m in enumerate(self.sizes.tolist()):
            if (least := kept_runs(sized(m), FINE, LOSS / 10)) > 1:
                short = _runs(_eights(data[k]), FINE)
                order = np.argsort(short, kind="stable")
                self.fine[k] = (short[order], order, least)
        self.windows = []
        for q, mine in by_q.items():
            own = [_runs(_eights(data[k]), q) for k in mine]
            flat, items = np.concatenate(own), np.repeat(mine, [len(x) for x in own])
            places = np.concatenate([np.arange(len(x)) for x in own])
            rare = _rare(flat, items, len(mine))
            for k, x in zip(mine, np.split(rare, np.cumsum([len(x) for x in own])[:-1]), strict=True):
                # An item of common runs only is found by all of its runs.
                eighths = int(8 * x.mean())
                enough = kept_runs(sized(int(self.sizes[k])), q, LOSS, counted=eighths / 8) if eighths else 0
                if enough < 2:
                    x[:] = True
                    enough = kept_runs(sized(int(self.sizes[k])), q, LOSS)
                self.least[k] = max(1, enough)
            flat, items, places = flat[rare], items[rare], places[rare]
            order = np.argsort(flat, kind="stable")
            runs, first, count = np.unique(flat[order], return_index=True, return_counts=True)
            bits = min(24, max(10, (16 * len(runs)).bit_length()))
            table, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
            table[_slot(runs, shift)] = True
            self.windows.append((q, runs, table, shift, first, count, items[order], places[order]))

    def regions(self, eights: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first byte, end) of the windows of data that share enough runs with an item, in line.

        A run that text and item share says where the item would begin. Edits shift that place by their
        number at most, so the runs that a whole item keeps lie in two neighbouring cells of twice as many places.
        """
        found = []
        for q, runs, table, shift, first, count, items, places in self.windows:
            here = _runs(eights, q)
            at = np.flatnonzero(table[_slot(here, shift)])
            near = np.minimum(np.searchsorted(runs, here[at]), len(runs) - 1)
            same = runs[near] == here[at]
            at, near = at[same], near[same]
            if not len(at):
                continue
            most = int(self.sizes[items].max())  # no item begins further ahead of the data
            span = len(eights) + most + 4  # more than the cells of any item
            keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
            total = np.cumsum(count[near])
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _COUNTED, "right")))
                n = count[near[a:b]]
                posting = np.repeat(first[near[a:b]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                item = items[posting]
                begin = np.repeat(at[a:b], n) - places[posting] + most
                got, times = np.unique(item * span + begin // (2 * self.edits[item] + 1), return_counts=True)
                both, into = np.unique(np.append(keys, got), return_inverse=True)
                keys, sums = both, np.bincount(into, np.append(sums, times)).astype(np.int64)
                a = b
            # A window is two cells in a row. It begins at a cell with a run, or at the one before.
            begins = np.unique(np.concatenate([keys, keys - 1]))
            shared = np.zeros(len(begins), np.int64)
            for k in range(2):
                place = np.minimum(np.searchsorted(keys, begins + k), len(keys) - 1)
                shared += np.where(keys[place] == begins + k, sums[place], 0)
            item = (begins + 1) // span  # the cell before the first of an item is still its own
            enough = shared >= self.least[item]
            # Windows in a row are one region.
            begins, item = begins[enough], item[enough]
            starts = np.flatnonzero(np.append(True, (np.diff(begins) > 1) | (np.diff(item) > 0))) if len(begins) else begins
            ends = np.append(starts[1:], len(begins))[: len(starts)] - 1
            for k, x, y in zip(item[starts].tolist(), begins[starts].tolist(), begins[ends].tolist(), strict=True):
                cell, edits = 2 * int(self.edits[k]) + 1, int(self.edits[k])
                low, high = (x - k * span) * cell - most, (y - k * span + 2) * cell - most + int(self.sizes[k])
                found.append((k, max(0, low - edits), min(len(eights), high + edits)))
        return found

    def in_line(self, item: int, eights: np.ndarray) -> bool:
        """Whether a part of a text shares enough short runs with the item on diagonals no further apart than edits allow."""
        if item not in self.fine:
            return True
        runs, places, least = self.fine[item]
        here = _runs(eights, FINE)
        low = np.searchsorted(runs, here)
        met = np.flatnonzero(runs[np.minimum(low, len(runs) - 1)] == here)
        if len(met) < least:
            return False
        low = low[met]
        n = np.searchsorted(runs, here[met], "right") - low
        at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        edits = int(self.edits[item])
        sums = np.append(0, np.cumsum(np.bincount(np.repeat(met, n) - places[at] + len(runs), minlength=2 * edits + 1)))
        return bool((sums[2 * edits + 1 :] - sums[: -2 * edits - 1]).max() >= least)

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int, int]]:
        """(word, item, the window's own word) where the item's first word would be that of the text, for windows at all words."""
        found = set()
        for round_, sampled, tables, keys, entries in self.walks:
            if not len(keys):
                continue
            start = np.arange(len(hashes))
            at, key, sample = start, np.zeros(len(start), np.uint64), 0
            for t in range(int(sampled[-1]) + 1):
                x = hashes[at]
                if t == sampled[sample]:
                    key = mix(key + x)
                    alive = tables[sample][(key >> _TABLE_BITS).astype(np.int64)]
                    start, at, key, x = start[alive], at[alive], key[alive], x[alive]
                    sample += 1
                    if sample == len(sampled) or not len(at):
                        break
                at = at + _moves(x, round_, t)
                inside = at < len(hashes)
                if not inside.all():
                    start, at, key = start[inside], at[inside], key[inside]
            if sample < len(sampled) or not len(start):
                continue
            near = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            for w, k in zip(start[near].tolist(), key[near].tolist(), strict=True):
                found.update((w - begin, item, w) for item, begin in entries[k])
        return found


def _moves(x: np.ndarray, round_: int, t: int) -> np.ndarray:
    return ((x >> np.uint64((round_ * STEPS + t) % 64)) & np.uint64(1)).astype(np.int64)


def _table(keys: set[int]) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(np.array(sorted(keys), np.uint64) >> _TABLE_BITS).astype(np.int64)] = True
    return out


def walk_keys(hashes: np.ndarray, begin: int, round_: int, sampled: np.ndarray) -> list[int] | None:
    """The key after each sampled step of the walk from word begin; None if it leaves the item."""
    at, key, keys = begin, np.zeros(1, np.uint64), []
    wanted = set(sampled.tolist())
    for t in range(int(sampled[-1]) + 1):
        if at >= len(hashes):
            return None
        x = hashes[at : at + 1]
        if t in wanted:
            key = mix(key + x)
            keys.append(int(key[0]))
        at += int(_moves(x, round_, t)[0])
    return keys


_PLAIN = {c: " " for c in range(9, 14)} | {c: chr(c + 32) for c in range(65, 91)}


def plain(text: str) -> str:
    return text.translate(_PLAIN)


def hits_of(index: Index, texts: pa.Array, max_share: float = MAX_SHARE) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, start, end, distance) of every verified match; matches of an item in a text don't overlap."""
    data, offsets = buffer_of(texts)
    hashes, starts, ends, owner = words(data, offsets)
    by_item: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    first = np.searchsorted(owner, np.arange(len(texts)))
    last = np.append(first[1:], len(owner))
    for w, k, at in index.candidates(hashes):
        n = index.items[k][2]
        slack = 2 + int(n * max_share)
        # A walk may begin in one text and end in the next, and the item's ends may be cut off where its window is.
        for t in {int(owner[min(max(x, 0), len(owner) - 1)]) for x in (w, at, w + n - 1)}:
            by_item[t, k].add((max(int(first[t]), w - slack), min(int(last[t]), w + n + slack)))
    eights = _eights(data)
    for k, low, high in index.regions(eights):
        # Words that begin before the window or end after it are whole in the region.
        a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high))
        for t in range(int(owner[a]), int(owner[b - 1]) + 1) if a < b else ():
            x, y = max(int(first[t]), a), min(int(last[t]), b)
            if x < y:
                by_item[t, k].add((x, y))
    out = []
    for (text, k), places in by_item.items():
        item_id, pattern, _ = index.items[k]
        most = max_share * len(pattern)
        matches: set[tuple[int, int, int]] = set()
        for a, b in sorted(places):
            if a >= b:
                continue
            low, high = int(starts[a]), int(ends[b - 1])
            if not index.in_line(k, eights[low:high]):
                continue
            shift = len(data[int(offsets[text]) : low].tobytes().decode(errors="replace"))
            parts = [(shift, plain(data[low:high].tobytes().decode(errors="replace")))]
            while parts:
                at, region = parts.pop()
                match = edit_search(pattern, region, most) if len(region) >= len(pattern) - most else None
                if match:
                    distance, begin, end = match
                    matches.add((distance, at + begin, at + end))
                    parts += [(at, region[:begin]), (at + end, region[end:])]
        taken: list[tuple[int, int]] = []
        for distance, begin, end in sorted(matches):
            if all(end <= x or y <= begin for x, y in taken):
                taken.append((begin, end))
                out.append((text, item_id, begin, end, distance))
    return out


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, distance: every part of a document that is an item up to the edits allowed."""
    rows = only(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string"))
    queries = only(items, item_id=items[item_id_col].cast("long"), text=items[item_text_col].cast("string"))
    blocks = _blocks(queries, block_chars)
    found = [_pass(rows, Index(block)) for block in blocks]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], _SCHEMA)


def _blocks(queries: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time on the driver; an item longer than that is its own block."""
    held, size = [], 0
    for r in queries.filter("text is not null").orderBy(F.col("item_id").asc_nulls_first(), "text").toLocalIterator():
        if held and size + len(r.text) > block_chars:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def _pass(rows: DataFrame, index: Index) -> DataFrame:
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc_id").to_pylist()
        got = hits_of(index, batch.column("text"))
        if got:
            yield {
                "doc_id": [ids[g[0]] for g in got],
                "item_id": [g[1] for g in got],
                "start": [g[2] for g in got],
                "end": [g[3] for g in got],
                "distance": [g[4] for g in got],
            }

    return mapped(rows, step, _SCHEMA)
