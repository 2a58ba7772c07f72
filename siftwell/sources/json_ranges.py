"""Where the posts of an archive begin and end, found range by range.

An archive is one JSON array behind a script's assignment, so no line or byte tells by itself
whether it lies in a text or between two posts. But Spark can split the file at closing braces
wherever they stand, and of each range two things can be said alone: how its braces and
brackets change the depth if it begins outside a text, and how if it begins inside one. Ranges
are read a first time for these two effects. Composed in order, from the first range of a file
to the last, they give the true state and the number of posts before each range. With them
ranges are read again and cut into posts, each range on its own. What is held of a range
between the two readings is one small row; posts that begin in one range and end in another
come as pieces with their number.

Escapes need no state across pieces: a brace ends a piece, and none needs escaping.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np

#: What an array of posts begins with; white space is that of Unicode.
START = re.compile(rb"\[(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)*\{")
_QUOTE, _BACKSLASH, _CLOSE = b'"\\}'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1

Rows = Iterator[tuple[tuple[str, int], bytes]]


class Marks:
    """Quotes that open or close texts, and braces and brackets wherever they stand, of a stretch of bytes."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        quotes = np.flatnonzero(data == _QUOTE)
        behind = quotes[(quotes > 0) & (data[quotes - 1] == _BACKSLASH)]
        if len(behind):
            slashes = np.flatnonzero(data == _BACKSLASH)
            runs = slashes[np.append(True, np.diff(slashes) > 1)]
            length = behind - runs[np.searchsorted(runs, behind) - 1]
            quotes = np.setdiff1d(quotes, behind[length % 2 == 1], assume_unique=True)
        self.at = np.flatnonzero(_STEP[data])
        self.steps = _STEP[data[self.at]]
        self.braces = data[self.at] == _CLOSE
        self.before = np.searchsorted(quotes, self.at)
        self.flips = len(quotes) % 2

    def closing(self, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of closing braces outside texts, the depth after each, and the change of depth at the end."""
        out = (self.before + inside) % 2 == 0
        depth = np.cumsum(self.steps[out], dtype=np.int64)
        brace = self.braces[out]
        return self.at[out][brace], depth[brace], int(depth[-1]) if len(depth) else 0


@dataclass
class Effect:
    """What a range does if it begins outside or inside a text: change of depth, and closing braces by depth after them."""

    flips: int = 0
    change: list[int] = field(default_factory=lambda: [0, 0])
    braces: list[Counter] = field(default_factory=lambda: [Counter(), Counter()])

    def add(self, raw: bytes) -> None:
        marks = Marks(raw)
        for start in (0, 1):
            _, depth, change = marks.closing(start ^ self.flips)
            for d, n in zip(*np.unique(depth + self.change[start], return_counts=True), strict=True):
                self.braces[start][int(d)] += int(n)
            self.change[start] += change
        self.flips ^= marks.flips

    def plain(self) -> list:
        return [self.flips, self.change, [sorted(b.items()) for b in self.braces]]


@dataclass(frozen=True)
class State:
    """How a range begins: before the array, at its start, or in it."""

    opened: bool
    #: The range holds the array's start.
    opens: bool
    inside: int
    depth: int
    #: Posts that end before it.
    posts: int
    #: The byte before it ends a post.
    fresh: bool
    #: It is the file's last.
    last: bool


def _ranges(batches: Iterator, names: tuple[str, str, str]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """For each range of a task its pieces, joined batch by batch with the braces that parted them."""

    def runs() -> Rows:
        before = None
        for batch in batches:
            files, blocks, values = (batch.column(c).to_pylist() for c in names)
            for own, rows in groupby(zip(files, blocks, values, strict=True), key=lambda r: (r[0], r[1])):
                yield own, b"}" * (own == before) + b"}".join(r[2] for r in rows)
                before = own

    for own, rows in groupby(runs(), key=lambda r: r[0]):
        yield own, (raw for _, raw in rows)


def effects(batches: Iterator, names: tuple[str, str, str]) -> Iterator[tuple[str, int, list, list | None]]:
    """(file, block, effect of the whole range, effect from the array's start if it begins here)."""
    for (file, block), stretches in _ranges(batches, names):
        whole, begun = Effect(), None
        for raw in stretches:
            whole.add(raw)
            if begun is not None:
                begun.add(raw)
            elif found := START.search(raw):
                begun = Effect()
                begun.add(raw[found.start() :])
        yield file, block, whole.plain(), begun and begun.plain()


def states(found: list[tuple[str, int, list, list | None]]) -> tuple[dict[tuple[str, int], State], dict[str, int | None]]:
    """The state at the start of every range, and the posts of each file (None: no array begins in it)."""
    out: dict[tuple[str, int], State] = {}
    posts: dict[str, int | None] = {}
    for file, own in groupby(sorted(found, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        rows = list(own)
        opened, inside, depth, n, fresh = False, 0, 0, 0, False
        for k, (_, block, whole, begun) in enumerate(rows):
            last = k == len(rows) - 1
            opens = not opened and begun is not None
            out[file, block] = State(opened, opens, inside, depth, n, fresh, last)
            fresh = False
            if not opened and not opens:
                continue
            flips, change, braces = begun if opens else whole
            n += dict(map(tuple, braces[inside])).get(1 - depth, 0)
            inside, depth, opened = inside ^ flips, depth + change[inside], True
            # A brace lies between one range and the next.
            if not last and not inside:
                depth -= 1
                fresh = depth == 1
                n += fresh
        posts[file] = n if opened else None
    return out, posts


def pieces(batches: Iterator, names: tuple[str, str, str], known: dict[tuple[str, int], State]) -> Iterator[tuple[str, int, int, bytes, bool, bool]]:
    """(file, post, block, bytes, closed, whole): the posts of each range with what parts them from the one before.

    What follows the last post is a piece that isn't closed. A piece is whole unless another
    range holds a part of the same post.
    """
    for (file, block), stretches in _ranges(batches, names):
        state = known[file, block]
        if not state.opened and not state.opens:
            for _ in stretches:
                pass
            continue
        inside, depth, post, begins = state.inside, state.depth, state.posts, state.opens or state.fresh
        waits, held = state.opens, []

        def ended(stretches: Iterator[bytes] = stretches, last: bool = state.last) -> Iterator[bytes]:
            yield from stretches
            if not last:
                yield b"}"

        for raw in ended():
            if waits:
                found = START.search(raw)
                if not found:
                    continue
                raw, waits = raw[found.start() :], False
            marks = Marks(raw)
            at, after, change = marks.closing(inside)
            start = 0
            for end in (at[after + depth == 1] + 1).tolist():
                yield file, post, block, b"".join([*held, raw[start:end]]), True, begins
                post, begins, start, held = post + 1, True, end, []
            held.append(raw[start:])
            inside, depth = inside ^ marks.flips, depth + change
        rest = b"".join(held)
        if rest or state.last:
            yield file, post, block, rest, False, begins and state.last
