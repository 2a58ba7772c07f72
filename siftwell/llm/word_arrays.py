"""Words and word hashes of many texts at once, as numpy arrays over an Arrow buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240601)
#: A random number for each byte, and one for each place in a word, in turn.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = int(at[0])
    size = int(at[-1]) - base
    return (np.frombuffer(data, np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)), at - base


class Alphabet:
    """Which bytes part words, and the random number of every other byte."""

    def __init__(self, apart: bytes, folded: bool):
        self.space = np.zeros(256, bool)
        self.space[list(apart)] = True
        self.byte = _BYTE.copy()
        if folded:
            self.byte[65:91] = self.byte[97:123]
        self.byte[self.space] = 0


#: Words outside x20 and x09 to x0D, A-Z as a-z, and the same as they are.
FOLDED = Alphabet(b" \t\n\v\f\r", folded=True)
EXACT = Alphabet(b" \t\n\v\f\r", folded=False)


def words(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20, alphabet: Alphabet = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text number) of each word of the alphabet.

    Texts longer than `most` bytes are hashed a stretch at a time, cut at white space.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    cuts = [0]
    while n - cuts[-1] > most:
        near = cuts[-1] + most
        gaps = np.flatnonzero(alphabet.space[data[cuts[-1] : near]])
        cut = cuts[-1] + int(gaps[-1]) if len(gaps) and gaps[-1] > 0 else near
        if cut == near:  # one word longer than a stretch
            gaps = np.flatnonzero(alphabet.space[data[near:]])
            cut = near + int(gaps[0]) if len(gaps) else n
        cuts.append(cut)
    found = [_stretch(data[a:b], a, offsets, alphabet) for a, b in zip(cuts, [*cuts[1:], n], strict=True) if b > a]
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _stretch(data: np.ndarray, base: int, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~alphabet.space[data]
    begins = np.zeros(len(data) + 1, bool)
    inner = offsets[(offsets >= base) & (offsets <= base + len(data))] - base
    begins[inner] = True
    begins[0] = begins[-1] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    tail = data[starts[0] :]
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    sums = np.add.reduceat(alphabet.byte[tail] * _PLACE[place & 4095], starts - starts[0])
    return mix(sums + lengths.astype(np.uint64)), starts + base, ends + base


def sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least (a ufunc like np.minimum) over each window of `width` neighbours."""
    have = 1
    while have < width and len(x):
        step = min(have, width - have)
        x = least(x[: max(len(x) - step, 0)], x[step:])
        have += step
    return x
