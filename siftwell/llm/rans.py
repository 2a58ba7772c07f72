"""Static range asymmetric numeral system over token ids, in numpy, many lanes at a time.

A block holds up to BLOCK_IDS ids, dealt to LANES interleaved coders that share
one stream of 32-bit words. Lane l codes ids l, l + LANES, ... of the block. Every
CHECKPOINT_STEPS steps the decoder's states and its place in the stream are kept,
so that a decoder can start there; decode() runs all such stretches of all given
blocks side by side.

Block bytes: magic, n_ids, n_words, n_checkpoints (unsigned 32-bit), crc32 of the
ids, then per checkpoint the place (32-bit) and LANES states (64-bit), then the
words; a crc32 of all that comes last. All little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

MAGIC = b"RNS1"
SCALE_BITS = 22
LANES = 32
CHECKPOINT_STEPS = 256
BLOCK_IDS = LANES * CHECKPOINT_STEPS * 4
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIII")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for every id that occurs."""
    total = int(counts.sum())
    room = 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > room:
        raise ValueError("more distinct ids than the table has slots")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / total * room).astype(np.int64)), 0)
    excess = int(freq.sum()) - room
    order = np.argsort(-freq, kind="stable")
    i = 0
    while excess > 0:  # rare ids were raised to 1: take it from frequent ones
        take = min(excess, int(freq[order[i]]) - max(1, int(freq[order[i]]) // 2))
        freq[order[i]] -= take
        excess -= take
        i = (i + 1) % len(order)
    freq[order[0]] -= excess
    return freq


class Coder:
    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbols = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.filler = int(np.argmax(freq))

    def encode(self, ids: np.ndarray, group: int = 64) -> list[bytes]:
        """Blocks of the ids, in order; all but the last are full."""
        full = len(ids) // BLOCK_IDS
        out: list[bytes] = []
        for i in range(0, full, group):
            k = min(group, full - i)
            out += self._blocks(ids[i * BLOCK_IDS : (i + k) * BLOCK_IDS].reshape(k, -1))
        if full * BLOCK_IDS < len(ids):
            out += self._blocks(ids[full * BLOCK_IDS :][None])
        return out

    def _blocks(self, ids: np.ndarray) -> list[bytes]:
        n_blocks, n = ids.shape
        steps = -(-n // LANES)
        padded = np.full((n_blocks, steps * LANES), self.filler, np.int64)
        padded[:, :n] = ids
        lanes = padded.reshape(n_blocks, steps, LANES)
        x = np.full((n_blocks, LANES), _LOW, np.uint64)
        words = np.zeros((n_blocks, steps, LANES), np.uint32)
        used = np.zeros((n_blocks, steps, LANES), bool)
        kept = {}
        bits, half = np.uint64(SCALE_BITS), np.uint64(32)
        for t in range(steps - 1, -1, -1):
            s = lanes[:, t]
            f = self.freq[s]
            spill = x >= f << np.uint64(63 - SCALE_BITS)
            words[:, t] = x.astype(np.uint32)
            used[:, t] = spill
            x = np.where(spill, x >> half, x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.start[s]
            if t % CHECKPOINT_STEPS == 0:
                kept[t] = x
        return [self._packed(ids[b], words[b], used[b], {t: v[b] for t, v in kept.items()}) for b in range(n_blocks)]

    @staticmethod
    def _packed(ids: np.ndarray, words: np.ndarray, used: np.ndarray, kept: dict[int, np.ndarray]) -> bytes:
        stream = words[used]
        places = np.append(0, np.cumsum(used.sum(1)))
        head = _HEAD.pack(MAGIC, len(ids), len(stream), len(kept), zlib.crc32(ids.astype("<u4").tobytes()))
        marks = b"".join(struct.pack("<I", places[t]) + kept[t].astype("<u8").tobytes() for t in sorted(kept))
        body = head + marks + stream.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, blocks: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each block; raises ValueError on a damaged one. All stretches between checkpoints run side by side."""
        heads, jobs, streams, base = [], [], [], 0
        for b, block in enumerate(blocks):
            if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
                raise ValueError("damaged block")
            magic, n, n_words, marks, crc = _HEAD.unpack_from(block)
            if magic != MAGIC:
                raise ValueError("not a block of token ids")
            at = _HEAD.size
            steps = -(-n // LANES)
            for k in range(marks):
                place = struct.unpack_from("<I", block, at)[0]
                states = np.frombuffer(block, "<u8", LANES, at + 4)
                jobs.append((b, k * CHECKPOINT_STEPS, min(steps, (k + 1) * CHECKPOINT_STEPS), base + place, states))
                at += 4 + 8 * LANES
            streams.append(np.frombuffer(block, "<u4", n_words, at))
            heads.append((n, crc, steps))
            base += n_words
        out = [np.zeros((steps, LANES), np.uint32) for _, _, steps in heads]
        stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]) if streams else np.zeros(0, np.uint32)
        for size in sorted({j[2] - j[1] for j in jobs}):
            same = [j for j in jobs if j[2] - j[1] == size]
            got = self._stretches(np.stack([j[4] for j in same]), np.array([j[3] for j in same]), size, stream)
            for j, ids in zip(same, got, strict=True):
                out[j[0]][j[1] : j[2]] = ids
        results = []
        for ids, (n, crc, _) in zip(out, heads, strict=True):
            ids = ids.reshape(-1)[:n]
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("damaged ids")
            results.append(ids)
        return results

    def _stretches(self, x: np.ndarray, place: np.ndarray, steps: int, stream: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        out = np.zeros((len(x), steps, LANES), np.uint32)
        mask, bits, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
        for t in range(steps):
            slot = x & mask
            s = self.symbols[slot]
            out[:, t] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            need = x < _LOW
            order = np.cumsum(need, 1)
            word = stream[np.minimum(place[:, None] + order - 1, len(stream) - 1)]
            x = np.where(need, (x << half) | word, x)
            place = place + order[:, -1]
        return out
