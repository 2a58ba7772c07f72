"""Token ids of whole texts by the tokenizers library, with a memo of words.

The byte-level files split a text into words before any merge, so the ids of a
text are those of its words, and a word met before need not be merged again. For
texts of ASCII and Latin-1 letters without apostrophes, words are found as runs
of one kind of character over the Arrow buffer, Arrow numbers the distinct ones,
and only words not in the memo go to the library's merge model. All other texts, and
those that hold an added token of the file such as <|endoftext|>, go through the
library's whole chain. Both ways give the same ids.
The memo lives in the Python worker and is emptied at MEMO_WORDS words.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftwell.llm.word_arrays import buffer_of

MEMO_WORDS = 1_500_000
MEMO_BYTES = 48
#: How the byte-level files spell bytes: printable ones as they are, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}
#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other; 9 not for the short way.
_KIND = np.full(256, 9, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[0x20, 0x0A]] = 0
_KIND[0x27] = 9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _rule(spec: dict) -> str | None:
    """The file's way to find words: "spaced" (a word takes the space before it), "bare" (lower case, no white space) or unknown."""
    steps = spec["pre_tokenizer"] or {}
    steps = steps.get("pretokenizers", [steps])
    kinds = [s.get("type") for s in steps]
    made = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if kinds == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not spec["normalizer"]:
        return "spaced"
    if kinds == ["Split", "ByteLevel"] and steps[0]["invert"] and r"[\p{L}]+|[\p{N}]|" in steps[0]["pattern"].get("Regex", "") and made == ["NFC", "Replace", "Lowercase"]:
        return "bare"
    return None


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.rule = _rule(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        #: Added tokens, and whether the file looks for them in the normalized text, so in any case of letters.
        self.added = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers, by the library's whole chain."""
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, merge = self.memo, self.model.tokenize
        got = [memo.get(w) for w in words]
        for i, known in enumerate(got):
            if known is None:
                w = words[i]
                if self.rule == "bare" and w.isspace():
                    got[i] = b""
                else:
                    got[i] = array("I", [t.id for t in merge(w.decode("latin-1").translate(_SPELLED))]).tobytes()
                if len(w) <= MEMO_BYTES:
                    memo[w] = got[i]
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (uint32), and where each text's ids begin and end. A null text is empty."""
        data, offsets = buffer_of(texts)
        n = len(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        kind = _KIND[data]
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[:-1][latin] = 1
        kind[1:][latin] = 1
        if self.rule == "bare":
            data = _LOWER[data]
            data[1:][latin & (data[1:] < 0x9F)] += 0x20
        filled = offsets[:-1] < offsets[1:]
        odd = np.zeros(n, bool)
        odd[filled] = np.maximum.reduceat(kind, offsets[:-1][filled]) == 9
        for content, normalized in self.added:
            odd |= pc.fill_null(pc.match_substring(texts, content, ignore_case=normalized), False).to_numpy(zero_copy_only=False)
        if self.rule is None:
            odd[:] = True
        begins = np.ones(len(data) + 1, bool)
        begins[1:-1] = kind[1:] != kind[:-1]
        if self.rule == "bare":
            begins[:-1] |= kind == 2
        else:
            space = kind == 0
            follows = np.append(~space[1:], False)  # the last of white space before a word
            follows[(offsets[1:-1] - 1)[offsets[1:-1] > 0]] = False
            joins = space & follows
            begins[:-1] |= joins
            begins[1:][joins & (data == 0x20)] = False
        begins[offsets] = True
        at = np.flatnonzero(begins)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        index = coded.indices.to_numpy()
        parts = self._merged(coded.dictionary.to_pylist())
        sizes = np.array([len(p) for p in parts], np.int64) // 4
        known = np.frombuffer(b"".join(parts), "<u4")
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        ids = known[np.arange(ends[-1]) - np.repeat(ends - lengths - starts[index], lengths)]
        bounds = np.append(0, ends)[np.searchsorted(at, offsets)]
        if not odd.any():
            return ids, bounds
        own = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, got in zip(np.flatnonzero(odd), self.whole([texts[int(i)].as_py() or "" for i in np.flatnonzero(odd)]), strict=True):
            own[i] = np.frombuffer(got, "<u4")
        return np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own]))


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker and tokenizer file."""
    return Encoder(path)
