"""Language of whole texts: a bidirectional gated recurrent network over bytes, in numpy.

Two recurrent layers read the bytes of a window, one in either direction; at every
position a softmax over both states labels the byte with a language. A document's
probabilities are the mean of its letters' logarithms, normalised. Trained by
backpropagation through time on windows of a bounded, hash-ordered sample of
labelled rows; applied to every byte of every text, cut into windows with margins
whose labels are not used, so that each label has seen context on both sides.

Defined results: a null text, or one without a letter, is "und" with score 0; a null
id is kept; repeated rows are judged each; extra columns are ignored; without any
labelled row every text is "und"; with one language only, every text with a letter is
in it, with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.frames import mapped, only
from siftwell.llm.word_arrays import buffer_of

HIDDEN = 8
WINDOW = 144
MARGIN = 8
#: Rows of the training sample per language at most, and bytes of a training window.
SAMPLE_ROWS = 1200
TRAIN_BYTES = 48
STEPS = 300
BATCH = 192
#: Windows read side by side.
ROWS = 2048
UNDETERMINED = "und"
_UPPER = slice(65, 91)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[_UPPER] += 32


def squashed(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the softsign: between -1 and 1 like a hyperbolic tangent, at a fraction of its cost."""
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """Weights by name. e: a row of input sums for each byte (3 gates); u: state to gates; for f(orward) and b(ackward)."""

    weights: dict[str, np.ndarray]
    languages: list[str]

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["e" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            w["c" + d] = np.zeros(hidden)
        w["o"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        w["p"] = np.zeros(len(languages))
        return cls({k: v.astype(np.float32) for k, v in w.items()}, languages)

    def _direction(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, rows, hidden) of one direction, and what the way back needs; x is (steps, rows)."""
        e, u, c = (self.weights[k + d] for k in "euc")
        n = u.shape[0]
        h = np.zeros((x.shape[1], n), np.float32)
        states, kept = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = e[x[t]]
            b = h @ u
            g = 0.5 + 0.5 * squashed(a[:, : 2 * n] + b[:, : 2 * n])
            z, r = g[:, :n], g[:, n:]
            q = b[:, 2 * n :] + c
            m = squashed(a[:, 2 * n :] + r * q)
            new = m + z * (h - m)
            kept.append((t, h, z, r, q, m))
            h = new
            states[t] = h
        return states, kept

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(languages, steps * rows) for bytes x (steps, rows)."""
        n = self.weights["uf"].shape[0]
        out = self.weights["p"][:, None] + np.zeros((1, x.size), np.float32)
        for d, o in (("f", self.weights["o"][:n]), ("b", self.weights["o"][n:])):
            out += o.T @ self._states(d, x).reshape(-1, n).T
        return out

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        """As _direction() has them, in place and without what only training needs."""
        n, rows = self.weights["uf"].shape[0], x.shape[1]
        e, u, c = (self.weights[k + d] for k in "euc")
        ez, er, em, uz, ur, um = (np.ascontiguousarray(w[:, k * n : (k + 1) * n]) for w in (e, u) for k in range(3))
        states = np.empty((*x.shape, n), np.float32)
        h = np.zeros((rows, n), np.float32)
        z, r, q, a = (np.empty((rows, n), np.float32) for _ in range(4))

        def squash(v: np.ndarray) -> None:
            np.abs(v, out=a)
            np.add(a, 1, out=a)
            np.divide(v, a, out=v)

        def gate(table: np.ndarray, w: np.ndarray, x_t: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
            np.take(table, x_t, axis=0, out=a, mode="clip")
            np.matmul(h, w, out=out)
            np.add(out, a, out=out)
            squash(out)
            np.multiply(out, 0.5, out=out)
            np.add(out, 0.5, out=out)

        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gate(ez, uz, x[t], h, z)
            gate(er, ur, x[t], h, r)
            np.matmul(h, um, out=q)
            np.add(q, c, out=q)
            np.multiply(q, r, out=q)
            np.take(em, x[t], axis=0, out=a, mode="clip")
            np.add(q, a, out=q)
            squash(q)
            np.subtract(h, q, out=r)
            np.multiply(r, z, out=r)
            h = states[t]
            np.add(q, r, out=h)
        return states

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of x (steps, rows) with a label y per row, and its gradients."""
        w, n = self.weights, self.weights["uf"].shape[0]
        f, kept_f = self._direction("f", x)
        b, kept_b = self._direction("b", x)
        both = np.concatenate([f, b], 2)
        s = both @ w["o"] + w["p"]
        s -= s.max(2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(2, keepdims=True)
        rows = np.arange(x.shape[1])
        loss = float(-np.log(p[:, rows, y] + 1e-9).mean())
        p[:, rows, y] -= 1
        p /= x.size
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["o"] = both.reshape(-1, 2 * n).T @ p.reshape(-1, p.shape[2])
        g["p"] = p.sum((0, 1))
        back = p @ w["o"].T
        for d, kept, own in (("f", kept_f, back[..., :n]), ("b", kept_b, back[..., n:])):
            u = w["u" + d]
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, h, z, r, q, m in reversed(kept):
                dh = dh + own[t]
                dm = dh * (1 - z) * (1 - np.abs(m)) ** 2
                dz = dh * (h - m) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dm * q * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                dq = dm * r
                gates = np.concatenate([dz, dr, dm], 1)
                np.add.at(g["e" + d], x[t], gates)
                into = np.concatenate([dz, dr, dq], 1)
                g["u" + d] += h.T @ into
                g["c" + d] += dq.sum(0)
                dh = dh * z + into @ u.T
        return loss, g


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> Network:
    """Fits a network to windows of labelled texts by backpropagation through time and Adam steps."""
    languages = sorted(set(labels))
    net = Network.new(languages, hidden, seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    number = np.array([languages.index(x) for x in labels])
    by_language = [np.flatnonzero(number == k) for k in range(len(languages))]
    data = [_FOLD[np.frombuffer(t, np.uint8)] for t in texts]
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), BATCH)
        x = np.full((TRAIN_BYTES, BATCH), 32, np.uint8)
        for k, label in enumerate(y):
            own = data[rng.choice(by_language[label])]
            at = rng.integers(0, max(1, len(own) - TRAIN_BYTES + 1))
            cut = own[at : at + TRAIN_BYTES]
            x[: len(cut), k] = cut
        _, g = net.gradients(x, y)
        rate = 0.02 * min(1, step / 20) * (1 - 0.95 * step / steps)
        for k in net.weights:
            mean[k] = 0.9 * mean[k] + 0.1 * g[k]
            square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
            net.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, **how: int) -> Network:
    """Trains on up to sample_rows different rows of each language among the usable rows, those first by a hash of id and text.

    From each text of the sample a stretch of 400 characters is taken, at a place given by the hash. Rows that are
    equal in both are one, so what comes to the driver is bounded by the sample, however often rows repeat.
    """
    rows = docs.filter(usable & docs[lang_col].isNotNull() & docs[text_col].rlike(r"\p{L}"))
    h = F.xxhash64(rows[id_col], rows[text_col], F.lit(11))
    at = F.pmod(F.shiftright(h, 8), F.greatest(F.lit(1), F.length(rows[text_col]) - 400)).cast("int") + 1
    drawn = rows.select(rows[lang_col].alias("lang"), h.alias("h"), F.substring(rows[text_col], at, F.lit(400)).alias("text"))
    counts = {r.lang: r.n for r in drawn.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    # A share of the hashes that holds a little more than the sample is drawn in one pass, and cut to the sample here.
    share = lambda n: F.lit(min(1 << 30, int((1 << 30) * (1.2 * sample_rows + 50) / n)))
    most = F.coalesce(*[F.when(F.col("lang") == lang, share(n)) for lang, n in counts.items()]) if counts else F.lit(0)
    sample = drawn.filter(F.pmod("h", F.lit(1 << 30)) < most).dropDuplicates(["lang", "h"])
    texts, labels, taken = [], [], dict.fromkeys(counts, 0)
    for r in sorted(sample.collect(), key=lambda r: r.h):
        if taken[r.lang] < sample_rows:
            taken[r.lang] += 1
            texts.append(r.text.encode())
            labels.append(r.lang)
    return train(texts, labels, **how)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, lang_pred, score."""
    text = docs[text_col].cast("string")
    rows = only(docs, doc_id=docs[id_col].cast("long"), _read=F.when(text.rlike(r"\p{L}"), text), **{c: c for c in keep})
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_read"] + ["lang_pred string", "score double"])

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = buffer_of(batch.column("_read"))
        sums = pooled(net, data, offsets)
        p = np.exp(sums - sums.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = np.array(pc.is_valid(batch.column("_read"))) & (len(net.languages) > 0)
        yield {c: batch.column(c) for c in ("doc_id", *keep)} | {
            "lang_pred": [net.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)],
            "score": np.where(known, p.max(1), 0.0).astype(np.float64),
        }

    return mapped(rows, step, schema, text="_read", most=1 << 19)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the mean over its letters' positions of the log probabilities, times a root of their number."""
    n, k = len(offsets) - 1, max(1, len(net.languages))
    out, used = np.zeros((n, k)), np.zeros(n)
    step = WINDOW - 2 * MARGIN
    sizes = np.diff(offsets)
    windows = -(-sizes // step)
    owner = np.repeat(np.arange(n), windows)
    if not len(owner) or k < 2:
        return out
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = offsets[owner] + within * step  # of the labels used
    blank = np.full(WINDOW, 32, np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([blank[:MARGIN], _FOLD[data], blank]), WINDOW)
    places = np.arange(WINDOW, dtype=np.int16)[:, None]
    for a in range(0, len(owner), ROWS):
        own, at = owner[a : a + ROWS], begin[a : a + ROWS]
        x = np.ascontiguousarray(views[at].T)  # begins MARGIN before the labels used: folded has that many blanks in front
        low, high = (np.clip(offsets[own + k] - at + MARGIN, 0, WINDOW).astype(np.int16) for k in (0, 1))
        valid = (places >= low) & (places < high)
        x[~valid] = 32
        s = net.logits(x).reshape(k, WINDOW, len(own))[:, MARGIN : WINDOW - MARGIN]
        s -= s.max(0)
        s -= np.log(np.exp(s).sum(0))
        x, valid = x[MARGIN : WINDOW - MARGIN], valid[MARGIN : WINDOW - MARGIN]
        use = valid & ((x >= 128) | ((x >= 97) & (x <= 122)))
        np.add.at(out, own, (s * use).sum(1).T)
        np.add.at(used, own, use.sum(0))
    count = np.maximum(used, 1)[:, None]
    return out / count * np.sqrt(count)
