"""Secret scan: patterns for known kinds, and dictionary-primed zstandard novelty for unknown ones.

Novelty: a long run of key-like characters with letters and digits, in a context
that speaks of keys, is compressed behind the text around it by a compressor
primed with a dictionary of code and identifiers. Its marginal bytes - with it less
without it - measure what neither the context nor the dictionary explains. Runs
that cost NOVEL_RATIO bytes or more per character are reported as kind "novel".
Other copies of the run don't explain it, wherever they stand: they are left out of the
text around it, so a secret that is written twice is reported at each place with a
sensitive context, and the cleaned text has none of its copies.

Arrow's matcher first finds the texts that could hold any span at all; every such
text is searched whole. Defined results: a null or empty text has no spans; a null
id is kept; repeated rows are judged each; extra columns are ignored. Places are
code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.frames import mapped, only

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|credential|bearer|private|signature", re.I | re.A)
#: What Arrow looks for: any text with a span matches one of the two.
_BASE = r"AKIA[A-Z0-9]|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]"
_NOVEL = r"[A-Za-z0-9+/_=-]{20}"
_HINT = r"(?i)key|secret|token|passw|pwd|auth|credential|bearer|private|signature"
CONTEXT_CHARS = 256
HINT_CHARS = 48
NOVEL_RATIO = 0.6
#: Code and identifiers that a secret is not made of; a parameter of scan().
IDENTIFIERS = (
    "import from return def class function const let var public private static void string int bool true false null none self this "
    "get_access_token set_password client_secret api_key secret_key private_key auth_token bearer_token authorization credentials "
    "application/json content-type user_agent session_id request_id access_key_id config settings environment process.env os.environ "
    "https://www.example.com/api/v1/users/login?redirect_uri=callback&grant_type=client_credentials&scope=read_write "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 example placeholder changeme your_token_here xxxxxxxxxxxxxxxx 00000000"
)


@functools.cache
def _compressor(dictionary: str) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)


def marginal_bytes(before: str, candidate: str, after: str, dictionary: str = IDENTIFIERS) -> int:
    """Compressed bytes that candidate adds to the text around it."""
    pack = _compressor(dictionary).compress
    around = (before + "\n" + after + "\n").encode(errors="replace")
    return len(pack(around + candidate.encode())) - len(pack(around))


def _core(run: str) -> str:
    return run.strip("+/_=-") or run


def _sensitive(text: str, at: int, core: str) -> bool:
    """Whether the text before a place speaks of keys; copies of the run that lie in between don't count."""
    before = text[max(0, at - CONTEXT_CHARS) : at]
    return bool(SENSITIVE.search(before[-HINT_CHARS:]) or (core in before and SENSITIVE.search(before.replace(core, "")[-HINT_CHARS:])))


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    """The text before and after the run at a to b, without copies of it, also those that reach over the edges."""
    low, high = max(0, a - CONTEXT_CHARS), min(len(text), b + CONTEXT_CHARS)
    core = _core(text[a:b])

    def without(start: int, end: int, first: int, last: int) -> str:
        out, at, seek = [], start, first
        while (copy := text.find(core, seek, last)) >= 0:
            out.append(text[at : max(at, copy)])
            at = seek = copy + len(core)
        return "".join([*out, text[at:end]])

    return without(low, a, max(0, low - len(core) + 1), a), without(b, high, b, high + len(core) - 1)


def find(text: str, dictionary: str = IDENTIFIERS, ratio: float = NOVEL_RATIO) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) of all spans, by start, then kind as listed."""
    got = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    got += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    got += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    spans = sorted((a, b) for a, _, b, _ in got)
    starts, reach = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))
    if SENSITIVE.search(text):
        for m in RUN.finditer(text):
            a, b = m.span()
            run = m[0]
            ahead = bisect.bisect_left(starts, b)
            if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) or (ahead and reach[ahead - 1] > a):
                continue
            if _sensitive(text, a, _core(run)):
                before, after = _around(text, a, b)
                if marginal_bytes(before, run, after, dictionary) >= ratio * len(run):
                    got.append((a, 3, b, a))
    return [(a, KINDS[k], b, v) for a, k, b, v in sorted(got)]


def redacted(text: str, spans: list[tuple[int, str, int, int]], mark: str = "<secret>") -> str:
    """The text with each secret replaced by a mark, and other copies of the novel ones; secrets that overlap share one."""
    out, at = [], 0
    places = {(v, b) for _, _, b, v in spans}
    novel = {_core(text[v:b]) for _, k, b, v in spans if k == "novel"}
    if novel:
        places.update(m.span() for m in re.finditer("|".join(map(re.escape, sorted(novel, key=len, reverse=True))), text))
    for start, end in sorted(places):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: str = IDENTIFIERS, ratio: float = NOVEL_RATIO, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, spans array<struct<kind, start, end, secret_start>>, clean (the text with secrets replaced; null if there is none)."""
    rows = only(docs, doc_id=docs[id_col].cast("long"), _read=docs[text_col].cast("string"), **{c: c for c in keep})
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_read"]
    schema = ", ".join([*kept, "spans array<struct<kind string, start long, end long, secret_start long>>", "clean string"])

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = pc.fill_null(batch.column("_read"), "")
        hit = pc.or_(pc.match_substring_regex(texts, _BASE), pc.and_(pc.match_substring_regex(texts, _HINT), pc.match_substring_regex(texts, _NOVEL)))
        spans: list[list[dict]] = [[] for _ in range(len(texts))]
        clean: list[str | None] = [None] * len(texts)
        for i in pc.indices_nonzero(hit).to_pylist():
            text = texts[i].as_py()
            got = find(text, dictionary, ratio)
            if got:
                spans[i] = [{"kind": k, "start": a, "end": b, "secret_start": v} for a, k, b, v in got]
                clean[i] = redacted(text, got)
        yield {c: batch.column(c) for c in ("doc_id", *keep)} | {"spans": spans, "clean": clean}

    return mapped(rows, step, schema, text="_read")


def listed(spans, novel: bool = True):
    """kind:start:end of the spans, comma-joined; without the novel ones if not wanted."""
    kept = spans if novel else F.filter(spans, lambda s: s["kind"] != "novel")
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
