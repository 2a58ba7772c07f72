"""Repair of conversation structure: the cheapest edits that make the roles alternate, ties by their audit.

Rows are read by turn (nulls first), then role, then text. An edit is Keep, Rerole (to user or
assistant), Delete or Insert (an empty user or assistant row); the roles that result must spell
`(s?(ua)+)?` by their initials. The audit is the initials of the edits in order; of equally
cheap edits those with the least audit are taken. A conversation is never held in one task:

1. Rows are dealt by ranges of (conversation, turn, role, text), so that a long conversation spreads
   over tasks, and cut into blocks of BLOCK rows. For each block, costs from each state of the
   pattern to each other are a matrix in which sums are least values and products are sums.
2. Cost DP: from the last block to the first, a conversation's matrices give the cost from the
   end of each block on; one small row per block passes through the conversation's task.
3. Path ranking by prefix doubling: the nodes of a block are (rows done, state), its arcs the
   edits that keep the cost least. Nodes are ranked by the first letter of their least audit,
   then by the first two, four, eight: the rank of a node and that of the node so many letters
   ahead are a pair whose order is the next rank, and pointers double with it. The least path
   from each state is then read off the doubled pointers, all blocks of a batch at once.
4. From the first block to the last, states choose the path of each block; what the edits
   leave is hashed in order, the only step that is bound to one task per conversation.

A state and a letter lead to one state only, so an audit tells the repaired rows too.
Defined results: a null role or text is one space, of a damaged row too; a null conversation
id is a conversation; rows that are equal in all four columns are repeats; roles whose initial
is none of s, u, a can't be kept; conversations without rows have counts of 0 and empty texts;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.frames import arrow_schema, crc32_text, only, record_batch, written

BLOCK = 4096
#: Letters of all paths that are read off at a time.
LETTERS = 1 << 21
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
#: States: nothing yet, after system, after user, after assistant. What a user or assistant row that fits leads to.
STATES = 4
FITTING = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
LEADS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Letters to append, and their cost, where rows end in a state.
LAST = ("", "II", "I", "")
AT_END = tuple(INSERT * len(x) for x in LAST)
LEGAL = {"su", "ua", "au"}
NONE, BLANK, DUPLICATE, CUT = range(4)
_INITIALS = "sua?"
_CODES = {"s": 0, "u": 1, "a": 2}
SPACES = " \t\n\v\f\r"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as a careless export leaves them: by a checksum of conversation and turn, one in 20 each is dropped,
    emptied, robbed of its sentence ends, repeated, or given the role user."""
    space = F.lit(" ")
    plain = only(rows, conv_id=conv_col, turn=turn_col, role=F.coalesce(rows[role_col].cast("string"), space), text=F.coalesce(rows[text_col].cast("string"), space))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = plain.withColumn("kind", crc32_text(key) % 20).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def _conv(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def step(dist: list[int], initial: str, fault: int) -> list[int]:
    """Least costs from each state before a row, from those after it."""
    base = [DELETE + d for d in dist]
    if fault in (NONE, CUT):
        more = TRUNCATED if fault == CUT else 0
        for q in range(STATES):
            base[q] = min(base[q], REROLE + more + dist[FITTING[q]])
            if (q, initial) in LEADS:
                base[q] = min(base[q], more + dist[LEADS[q, initial]])
    user, answer = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    return [min(base[0], INSERT + user), min(base[1], INSERT + user), user, answer]


def costs(codes: bytes, after: list[int]) -> list[list[int]]:
    """Least costs before each row of a block, and after the last."""
    out = [after]
    for code in reversed(codes):
        out.append(step(out[-1], _INITIALS[code & 3], code >> 2))
    return out[::-1]


def matrix(codes: bytes) -> list[int]:
    """STATES * STATES least costs from a state before a block to one after it."""
    ends = [costs(codes, [0 if q == to else NEVER for q in range(STATES)])[0] for to in range(STATES)]
    return [min(ends[to][q], NEVER) for q in range(STATES) for to in range(STATES)]


def optimal_arcs(codes: bytes, after: list[int], base: int) -> list[tuple[int, int, int]]:
    """(node, letter, node) of all edits on cheapest paths; nodes are base + STATES * rows done + state."""
    dist, out = costs(codes, after), []
    for i, code in enumerate(codes):
        here, ahead = dist[i], dist[i + 1]
        initial, fault = _INITIALS[code & 3], code >> 2
        at, to = base + STATES * i, base + STATES * (i + 1)
        more = TRUNCATED if fault == CUT else 0
        for q in range(STATES):
            if here[q] == DELETE + ahead[q]:
                out.append((at + q, ord("D"), to + q))
            if here[q] == INSERT + here[FITTING[q]]:
                out.append((at + q, ord("I"), at + FITTING[q]))
            if fault in (NONE, CUT):
                if (q, initial) in LEADS and here[q] == more + ahead[LEADS[q, initial]]:
                    out.append((at + q, ord("K"), to + LEADS[q, initial]))
                if here[q] == REROLE + more + ahead[FITTING[q]]:
                    out.append((at + q, ord("R"), to + FITTING[q]))
    return out


def _first_arcs(arcs: np.ndarray, by: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the letter and end of its arc with the least letter and, at one letter, least `by`; an end leads to itself."""
    frm, letters, to = arcs.T
    order = np.lexsort((by[to], letters, frm))
    best = order[np.append(True, frm[order][1:] != frm[order][:-1])[: len(order)]]
    letter, ahead = np.zeros(nodes, np.int64), np.arange(nodes)
    letter[frm[best]], ahead[frm[best]] = letters[best], to[best]
    return letter, ahead


def ranked(arcs: np.ndarray, nodes: int, longest: int) -> np.ndarray:
    """The place of each node in the order of their least audits, which have `longest` letters at most."""
    rank, jump = _first_arcs(arcs, np.zeros(nodes, np.int64), nodes)
    length = 1
    while length < longest:
        rank = np.unique(rank * (nodes + 256) + rank[jump], return_inverse=True)[1]
        jump, length = jump[jump], 2 * length
    return rank


def least_audits(blocks: list[tuple[bytes, list[int]]]) -> list[tuple[list[str], list[int]]]:
    """For each (codes, costs after it): the least audit from each state, and the state it ends in."""
    bases = np.cumsum([0, *[STATES * (len(c) + 1) for c, _ in blocks]]).tolist()
    arcs = [a for (codes, after), base in zip(blocks, bases, strict=False) for a in optimal_arcs(codes, after, base)]
    longest = max(STATES * (len(c) + 1) for c, _ in blocks)
    table = np.array(arcs, np.int64).reshape(-1, 3)
    letter, jump = _first_arcs(table, ranked(table, bases[-1], longest), bases[-1])
    starts = np.array(bases[:-1])[:, None] + np.arange(STATES)
    path = starts.reshape(-1, 1)
    # The pointers and the part of each path that has been read off double together.
    while letter[path[:, -1]].any():
        path = np.concatenate([path, jump[path]], axis=1)
        jump = jump[jump]
    audits = ["".join(map(chr, x[x > 0])) for x in letter[path]]
    ends = (path[:, -1].reshape(-1, STATES) - np.array(bases[1:])[:, None] + STATES).tolist()
    return [(audits[STATES * k : STATES * (k + 1)], ends[k]) for k in range(len(blocks))]


def _batches_of(blocks: list[tuple[bytes, list[int]]]) -> Iterator[list[tuple[bytes, list[int]]]]:
    """Blocks in lists whose paths fit into LETTERS."""
    held, longest = [], 0
    for b in blocks:
        now = max(longest, 8 * (len(b[0]) + 1))
        if held and STATES * (len(held) + 1) * now > LETTERS:
            yield held
            held, now = [], 8 * (len(b[0]) + 1)
        held.append(b)
        longest = now
    if held:
        yield held


def apply(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """`role:text` of the rows that edits leave, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = FITTING[state]
            out.append(f"{NAMES[state]}:")
            continue
        if letter == "K":
            state = LEADS[state, roles[at][:1]]
            out.append(f"{roles[at]}:{texts[at]}")
        elif letter == "R":
            state = FITTING[state]
            out.append(f"{NAMES[state]}:{texts[at]}")
        at += 1
    return out, state


def _code(role: str, text: str, later: bool) -> int:
    end = text.rstrip(SPACES)
    fault = BLANK if not end else DUPLICATE if later else CUT if end[-1] not in ".!?" else NONE
    return _CODES.get(role[:1], 3) | fault << 2


_BLOCKS = "conv string, part int, num int, codes binary, initials string, matrix array<long>, roles array<string>, texts array<string>"


def _blocks(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, later, in order within and across partitions, as blocks."""
    fields = arrow_schema(rows.sparkSession, _BLOCKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, num, before = TaskContext.get().partitionId(), 0, None
        conv, codes, roles, texts = None, bytearray(), [], []

        def block() -> pa.RecordBatch:
            initials = "".join(r[:1] or "?" for r in roles)
            return record_batch({"conv": [conv], "part": [part], "num": [num], "codes": [bytes(codes)], "initials": [initials], "matrix": [matrix(bytes(codes))], "roles": [roles], "texts": [texts]}, fields)

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "later")], strict=True):
                if codes and (row[0] != conv or len(codes) == BLOCK):
                    yield block()
                    num, codes, roles, texts = num + 1, bytearray(), [], []
                conv = row[0]
                codes.append(_code(row[2], row[3], row[4] or row[:4] == before))
                roles.append(row[2])
                texts.append(row[3])
                before = row[:4]
        if codes:
            yield block()

    return rows.mapInArrow(cut, _BLOCKS)


def _costs_after(blocks: DataFrame) -> DataFrame:
    """conv, part, num, codes, last (is it the conversation's last block), start and after: costs before and after each block."""
    schema = "conv string, part int, num int, codes binary, last boolean, start array<long>, after array<long>"
    fields = arrow_schema(blocks.sparkSession, schema)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, dist = None, list(AT_END)
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in fields}
            for c, part, num, codes, m in zip(*[x.to_pylist() for x in b.columns], strict=True):
                last = c != conv
                if last:
                    conv, dist = c, list(AT_END)
                start = [min(m[STATES * q + to] + dist[to] for to in range(STATES)) for q in range(STATES)]
                for name, x in zip(out, (c, part, num, codes, last, start, dist), strict=True):
                    out[name].append(x)
                dist = start
            yield record_batch(out, fields)

    order = [F.col("conv"), F.desc("part"), F.desc("num")]
    return blocks.select("conv", "part", "num", "codes", "matrix").repartition("conv").sortWithinPartitions(*order).mapInArrow(back, schema)


def _paths(costed: DataFrame) -> DataFrame:
    """conv, part, num, last, cost, and the audit and end from each state."""
    schema = "conv string, part int, num int, last boolean, start array<long>, audits array<string>, ends array<int>"
    fields = arrow_schema(costed.sparkSession, schema)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = list(zip(b.column("codes").to_pylist(), b.column("after").to_pylist(), strict=True))
            found = [x for some in _batches_of(blocks) for x in least_audits(some)]
            columns = {c: b.column(c) for c in ("conv", "part", "num", "last", "start")}
            yield record_batch(columns | {"audits": [a for a, _ in found], "ends": [e for _, e in found]}, fields)

    return costed.repartition("conv", "part", "num").mapInArrow(rank, schema)


def _chosen(paths: DataFrame) -> DataFrame:
    """conv, part, num, state before a block, its audit, and whether it is the conversation's first or last; cost of the whole."""
    schema = "c string, p int, k int, state int, audit string, last boolean, cost long"
    fields = arrow_schema(paths.sparkSession, schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, cost = None, 0, 0
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in fields}
            for c, part, num, last, start, audits, ends in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if c != conv:
                    conv, state, cost = c, 0, start[0]
                for name, x in zip(out, (c, part, num, state, audits[state], last, cost), strict=True):
                    out[name].append(x)
                state = ends[state]
            yield record_batch(out, fields)

    return paths.repartition("conv").sortWithinPartitions("conv", "part", "num").mapInArrow(choose, schema)


def _pieces(blocks: DataFrame) -> DataFrame:
    """What the edits of each block leave, its faults, and the initials at its ends."""
    schema = "conv string, part int, num int, audit string, piece binary, cost long, head string, tail string, blank long, duplicate long, truncated long, illegal long"
    fields = arrow_schema(blocks.sparkSession, schema)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in fields}
            for r in b.to_pylist():
                left, state = apply(r["audit"], r["state"], r["roles"], r["texts"])
                more = LAST[state] if r["last"] else ""
                left += apply(more, state, [], [])[0]
                faults = [c >> 2 for c in r["codes"]]
                initials = r["initials"]
                wrong = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
                # A block that leaves no row is told from one that leaves an empty line by a null.
                piece = "\n".join(left).encode() if left else None
                row = (r["conv"], r["part"], r["num"], r["audit"] + more, piece, r["cost"], initials[:1], initials[-1:], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), wrong)
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            yield record_batch(out, fields)

    return blocks.mapInArrow(edit, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """One row per conversation."""
    schema = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    fields = arrow_schema(pieces.sparkSession, schema)
    counts = ("blank", "duplicate", "truncated", "illegal")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, audit, digest, some, tail = None, {}, [], None, False, ""
        out: dict[str, list] = {f.name: [] for f in fields}

        def close() -> None:
            for name, x in (now | {"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}).items():
                out[name].append(x)

        for b in batches:
            for r in b.to_pylist():
                if r["conv"] != conv:
                    if conv is not None:
                        close()
                    conv, now, audit, digest, some, tail = r["conv"], dict.fromkeys(counts, 0) | {"cost": r["cost"]}, [], hashlib.sha256(), False, ""
                for c in counts:
                    now[c] += r[c]
                now["illegal"] += bool(tail) and tail + r["head"] not in LEGAL
                tail = r["tail"]
                audit.append(r["audit"])
                if r["piece"] is not None:
                    digest.update(b"\n" * some + r["piece"])
                    some = True
            if out["conv"]:
                yield record_batch(out, fields)
                out = {f.name: [] for f in fields}
        if conv is not None:
            close()
            yield record_batch(out, fields)

    return pieces.repartition("conv").sortWithinPartitions("conv", "part", "num").mapInArrow(join, schema)


def repaired(rows: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ids: conversations to report besides those of the rows, by a column conv_id.
    """
    space = F.lit(" ")
    plain = only(rows, conv=_conv(rows[conv_col]), turn=rows[turn_col], role=F.coalesce(rows[role_col].cast("string"), space), text=F.coalesce(rows[text_col].cast("string"), space))
    # Length first, so that the border between role and text is part of what is hashed.
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marked = written(plain.withColumn("digest", digest), "conversation-rows")
    when = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    again = marked.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(when).alias("first")).filter("n > 1")
    again = again.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    met = marked.join(again, (F.col("conv") == F.col("c")) & (F.col("digest") == F.col("d")), "left")
    told = written(met.select("conv", "turn", "role", "text", F.coalesce(when > F.col("first"), F.lit(False)).alias("later")), "conversation-rows")
    order = ["conv", "turn", "role", "text"]
    blocks = written(_blocks(told.repartitionByRange(*order).sortWithinPartitions(*order)), "conversation-blocks")
    chosen = _chosen(_paths(_costs_after(blocks)))
    same = (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")) & (F.col("num") == F.col("k"))
    found = _joined(_pieces(blocks.join(chosen, same).select("conv", "part", "num", "codes", "initials", "roles", "texts", "state", "audit", "last", "cost")))
    turns = marked.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    known = only(rows, conv_id=conv_col)
    if ids is not None:
        known = known.unionByName(only(ids, conv_id="conv_id"))
    known = known.distinct()
    named = known.withColumn("named", _conv(F.col("conv_id"))).join(turns, F.col("named") == F.col("conv"), "left").drop("conv")
    whole = named.join(found, F.col("named") == F.col("conv"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
