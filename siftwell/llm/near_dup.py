"""MinHash near-deduplication by tensored banding, with every link verified on full shingle sets.

Instead of SIDE * SIDE table keys of their own minhashes, two collections of SIDE
subkeys (of WIDTH minhashes each) are computed, and table (i, j) is keyed by subkey i
of the first with subkey j of the second: 2 * SIDE * WIDTH minhashes serve SIDE * SIDE
tables. Texts at similarity s meet in a table with probability
(1 - (1 - s**WIDTH)**SIDE)**2, which is 0.9985 at 0.8 and 1 - 4e-6 at 0.9.

Equal sets become one class first, so that exact copies cost nothing further. Links
are then found without ever listing the pairs of a bucket:

1. Classes that share a table key are sorted by subkeys, in ROUNDS orders, so that
   like ones are neighbours, and all pairs within blocks of neighbours are verified by
   products of incidence matrices. A block emits its components only.
2. What remains are buckets whose members lie in several components. Of their pairs
   across components, those are verified whose sizes allow a link and whose one-bit
   minhashes differ in at most most_bits() of BITS places. At similarity 0.8 they differ
   in 51 on average, standard deviation 6.8, and 73 are allowed, three deviations more;
   below 0.65 hardly a pair is left. There is no cap on the pairs, and a pair is
   listed in one of its tables only, the first in which its subkeys agree.

Words are runs outside x20 and x09 to x0D, A-Z read as a-z. Shingles and words are
64-bit hashes. Defined results: a text without words has no shingles, is a component
of its own and kept; one with fewer words than a shingle has the whole sequence as its
one shingle; a null id has no component and is kept; rows with equal ids are judged by
their own texts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.frames import arrow_schema, mapped, only, record_batch, tasks, written
from siftwell.llm.word_arrays import buffer_of, mix, words

SIDE = 10
WIDTH = 3
ROUNDS = 3
BITS = 512
BLOCK_DOCS = 256
BLOCK_SHINGLES = 2_000_000
#: Members of a block of a mixed bucket, and their shingles.
FAR_DOCS = 1024
FAR_SHINGLES = 1_000_000
#: Classes of a task that lists their subkeys or table keys; it counts up to SIDE * SIDE keys of each.
KEYED_CLASSES = 8192
#: Standard deviations by which the one-bit bound lies beyond what a pair at the least similarity differs in.
DEVIATIONS = 5
_FACTORS = np.random.default_rng(97).integers(1, 1 << 62, 2 * SIDE * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT_FACTORS = np.random.default_rng(98).integers(1, 1 << 62, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, offsets = buffer_of(texts)
    hashes, _, _, owner = words(data, offsets)
    n = len(hashes) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        rolled = mix(rolled * _STEPS[0] + hashes[k : k + n])
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                x = mix(x * _STEPS[1] + h)
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def subkeys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, SIDE) subkeys of either collection, as signed 64-bit; zeros for an empty set."""
    out = np.zeros((len(sets), 2 * SIDE), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *[len(sets[i]) for i in full]])[:-1]
        for k in range(2 * SIDE):
            key = np.zeros(len(full), np.uint64)
            for f in _FACTORS[k * WIDTH : (k + 1) * WIDTH]:
                key = mix(key * _STEPS[2] + np.minimum.reduceat(flat * f + (f >> np.uint64(7)), starts))
            out[full, k] = key
    signed = out.view(np.int64)
    return signed[:, :SIDE], signed[:, SIDE:]


def one_bits(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BITS / 64) one-bit minhashes, packed."""
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *[len(s) for s in sets]])[:-1]
    for k, f in enumerate(_BIT_FACTORS if len(flat) else []):
        least = np.minimum.reduceat(flat * f + (f >> np.uint64(7)), starts)
        out[:, k // 64] |= (mix(least) & np.uint64(1)) << np.uint64(k % 64)
    return out.view(np.int64)


def most_bits(percent: int) -> int:
    """Places in which a pair linked at this similarity differs at most, but for five standard deviations."""
    share = (1 - percent / 100) / 2
    return round(BITS * share + DEVIATIONS * (BITS * share * (1 - share)) ** 0.5)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (shingles), s1 and s2 (a 128-bit sum over the set), a and b (subkeys)."""
    schema = "doc_id long, n long, s1 long, s2 long, a array<long>, b array<long>"

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = shingle_sets(batch.column("text"), size)
        a, b = subkeys(sets)
        yield {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "s1": _sums(sets, 3), "s2": _sums(sets, 4), "a": list(a), "b": list(b)}

    return mapped(only(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string")), step, schema)


def _sums(sets: list[np.ndarray], step: int) -> np.ndarray:
    return np.array([mix(s * _STEPS[step]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def _similar(inter: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n[:, None] + n[None, :] - inter)


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(first, member) for the members of each component among the sets, all pairs verified."""
    k = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    owner, column = owner[keep], (np.cumsum(common) - 1)[column[keep]]
    inter = np.zeros((k, k), np.float32)
    for a in range(0, int(common.sum()), 2048):
        low, high = np.searchsorted(column, [a, a + 2048])
        m = np.zeros((k, 2048), np.float32)
        m[owner[low:high], column[low:high] - a] = 1
        inter += m @ m.T
    linked = _similar(inter.astype(np.int64), np.array([len(s) for s in sets]), percent)
    links, seen = [], np.zeros(k, bool)
    for i in range(k):
        if not seen[i]:
            component = np.zeros(k, bool)
            component[i] = True
            front = component
            while front.any():
                front = linked[front].any(0) & ~component
                component = component | front
            seen |= component
            links += [(i, int(j)) for j in np.flatnonzero(component) if j != i]
    return links


def _neighbour_links(sets: DataFrame, round_: int, percent: int) -> DataFrame:
    """(u, v) links found within blocks of neighbours in the order of this round's subkeys."""
    order = [F.get(c, (round_ * 3 + k) % SIDE) for k in range(3) for c in ("a", "b")]
    named = [o.alias(f"o{k}") for k, o in enumerate(order)]
    by = [f"o{k}" for k in range(len(named))] + ["rep"]
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sets.select("rep", "shingles", *named).repartitionByRange(n, *by).sortWithinPartitions(*by).select("rep", "shingles")
    fields = arrow_schema(sets.sparkSession, "u long, v long")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size, fresh = 0, 0

        def links() -> pa.RecordBatch:
            found = block_links([s for _, s in held], percent)
            pairs = [(held[i][0], held[j][0]) for i, j in found]
            return record_batch({"u": [max(p) for p in pairs], "v": [min(p) for p in pairs]}, fields)

        for batch in batches:
            for rep, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if held and (len(held) == BLOCK_DOCS or size + len(s) > BLOCK_SHINGLES):
                    yield links()
                    held = held[-(len(held) // 4) :] if len(held) >= 4 else []
                    size, fresh = sum(len(x) for _, x in held), 0
                    if size + len(s) > BLOCK_SHINGLES:
                        held, size = [], 0
                held.append((rep, s))
                size, fresh = size + len(s), fresh + 1
        if fresh and len(held) > 1:
            yield links()

    return ordered.mapInArrow(blocks, "u long, v long").filter("u != v")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of a link (u > v), by alternating stars."""
    edges = written(links.distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        met = large.join(least, F.col("u") == F.col("x"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct(), "links")


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. percent: the least similarity, in hundredths, of a link."""
    rows = only(docs, doc_id=docs[id_col].cast("long"), text=docs[text_col].cast("string"))
    sketch = written(sketches(rows, size, "doc_id", "text"), "sketches")
    same = ["n", "s1", "s2"]
    # Equal sets have equal subkeys, so any will do; the first minimum is as good as any.
    grouped = sketch.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("home"), F.first("a").alias("a"), F.first("b").alias("b"))
    # Classes have numbers of their own: rows that share an id may be of several classes.
    classes = written(grouped.filter("home is not null").withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = _buckets(classes)
    meeting = buckets.select("rep").distinct().join(classes.select("rep", "home", "s1", "s2"), "rep")
    schema = "rep long, n long, shingles binary, a array<long>, b array<long>, heads binary, bits binary"

    def full(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = shingle_sets(batch.column("text"), size)
        got = zip(_sums(sets, 3), _sums(sets, 4), batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)
        own = [i for i, (s1, s2, t1, t2) in enumerate(got) if s1 == t1 and s2 == t2]
        sets, reps = [sets[i] for i in own], batch.column("rep").to_pylist()
        a, b = subkeys(sets)
        heads = (np.concatenate([a, b], axis=1) >> 32).astype(np.int32)
        yield {"rep": [reps[i] for i in own], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets], "a": list(a), "b": list(b), "heads": [h.tobytes() for h in heads], "bits": [x.tobytes() for x in one_bits(sets)]}

    found = rows.join(meeting, F.col("doc_id") == F.col("home")).select("rep", "s1", "s2", "text")
    sets = written(mapped(found, full, schema), "sets")
    near = _neighbour_links(sets, 0, percent)
    for round_ in range(1, ROUNDS):
        near = near.unionByName(_neighbour_links(sets, round_, percent))
    first = components(near)
    far = written(_far_links(buckets, first, sets, percent), "links")
    # Stars of the first components stand for all their links.
    joined = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(far))
    placed = classes.join(joined, F.col("rep") == F.col("node"), "left").select(*same, "home", F.coalesce("component", "rep").alias("group"))
    least = placed.groupBy("group").agg(F.min("home").alias("component"))
    named = placed.join(least, "group").select(*same, "component")
    whole = sketch.join(named, same, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    out = whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _subkeyed(classes: DataFrame) -> DataFrame:
    """The classes that may share a table key, with shared: a bit for each of their subkeys that another class has, too."""
    dealt = classes.repartition(tasks(classes, classes.count(), KEYED_CLASSES), "rep")
    single = dealt.select("rep", F.posexplode(F.concat("a", "b")).alias("s", "subkey")).select("rep", "s", F.xxhash64("s", "subkey").alias("h"))
    often = single.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    found = single.join(often, "h", "left_semi").groupBy("rep").agg(F.expr("bit_or(shiftleft(1, s))").alias("shared"))
    # A table needs a subkey of either collection.
    both = F.col("shared").bitwiseAND(F.lit((1 << SIDE) - 1)) > 0, F.shiftright("shared", SIDE) > 0
    return classes.select("rep", "n", "a", "b").join(found.filter(both[0] & both[1]), "rep")


def _keys(subkeyed: DataFrame) -> DataFrame:
    """rep, n, t, key: for each class the keys of the tables whose two subkeys are shared."""

    def shared(name: str, first: int) -> Column:
        numbered = F.transform(name, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        return F.filter(numbered, lambda e: F.expr(f"shiftright(shared, {first})").bitwiseAND(F.call_function("shiftleft", F.lit(1), e["i"])) != 0)

    of = lambda p, q: F.struct((p["i"] * SIDE + q["i"]).alias("t"), F.xxhash64(p["i"], q["i"], p["x"], q["x"]).alias("key"))
    dealt = subkeyed.repartition(tasks(subkeyed, subkeyed.count(), KEYED_CLASSES), "rep")
    halves = dealt.select("rep", "n", shared("a", 0).alias("a"), shared("b", SIDE).alias("b"))
    return halves.select("rep", "n", F.inline(F.flatten(F.transform("a", lambda p: F.transform("b", lambda q: of(p, q))))))


def _buckets(classes: DataFrame) -> DataFrame:
    """rep, n, t, key: each class in the tables where it meets another.

    Classes that meet in table (i, j) agree in subkey i of the first collection and j of the second. So subkeys that only one class
    has go first, by SIDE + SIDE rows of a class, and what is left of the SIDE * SIDE keys is counted and joined.
    """
    keys = _keys(written(_subkeyed(classes), "subkeyed"))
    often = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    return written(keys.join(often, "key", "left_semi").select("rep", "n", "t", "key"), "buckets")


def _far_links(buckets: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links between members of one bucket that lie in different components.

    Members of a bucket are packed into blocks, which a task compares whole with each other. What
    moves between tasks are blocks, and the sets of classes that a block's comparison names.
    """
    placed = buckets.join(first, F.col("rep") == F.col("node"), "left").select("key", "t", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    # A class lies in SIDE * SIDE tables at most; it meets its sketch once, not once for each of them.
    tables = placed.join(mixed, "key", "left_semi").groupBy("rep").agg(F.first("c").alias("c"), F.collect_list(F.struct("t", "key")).alias("tables"))
    marked = written(sets.select("rep", "n", "heads", "bits").join(tables, "rep"), "marked")
    order = ["key", "c", "n", "rep"]
    listed = marked.select("rep", "n", "c", "heads", "bits", F.inline("tables")).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(_packed(listed), "blocks")
    right = blocks.select([F.col(c).alias(f"{c}_2") for c in blocks.columns])
    after = (F.col("part_2") > F.col("part")) | ((F.col("part_2") == F.col("part")) & (F.col("num_2") > F.col("num")))
    apart = (F.col("low") != F.col("low_2")) | (F.col("high") != F.col("high_2")) | (F.col("low") != F.col("high"))
    alike = (F.col("most") * 100 >= F.col("least_2") * percent) & (F.col("most_2") * 100 >= F.col("least") * percent)
    met = blocks.join(right, (F.col("key") == F.col("key_2")) & after & apart & alike).drop("key_2")
    alone = blocks.filter("low < high")
    near = _alike(alone, percent).unionByName(_alike(met, percent))
    held = near.join(sets.select(F.col("rep").alias("r"), "shingles"), F.col("rep") == F.col("r")).select("block", "rep", "partners", "shingles")
    fields = arrow_schema(sets.sparkSession, "u long, v long")

    def verify(rows: pa.Table) -> pa.Table:
        own = dict(zip(rows.column("rep").to_pylist(), (np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()), strict=True))
        group = {r: r for r in own}

        def head(r: int) -> int:
            while group[r] != r:
                group[r] = r = group[group[r]]
            return r

        out: list[tuple[int, int]] = []
        for u, partners in sorted(zip(rows.column("rep").to_pylist(), rows.column("partners").to_pylist(), strict=True)):
            for v in partners:
                # Links already found may have joined the two.
                if v not in own or head(u) == head(v):
                    continue
                s, t = own[u], own[v]
                inter = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * inter >= percent * (len(s) + len(t) - inter):
                    group[head(u)] = head(v)
                    out.append((max(u, v), min(u, v)))
        return pa.Table.from_batches([record_batch({"u": [p[0] for p in out], "v": [p[1] for p in out]}, fields)])

    return held.groupBy("block").applyInArrow(verify, "u long, v long")


_PACKED = "key long, t int, part int, num int, low long, high long, least long, most long, reps binary, cs binary, ns binary, heads binary, bits binary"


def _packed(listed: DataFrame) -> DataFrame:
    """Members of each bucket in blocks of at most FAR_DOCS and, unless it is one, FAR_SHINGLES shingles; rows in order of key."""
    fields = arrow_schema(listed.sparkSession, _PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, num, held, size = TaskContext.get().partitionId(), 0, [], 0
        key = None

        def block() -> dict:
            reps, cs, ns = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
            return {
                **dict(zip(("key", "t", "part", "num"), (key, held[0][0], part, num), strict=True)),
                **{"low": int(cs.min()), "high": int(cs.max()), "least": int(ns.min()), "most": int(ns.max())},
                **{"reps": reps.tobytes(), "cs": cs.tobytes(), "ns": ns.tobytes()},
                **{"heads": b"".join(h[4] for h in held), "bits": b"".join(h[5] for h in held)},
            }

        for batch in batches:
            out: list[dict] = []
            for k, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "t", "rep", "c", "n", "heads", "bits")], strict=True):
                if held and (k != key or len(held) == FAR_DOCS or size + row[3] > FAR_SHINGLES):
                    out.append(block())
                    num, held, size = num + 1, [], 0
                key = k
                held.append(row)
                size += row[3]
            if out:
                yield record_batch({f.name: [o[f.name] for o in out] for f in fields}, fields)
        if held:
            last = block()
            yield record_batch({f.name: [last[f.name]] for f in fields}, fields)

    return listed.mapInArrow(pack, _PACKED)


def _alike(blocks: DataFrame, percent: int) -> DataFrame:
    """block, rep, partners: members of a block, or of two, that may be linked to members of another component.

    A pair is named in one table only, the first in which its subkeys agree.
    """
    schema = "block string, rep long, partners array<long>"
    fields = arrow_schema(blocks.sparkSession, schema)
    two = "key_2" in blocks.columns or "reps_2" in blocks.columns

    def side(row: dict, end: str) -> tuple[np.ndarray, ...]:
        reps, cs, ns = (np.frombuffer(row[c + end], np.int64) for c in ("reps", "cs", "ns"))
        return reps, cs, ns, np.frombuffer(row["heads" + end], np.uint32).reshape(-1, 2 * SIDE), np.frombuffer(row["bits" + end], np.uint64).reshape(-1, BITS // 64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                left = side(row, "")
                right = side(row, "_2") if two else left
                partners = _partners(left, right, row["t"], percent)
                if partners:
                    name = f"{row['key']} {row['part']} {row['num']}" + (f" {row['part_2']} {row['num_2']}" if two else "")
                    yield record_batch({"block": [name] * len(partners), "rep": list(partners), "partners": list(partners.values())}, fields)

    return blocks.mapInArrow(compare, schema)


def _partners(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], t: int, percent: int) -> dict[int, list[int]]:
    """For the members that may be linked across components: on the left their partners, on the right none."""
    reps, cs, ns, heads, bits = left
    reps2, cs2, ns2, heads2, bits2 = right
    signs = [2 * np.unpackbits(b.view(np.uint8), axis=1).astype(np.float32) - 1 for b in (bits, bits2)]
    # The product of signs is the places that agree, less those that differ.
    near = signs[0] @ signs[1].T >= BITS - 2 * most_bits(percent)
    near &= (cs[:, None] != cs2) & (np.minimum(ns[:, None], ns2) * 100 >= np.maximum(ns[:, None], ns2) * percent)
    if left is right:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    out: dict[int, list[int]] = {}
    for a in range(0, len(i), 1 << 16):
        u, v = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        same = heads[u] == heads2[v]
        here = same[:, t // SIDE] & same[:, SIDE + t % SIDE]
        here &= (same[:, :SIDE].argmax(1) == t // SIDE) & (same[:, SIDE:].argmax(1) == t % SIDE)
        for x, y in zip(reps[u[here]].tolist(), reps2[v[here]].tolist(), strict=True):
            out.setdefault(x, []).append(y)
            out.setdefault(y, [])
    return out
