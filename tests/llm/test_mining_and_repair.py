"""Phrases, conversation repair and repeated passages against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import bit_filter, collocations, conversation_repair, substring_dedup
from siftwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- the bitmap


def test_bitmap_holds_all_that_was_put_in(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    bits = bit_filter.bitmap(spark.createDataFrame([(int(h),) for h in hashes], "h long"))
    assert bit_filter.holds(bits, hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64)
    assert bit_filter.holds(bits, others).mean() < 0.1
    assert not bit_filter.holds(bit_filter.bitmap(spark.createDataFrame([], "h long")), others).any()


def test_a_full_bitmap_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bit_filter, "MOST_BITS", 1024)
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    assert bit_filter.holds(bit_filter.bitmap(rows), rows.toPandas()["h"].to_numpy().view(np.uint64)).all()


# --- 11, phrases


def brute_collocations(rows, support, top=2000, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= support}
        covered = Counter()
        for p, a in found.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if j - i < len(p):
                    covered[p[i:j]] = max(covered[p[i:j]], a)
        rows_ = []
        for p, a in found.items():
            if len(p) > 1 and not (covered[p] and 100 * covered[p] >= 80 * a):
                score, _, left, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def found_collocations(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(5)
    vocabulary = ["The", "of", "and", "Éa", "x", "ein s", "　", "b\x1c", "new", "york", "city", "times"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 120)))) for _ in range(400)]
    return rows + [("en", None), ("en", ""), ("en", "New York City"), ("en", "a " * 20000)] * 3


@pytest.mark.parametrize("shard", [2000, 30000, 64 << 20])
def test_phrases_are_those_of_brute_force(spark, phrase_rows, shard):
    docs = spark.createDataFrame([(lang, t, 1, 2) for lang, t in phrase_rows], "lang string, text string, phrase int, h int")
    got = collocations.collocations(docs.repartition(7), support=30, shard=shard)
    assert found_collocations(got) == brute_collocations(phrase_rows, 30)


def test_phrases_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert found_collocations(QUERIES["op11_son_collocations"](spark, SF)) == brute_collocations(rows, 30)


def test_top_phrases_break_ties_by_bytes(spark):
    rows = [("en", f"{w} zz.") for w in ("é", "a", "B", "z", "~") for _ in range(30)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), top=3)
    assert found_collocations(got) == brute_collocations(rows, 30, top=3)
    assert [r["phrase"] for r in got.orderBy("rank").collect()] == ["a zz", "b zz", "z zz"]


def test_a_phrase_below_local_support_in_each_shard_is_not_lost():
    """No split of 30 occurrences over shards leaves all of them unreported."""
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.randint(1, 10**6) for _ in range(rng.randint(1, 60))]
        least = [collocations.local_support(s, sum(sizes), 30) for s in sizes]
        assert sum(x - 1 for x in least) < 30


@pytest.mark.parametrize("support", [1, 3])
def test_mining_a_shard_holds_little_beside_it(monkeypatch, support):
    """Bytes for each word, where every phrase is reported and where few are; the counts are those of a whole sort."""
    import tracemalloc

    n = 3_000_000
    shard = collocations.Shard(2 * n)
    shard.hashes[:n] = np.random.default_rng(3).zipf(1.3, n).astype(np.uint64) % np.uint64(1 << 40)
    shard.spoken[:n], shard.linked[:n], shard.n, shard.size, shard.languages = 0, True, n, 1, {"en": 0}
    shard.linked[n - 1] = False
    tracemalloc.start()
    sizes = [(len(h), int(c.sum()), least) for h, c, least in collocations.locally_frequent(shard, 1, support, 4)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36 * n
    pairs = np.unique(collocations.mix(collocations.mix(shard.hashes[:n] + np.uint64(collocations.language_hash("en")))[:-1] * collocations._STEP + shard.hashes[1:n]), return_counts=True)[1]
    words = np.unique(shard.hashes[:n], return_counts=True)[1]
    ends = sum(c[c >= support].sum() for c in (words, pairs))
    if support == 1:
        assert sum(c for _, c, _ in sizes) == 4 * n - 6
    assert sum(c for _, c, _ in sizes) >= ends and {least for *_, least in sizes} == {support}


def test_no_phrases_in_an_empty_table(spark, phrase_rows):
    docs = spark.createDataFrame(phrase_rows, "lang string, text string")
    assert collocations.collocations(docs.filter("false")).collect() == []
    assert collocations.collocations(docs.filter("text is null or text = ''")).collect() == []


# --- 12, conversations


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Best edits by a plain recursion over whole suffixes: cost, audit, repaired rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(len(rows), ""): (0, "", []), (len(rows), "a"): (0, "", []), (len(rows), "u"): (5, "I", ["assistant:"]), (len(rows), "s"): (10, "II", ["user:", "assistant:"])}
    names = {"u": "user", "a": "assistant"}
    for i in range(len(rows) - 1, -1, -1):
        _, role, text = rows[i]
        for state in ("", "s", "u", "a"):
            ways = []
            for inserts in range(3):
                at, extra = state, []
                for _ in range(inserts):
                    at = follow[at][-1]
                    extra.append(f"{names[at]}:")
                moves = [(2, "D", at, [])]
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] == "truncated" else 0
                    if role[:1] and role[:1] in follow[at]:
                        moves.append((more, "K", role[:1], [f"{role}:{text}"]))
                    moves.append((more + 1, "R", follow[at][-1], [f"{names[follow[at][-1]]}:{text}"]))
                for cost, letter, to, line in moves:
                    c, audit, lines = best[i + 1, to]
                    ways.append((5 * inserts + cost + c, "I" * inserts + letter + audit, extra + line + lines))
            best[i, state] = min(ways, key=lambda w: (w[0], w[1].encode()))
    cost, audit, lines = best[0, ""]
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def brute_conversations(rows):
    own = defaultdict(list)
    for conv, *rest in rows:
        own[conv].append(tuple(rest))
    return {conv: brute_repair(r) for conv, r in own.items()}


def as_dict(df):
    found = [r.asDict() for r in df.collect()]
    out = {r.pop("conv_id"): r for r in found}
    assert len(out) == len(found)
    return out


def odd_conversations(rng, n):
    texts = ["Yes.", "No", "", " ", "\n", None, "What?  ", "É!", "Go on.", "a　"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "u"]
    return [(rng.choice([*range(n), None]), rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for _ in range(8 * n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_repairs_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair, "LETTERS", 512)
    rows = odd_conversations(random.Random(block), 60)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, later string")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert as_dict(conversation_repair.repaired(df)) == brute_conversations(plain)
    damaged = brute_damage(rows)
    want = brute_conversations(damaged)
    for conv in {r[0] for r in rows} - set(want):
        want[conv] = brute_repair([])
    assert as_dict(conversation_repair.repaired(conversation_repair.damaged(df), df)) == want


def test_repairs_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_conversations(brute_damage(rows))
    for conv in {r[0] for r in rows} - set(want):
        want[conv] = brute_repair([])
    assert as_dict(QUERIES["op12_path_repair"](spark, SF)) == want


def test_a_long_conversation_spreads_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 50)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two", f"{t}."])) for t in range(3000)]
    rows += [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert as_dict(conversation_repair.repaired(df)) == brute_conversations(rows)


def test_ranks_are_those_of_the_least_audits():
    """Nodes are ranked as their least audits are, which are followed letter by letter here."""
    rng = random.Random(4)
    codes = bytes(rng.choice([0, 1, 2, 3]) | rng.choice([0, 0, 1, 2, 3]) << 2 for _ in range(60))
    arcs = conversation_repair.optimal_arcs(codes, list(conversation_repair.AT_END), 0)
    ahead = defaultdict(dict)
    for a, letter, b in arcs:
        assert letter not in ahead[a]
        ahead[a][letter] = b
    nodes = conversation_repair.STATES * 61

    def audit(node):
        out = []
        while ahead[node]:
            out.append(min(ahead[node]))
            node = ahead[node][out[-1]]
        return bytes(out)

    ranks = conversation_repair.ranked(np.array(arcs), nodes, nodes)
    audits = [audit(n) for n in range(nodes)]
    order = {a: k for k, a in enumerate(sorted(set(audits)))}
    assert ranks.tolist() == [order[a] for a in audits]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired(conversation_repair.damaged(none), none).collect() == []


# --- 13, repeated passages


def brute_removed(texts, length):
    every = [WORD.findall(t or "") for t in texts]
    starts = defaultdict(list)
    for d, w in enumerate(every):
        for i in range(len(w) - length + 1):
            starts[tuple(w[i : i + length])].append((d, i))
    gone = [set() for _ in every]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(every, gone, strict=True)]


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    new = lambda n: [rng.choice("abcdefghijklm") + str(rng.randint(0, 400)) for _ in range(n)]
    shared, twice = new(90), new(34)
    texts = [" ".join(new(rng.randint(0, 120))) for _ in range(60)]
    texts += [" ".join(new(20) + shared[:k] + new(15)) for k in (33, 34, 35, 36, 50, 90)]
    texts += ["\n".join(new(7) + shared[50:] + new(3)), "\t".join(shared), " ".join(shared).upper(), " ".join(twice + ["z"] + twice)]
    texts += [" ".join(twice), "same " * 34, "same " * 40, "a b " * 60, None, "", " ", "x", texts[3], texts[3], "a\x1cb　 c"]
    again = new(60)
    return texts + [" ".join(again + new(9) + again + new(4) + again[5:])]


@pytest.mark.parametrize(("length", "group"), [(35, 200_000), (35, 5), (8, 50), (7, 200_000), (3, 200_000), (1, 50)])
def test_removed_words_are_those_of_brute_force(spark, monkeypatch, passages, length, group):
    monkeypatch.setattr(substring_dedup, "SLICE", 2000)
    real = substring_dedup.groups
    monkeypatch.setattr(substring_dedup, "groups", lambda rows, sizes: real(rows, sizes, group))
    df = spark.createDataFrame([(k, t, 1, "p") for k, t in enumerate(passages)], "doc_id long, text string, row_key int, path string").repartition(5)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, length).collect()}
    want = brute_removed(passages, length)
    assert [(got[k]["n_words"], got[k]["n_removed"], got[k]["kept"]) for k in range(len(passages))] == want
    for k, t in enumerate(passages):
        words = WORD.findall(t or "")
        spans = [tuple(s) for s in got[k]["spans"]]
        assert [w for i, w in enumerate(words) if not any(a <= i < b for a, b in spans)] == got[k]["kept"].split(" " if got[k]["kept"] else None)
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(spans)) and len(spans) == len(set(spans))


def test_groups_cut_at_the_shortest_prefix_that_fits():
    rng = random.Random(2)
    paths = sorted(bytes([rng.choice([0, 0, 0, 1])]) * 8 + bytes([rng.choice([0, 0, 1])]) * 4 + bytes([rng.randint(0, 3)] * 4) for _ in range(300))
    rows = [(p, bytes([k % 256])) for k, p in enumerate(paths)]
    for most in (1, 5, 30, 1000):
        found = list(substring_dedup.groups(iter(rows), [8, 12, 16], most))
        flat = [r for k, g in enumerate(found) for r in (g[1:] if k and g[0] == found[k - 1][-1] else g)]
        assert flat == rows and max(map(len, found)) <= most + 1


def test_removed_words_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (n, g, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, g, kept) in zip(docs, brute_removed([r["text"] for r in docs], 35), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op13_prefix_suffix_trees"](spark, SF).collect()}
    assert got == want


def test_nothing_to_remove(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).collect() == []
    empty = spark.createDataFrame([(None, None), (1, ""), (1, "a b")], "doc_id long, text string")
    found = sorted((r["n_words"], r["n_removed"], r["kept"], len(r["spans"])) for r in substring_dedup.remove_repeats(empty).collect())
    assert found == [(0, 0, "", 0), (0, 0, "", 0), (2, 0, "a b", 0)]


def test_repeats_in_a_very_long_text(spark):
    rng = random.Random(6)
    text = " ".join(str(rng.randint(0, 10**9)) for _ in range(400_000))
    cut = text[1_000_000:1_001_000].split()[1:-1]
    df = spark.createDataFrame([(1, text), (2, " ".join(cut))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: len(cut), 2: len(cut)}
