"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm import chat, decontamination, language_id, main_text, near_dup, packing, quality, rans, secret_scan, token_file, warc
from siftwell.llm.oracles import ORACLES
from siftwell.llm.queries import QUERIES
from siftwell.llm.token_ids import Encoder
from siftwell.llm.word_arrays import buffer_of, words
from siftwell.session import new_folder
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "\n", "a", "x y", "Don't stop", "É\nà", "a\x1cb 　c", "the of and " * 4000, "<|endoftext|> <|im_end|>", "#*$%&|<>"]


@pytest.fixture
def docs(spark):
    """Odd texts with repeated rows, a null id, and columns whose names clash with those of operators."""
    rows = [(k, t, "en", "s", 1, "z", 7) for k, t in enumerate(ODD)] + [(4, "a", "en", "s", 1, "z", 7), (None, "lost words here and there", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, piece int")


@pytest.fixture
def none(docs):
    return docs.filter("false")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "", str(x)) for x in r))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- words, tokens, range coder, token file


def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in ODD] + ["Abc abC\tabc", "ü" * 40 + " x"]
    data, offsets = buffer_of(pa.array(ODD + texts[len(ODD) :]))
    hashes, starts, ends, owner = words(data, offsets, most=64)
    got = [(int(o), data[a:b].tobytes().decode(errors="replace")) for o, a, b in zip(owner, starts, ends, strict=True)]
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    assert got == want
    folded = {}
    for h, (_, w) in zip(hashes.tolist(), want, strict=True):
        key = "".join(c.lower() if c.isascii() else c for c in w)
        assert folded.setdefault(key, h) == h
    assert len(set(folded.values())) == len(folded)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_memo_gives_the_library_s_ids(path, corpus):
    rng = random.Random(5)
    parts = ["a", "B", "é", "É", "ß", " ", "  ", "\n", "\n\n", ".", ",", "!", "1", "23", "'s", "\t", "²", "-", "×", "İ"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [r.text for r in corpus.limit(60).collect()]
    encoder = Encoder(path)
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:], strict=False)] == encoder.whole(texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_get_the_ids_of_an_untouched_library(path):
    texts = ["see <|endoftext|> here", "<|startoftext|>a b<|endoftext|>", "plain words", None, "<|ENDOFTEXT|>", "é <|endoftext|>", "<|endoftext|"]
    library = Tokenizer.from_file(path)
    ids, at = Encoder(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [1, 31, 33, rans.BLOCK_IDS - 1, rans.BLOCK_IDS, 3 * rans.BLOCK_IDS + 5])
def test_range_coder_round_trip_and_damage(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=50_257)))
    blocks = coder.encode(ids)
    assert np.array_equal(np.concatenate(coder.decode(blocks)), ids)
    assert np.array_equal(coder.decode(blocks[-1:])[0], ids[-(n % rans.BLOCK_IDS or rans.BLOCK_IDS) :])
    bent = bytearray(blocks[0])
    bent[len(bent) // 2] ^= 4
    with pytest.raises(ValueError):
        coder.decode([bytes(bent)])


def test_scaled_frequencies_fill_the_table_and_keep_rare_ids():
    counts = np.array([10**12, 1, 0, 3])
    freq = rans.scaled(counts)
    assert freq.sum() == 1 << rans.SCALE_BITS and (freq[counts > 0] > 0).all() and freq[2] == 0


def test_crc_of_joined_parts():
    a, b = b"12345" * 9, b"xyz" * 77
    assert token_file._crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_file_returns_all_ids_in_order(spark, docs):
    tokens = token_file.token_ids(docs, BYTES, 2)
    path = new_folder(spark, "t")
    token_file.write_tokens(tokens, path, part_ids=9000)
    got = rows_of(token_file.read_index(spark, path))
    texts = sorted([*enumerate(ODD), (4, "a"), (-1, "lost words here and there")], key=lambda r: r[0])
    want, start = [], 0
    for (k, _), raw in zip(texts, Encoder(BYTES).whole([t or "" for _, t in texts]), strict=True):
        raw += (2).to_bytes(4, "little")
        want.append((None if k < 0 else k, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert sorted(got, key=lambda r: r[1]) == want
    pieces = token_file.read_pieces(spark, path, with_ids=True).orderBy("part", "offset").collect()
    assert sum(len(p.ids) // 4 for p in pieces) == start


def test_token_file_of_nothing(spark, none):
    path = new_folder(spark, "t")
    token_file.write_tokens(token_file.token_ids(none, BYTES, 2), path)
    assert token_file.read_index(spark, path).count() == 0


# --- archive


def test_archive_round_trip(spark):
    pages = [(1, "u1", "A"), (2, "u2", "A"), (3, None, "B"), (4, "u4", None), (5, "u5", ""), (2, "u2", "A"), (None, "u", "A"), (7, "ü x", "É\n")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, sha256 string")
    path = new_folder(spark, "w")
    warc.write_archive(df, path)
    got = rows_of(warc.read_headers(spark, path))
    want = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        top = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None))
        want.append([page_id, len(raw), warc.base32_sha1(raw), "revisit", top])
    for payload in {w[2] for w in want}:
        first = next(w for w in want if w[2] == payload and w[0] == w[4])
        first[3:] = ["response", None]
    key = lambda r: (r[0] is not None, r[0] or 0, r[3], r[4] or 0)
    assert sorted(got, key=key) == sorted(map(tuple, want), key=key)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    full = {(r.page_id, r.record): bytes(r.bytes) for r in warc.records(spark, path, with_revisits=True).collect()}
    assert len(full) == len(pages) and all(b.endswith((html or "").encode() + b"\r\n\r\n") for (i, n), b in full.items() for p, _, html in pages if p == i)
    plain = {(r.page_id, r.record): bytes(r.bytes) for r in warc.records(spark, path).collect()}
    assert plain[1, 1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_archive_min_revisit_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "A"), (2, "u", "A")], "page_id long, url string, html string")
    path = new_folder(spark, "w")
    warc.write_archive(df, path, min_revisit=2)
    assert {r.record_type for r in warc.read_headers(spark, path).collect()} == {"response"}
    path = new_folder(spark, "w")
    warc.write_archive(df.filter("false"), path)
    assert warc.read_headers(spark, path).count() == 0


# --- packing


def test_packer_takes_the_fullest_bin_that_fits():
    packer, free, closed = packing.Packer(10, 3), {}, set()
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 10)
        fits = [f for b, f in free.items() if f >= n]
        bin_, offset = packer.put(n)
        assert bin_ not in closed
        if fits:
            assert 10 - offset == min(fits)
        else:
            assert offset == 0
            if len(free) == 3:
                fullest = min(free.values())
                gone = next(b for b in free if free[b] == fullest and b not in {x[0] for x in packer.left_open()} | {bin_})
                closed.add(gone)
                del free[gone]
        free[bin_] = 10 - offset - n
        if not free[bin_]:
            del free[bin_]
            closed.add(bin_)


def test_packing_places_every_token_once(docs):
    got = packing.pack_documents(docs, WORDS, 64, 1, open_bins=4).collect()
    bins = {}
    for r in got:
        assert 0 < r.length <= 64
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    whole = Encoder(WORDS).whole([t or "" for t in ODD])
    for k, raw in enumerate(whole):
        raw += (1).to_bytes(4, "little")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == k})
        assert mine == [(i, a, min(64, len(raw) // 4 - a), zlib.crc32(raw[4 * a : 4 * (a + 64)])) for i, a in enumerate(range(0, len(raw) // 4, 64))]
    assert len([r for r in got if r.doc_id == 4]) == 2 and len([r for r in got if r.doc_id is None]) == 1
    total = sum(r.length for r in got)
    assert len(bins) <= total / 64 * 1.1 + 2


def test_packing_of_nothing(none):
    assert packing.pack_documents(none, WORDS, 64, 1).count() == 0


# --- pages


def test_lines_leave_out_frames_and_comments():
    page = (
        "<!DOCTYPE html><html class='search'><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header>Site</header><nav><ul><li>Home</ul></nav><!-- x <p>no</p> --><div class='ad top'>Buy</div><article><header><h1>Head</h1></header>"
        "<p><b>One &amp;amp; two.<br><p>Three\n  four<form>Name <input></form><div id=comments><p>Hi</div><ul><li>a<li>b</ul></article><footer>&copy; x"
    )
    lines, inside = main_text.lines_of(page)
    assert [x for x, m in zip(lines, inside, strict=True) if m] == ["Head", "One &amp; two.", "Three four", "a", "b"]
    assert [x for x, m in zip(lines, inside, strict=True) if not m] == []


def test_shared_lines_are_a_longest_common_subsequence():
    def longest(a, b):
        return max((n for n in range(len(a), -1, -1) if any(is_in(c, b) for c in itertools.combinations(a, n))), default=0)

    def is_in(c, b):
        it = iter(b)
        return all(x in it for x in c)

    rng = random.Random(2)
    for _ in range(150):
        a, b = (rng.choices("abcd", k=rng.randint(0, 7)) for _ in range(2))
        got = [x for x, s in zip(a, main_text.shared_lines(a, b), strict=True) if s]
        assert len(got) == longest(a, b) and is_in(got, b)


def test_differencing_deletes_the_site_s_frame(spark):
    def page(*own):
        return "<body><div>Welcome to the site</div>" + "".join(f"<div>{x}</div>" for x in own) + "<div>All rights kept</div>"

    pages = [
        (1, "http://h/a/1", page("one one one one one one one one one one one one one")),
        (2, "http://h/a/2", page("two two two two two two two two two two two two two two")),
        (3, "http://other/a", page("alone")),
        (4, None, None),
        (5, "http://[bad", "<article><p>kept</article>"),
        (1, "http://h/a/1", page("one one one one one one one one one one one one one")),
    ]
    got = main_text.extract(spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, part int")).collect()
    texts = {r.page_id: r.text for r in got if r.page_id != 1}
    assert texts == {2: "two " * 13 + "two", 3: "Welcome to the site\nalone\nAll rights kept", 4: "", 5: "kept"}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lines_beside_an_article_are_differenced_and_wrapped_articles_found(spark):
    def page(own, note, passage):
        return f"<div>Site name</div><div>{own}</div><article><p>{passage}<p>{note}</article><div>All rights kept</div>"

    pages = [
        (1, "http://h/a/1", page("first intro", "first text", "a passage of both")),
        (2, "http://h/a/2", page("second intro", "second text", "a passage of both")),
        (3, "http://alone/a", page("intro", "text", "passage")),
        (4, "http://w/1", "<div class='layout has-sidebar'><div class=sidebar>Links</div><article><p>Wrapped</article></div>"),
        (5, "http://w/2", "<form id=all><main><p>In a form</main></form>"),
        (6, "http://w/3", "<article><p>Own</article><div id='login-box'><article>Teaser</article></div><div class=comments><article>Reply</article></div>"),
    ]
    got = main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {
        1: "first intro\na passage of both\nfirst text",
        2: "second intro\na passage of both\nsecond text",
        3: "passage\ntext",
        4: "Wrapped",
        5: "In a form",
        6: "Own",
    }


def test_names_of_parts_of_an_article_don_t_hide_it():
    page = (
        '<body class="search"><div class="page-nav">Menu</div><article class="post has-sidebar"><div class="social-policy">One</div><p class="share-story">Two</p>'
        '<section class="related-work">Three</section><p class="notice">Four</p><math><mi>x</mi></math><label>Five</label><svg><text>Six</text></svg>'
        '<div class="ad">Buy</div><ul id="comments"><li>Hi</ul><article class="comment">Reply</article></article></body>'
    )
    lines, inside = main_text.lines_of(page)
    assert lines == ["One", "Two", "Three", "Four", "x", "Five", "Six"] and all(inside)
    assert main_text.lines_of('<main class="login-help"><p>How to log in</main>') == (["How to log in"], [True])


def test_shared_lines_are_judged_one_by_one(spark):
    menu = "a long line of a menu that both pages have and that is much longer than all else " * 3
    two = [(1, "http://h/1", f"<div>{menu}</div><div>mine</div>"), (2, "http://h/2", f"<div>{menu}</div><div>yours</div>")]
    copies = [(3, "http://c/1", "<div>frame</div><div>the copied article</div><div>x</div>"), (4, "http://c/2", "<div>frame</div><div>the copied article</div><div>y</div>")]
    others = [(5, "http://c/9/3", "<div>frame</div><div>other</div>"), (6, "http://c/9/4", "<div>frame</div>")]
    twins = [(7, "http://t/1", "<div>same</div>"), (8, "http://t/2", "<div>same</div>")]
    got = main_text.extract(spark.createDataFrame(two + copies + others + twins, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {
        1: "mine", 2: "yours", 3: "the copied article\nx", 4: "the copied article\ny", 5: "other", 6: "frame", 7: "same", 8: "same",
    }


def test_long_pages_are_aligned_and_read_in_time_and_memory():
    import time
    import tracemalloc

    rng = random.Random(3)
    a, b = ([str(rng.randrange(20_000)) for _ in range(30_000)] for _ in range(2))
    tracemalloc.start()
    begin = time.process_time()
    shared = main_text.shared_lines(a, b)
    assert time.process_time() - begin < 60 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    it = iter(b)
    assert all(x in it for x, s in zip(a, shared, strict=True) if s) and sum(shared) > 300
    begin = time.process_time()
    for page in ("<p x=\"" * 200_000, "<p x='a>" * 200_000, "<p \"" * 200_000, "<p" * 200_000, "<!" * 200_000, "<p><b>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000):
        main_text.lines_of(page)
    assert time.process_time() - begin < 60


def test_pages_of_the_tables_give_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html

    for r in QUERIES["op4_page_differencing"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# --- near duplicates


def brute_components(texts, size, percent):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {k: k for k in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {k: (len(sets[k]), top(k)) for k in texts}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = {}
    for family in range(12):
        base = [word() for _ in range(rng.choice([30, 120]))]
        for _ in range(25):  # a chain that drifts
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
            texts[len(texts)] = " ".join(base)
    for t in ODD + ["A", "X Y", "x  y"]:
        texts[len(texts)] = t
    df = spark.createDataFrame([(k, t, 5) for k, t in texts.items()] + [(3, texts[3], 5), (None, "gone astray", 5)], "doc_id long, text string, n int")
    got = near_dup.deduplicate(df, 4, 80).collect()
    want = brute_components(texts, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == df.count() and all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_the_tables(spark, corpus):
    texts = {r.doc_id: r.text for r in corpus.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_tensored_minhash"](spark, SF).collect()}
    assert got == brute_components(texts, 4, 80)


def test_near_duplicates_of_nothing(none):
    assert near_dup.deduplicate(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(101, 100)], "u long, v long")
    got = {r.node: r.component for r in near_dup.components(links).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


# --- chat


def test_chat_reads_back_what_was_said(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<~|x<~~|<|", "", None, "line\nline", "<|im_sep|>", "a<|im_nl|>b", "é"]
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "<|im_start|>"]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 9))]
    turns += [(1, 0, "user", "tie"), (None, None, "assistant", "lost")]
    df = spark.createDataFrame([(*t, "x", False) for t in turns], "conv_id long, turn long, role string, text string, segments string, loss boolean")
    rows = chat.formatted(df).select("conv_id", chat.text_of(F.col("segments")).alias("s"), chat.learned_of(F.col("segments")).alias("l"), "segments").withColumn("t", chat.turns_of(F.col("s"))).collect()
    assert len(rows) == 41
    for r in rows:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id), key=lambda t: (t[0], t[1], t[2].replace("<|", "<~|").replace("\n", "<|im_nl|>"), re.sub(r"<(~*)\|", r"<~\1|", t[3])))
        assert [(t.role, t.text) for t in r.t] == [(t[2], t[3]) for t in mine]
        assert r.l == "".join(t[3] for t in mine if t[2] == "assistant")
        assert r.s == "".join(x.text for x in r.segments)
        assert r.s.count(chat.START) == len([k for k in range(len(mine)) if k == 0 or mine[k][2] != mine[k - 1][2]])
    assert chat.formatted(df.filter("false")).count() == 0


def test_native_operators_run_no_python(spark):
    for name in ("op6_chat_formatting", "op9_quality_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), plan


# --- quality


def test_quality_counts_match_brute_force(spark, docs, corpus):
    texts = [*ODD, "a b c a b c a b c x", "x y z x y z", "l\nl\n\nl m\n \nl", "- a\n- b\n• c", "w " * 60]
    texts += [r.text for r in corpus.collect()]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, measures string")
    for r in quality.judged(df).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        m = r.measures
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judged(docs).count() == docs.count() and quality.judged(docs.filter("false")).count() == 0


def test_rules_table_is_what_decides(spark):
    df = spark.createDataFrame([(1, "word " + " ".join(f"w{k}" for k in range(80)))], "doc_id long, text string")
    assert not quality.judged(df).first().kept  # no stop words
    assert quality.judged(df, rules=()).first().kept


# --- decontamination


def test_edit_search_matches_the_full_table():
    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(200):
        p, t = ("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(2))
        d, a, b = decontamination.edit_search(p, t, 99)
        assert d == least(p, t)
        assert a <= b <= len(t)


def test_whole_edited_and_absent_items(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(6)
    rows, want = [], set()
    filler = lambda n: " ".join("".join(rng.choices("xyzw", k=5)) for _ in range(n))
    for k, (item, text) in enumerate(items):
        w = "".join(c.upper() if c.isascii() else c for c in text).split(" ") if k % 3 == 0 else text.split(" ")
        if k % 3 == 1:
            w[len(w) // 2] = "changed"
        rows.append((k, filler(40) + "\n" + " ".join(w) + "\t" + filler(30), "q", 1))
        want.add((k, item))
    rows += [(1000 + k, filler(200), "q", 1) for k in range(30)]
    short = [(500, "tiny item here"), (501, None), (502, " ")]
    rows.append((2000, "see the Tiny  item here now. tiny item here", "q", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, start int")
    bench = spark.createDataFrame([(*x, 0) for x in items + short], "item_id long, text string, doc_id int")
    for block in (10_000_000, 2_000):
        got = decontamination.find(df, bench, block_chars=block).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        assert len(want & pairs) >= 0.98 * len(want) and pairs - want == {(2000, 500)}
    texts = dict((r[0], r[1]) for r in rows)
    assert all(r.distance > 0 or decontamination.plain(texts[r.doc_id][r.start : r.end]) == decontamination.plain(dict(items + short)[r.item_id]) for r in got)
    assert decontamination.find(docs, bench).count() == 0
    assert decontamination.find(df, bench.filter("false")).count() == 0 and decontamination.find(docs.filter("false"), bench).count() == 0


def test_items_cut_at_both_ends_are_found_whatever_rows_lie_beside_them():
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(20)]
    texts = [x for _, t in items for x in (" ".join(t.split()[2:-2]), " ".join(word() for _ in range(30)))]
    texts = [" ".join(word() for _ in range(30)), *texts]
    index = decontamination.Index(items)
    together = {(texts[g[0]], g[1]) for g in decontamination.hits_of(index, pa.array(texts))}
    alone = {(t, g[1]) for t in texts for g in decontamination.hits_of(index, pa.array([t]))}
    assert together == alone == {(texts[2 * k + 1], k) for k in range(20)}


@pytest.mark.parametrize("n, least", [(8, 0.94), (15, 0.94), (58, 0.99)])
def test_items_edited_in_characters_are_found(n, least):
    rng = random.Random(14)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 7))) for _ in range(n))
    items = [(k, text(n)) for k in range(100)]
    index = decontamination.Index(items)
    for share in (0, 0.1, 0.2):
        docs = []
        for _, t in items:
            c = list(t)
            for p in rng.sample(range(len(c)), int(share * len(c))):
                c[p] = rng.choice(["", "x", c[p] + "x"])
            docs.append(f"{text(30)} {''.join(c)} {text(30)}")
        got = {(g[0], g[1]) for g in decontamination.hits_of(index, pa.array(docs))}
        assert sum((k, k) in got for k in range(100)) >= 100 * least


def test_planted_items_of_the_tables_are_found(spark, corpus):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in corpus.collect() for i in items if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_cgk_decontamination"](spark, SF).collect()}
    assert want <= got and want


# --- language


def test_gradients_match_differences():
    net = language_id.Network.new(["a", "b", "c"], 4, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = np.random.default_rng(0).integers(0, 256, (6, 5)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(x, y)
    for k, w in net.weights.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), w.shape)
        w[i] += 1e-4
        up = net.gradients(x, y)[0]
        w[i] -= 2e-4
        down = net.gradients(x, y)[0]
        w[i] += 1e-4
        assert abs(g[k][i] - (up - down) / 2e-4) < 1e-5
    states = net._direction("b", x)[0]
    net.weights = {k: v.astype(np.float32) for k, v in net.weights.items()}
    assert np.abs(states - net._states("b", x)).max() < 1e-5


def test_held_out_languages_and_odd_rows(spark, docs):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(train, F.col("doc_id") % 3 != 1)
    held = language_id.predict(train.filter("doc_id % 3 = 1"), net).join(train.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    got = language_id.predict(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {k for k, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")}
    assert language_id.predict(docs.filter("false"), net).count() == 0
    unlabelled = language_id.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language_id.predict(docs, unlabelled).collect()} == {"und"}


def test_one_learned_language_is_predicted_and_passes_the_stage(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert got == {k: ("en", 1.0) if any(c.isalpha() for c in t or "") else ("und", 0.0) for k, t in enumerate(ODD)} | {None: ("en", 1.0)}
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([k for k, (lang, _) in got.items() if lang == "en"] + [4], key=str)


# --- secrets


def test_base_kinds_follow_their_patterns(spark, docs):
    hexed, key = "0123456789abcdef" * 2, "AKIA" + "B" * 12
    texts = [f'é token = "{hexed}x" {key}', "API-key: nothing", "apikey:short", "Password'  :  'longenough1/=", f"{key[:-1]} {hexed[:-1]}", "ſecret=abcdefghij", *[t or "" for t in ODD]]
    for text in texts:
        got = [(s, k, e) for s, k, e, _ in secret_scan.find(text) if k != "novel"]
        want = [(m.start(), "assign", m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert got == sorted(want, key=lambda s: (s[0], secret_scan.KINDS.index(s[1])))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in secret_scan.scan(df).collect():
        assert [(s.start, s.kind, s.end, s.secret_start) for s in r.spans] == secret_scan.find(texts[r.doc_id])
        assert (r.clean is None) == (not r.spans) and (r.clean is None or hexed not in r.clean)
    assert secret_scan.scan(docs).count() == docs.count() and secret_scan.scan(docs.filter("false")).count() == 0


def test_novelty_tells_random_keys_from_known_text():
    random_key = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MGFiY2Rl9xZq"
    assert [s[1] for s in secret_scan.find(f"my secret key is {random_key} here")] == ["novel"]
    assert secret_scan.find("my secret key is get_access_token_client_secret_1 here") == []
    text = f"{random_key} is deployed. The private key is {random_key} now"
    spans = secret_scan.find(text)
    assert [s[:3] for s in spans] == [(text.rindex(random_key), "novel", text.rindex(random_key) + len(random_key))]
    assert random_key not in secret_scan.redacted(text, spans)
    assert secret_scan.find(f"plain words {random_key} here") == []


def test_a_secret_written_twice_is_reported_twice():
    rng = random.Random(12)
    for _ in range(50):
        k = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=39)) + "7"
        for text in (
            f"The private signing key is {k} and deploys use it. Paste the key {k} into the console.",
            f"the key {k}= or the key {k}",
            "key " + f"{k}\n" * 3,
            f"key {k}" + " " * 230 + f"key {k}",
        ):
            spans = secret_scan.find(text)
            assert [s[:3] for s in spans] == [(m.start(), "novel", m.end()) for m in re.finditer(k + "=?", text)], text
            assert k not in secret_scan.redacted(text, spans)
    assert secret_scan.find("key get_access_token_client_secret_1 key get_access_token_client_secret_1") == []


# --- queries and pipeline


def test_queries_match_their_sql(spark):
    con = connect(SF)
    for name, sql in ORACLES.items():
        difference, rows, _ = compare(spark, con, QUERIES[name], sql, SF)
        assert difference is None and rows > 0, name


def test_pipeline_matches_its_stages_by_brute_force(spark, corpus):
    got = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in corpus.collect()}
    known = {k: t for k, t in texts.items() if any(c.isalpha() for c in t or "")}
    found = brute_components(known, 5, 80)
    unique = {k: t for k, t in known.items() if found[k][1] == k}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {k: t for k, t in unique.items() if not any(i in t for i in items)}
    final = {k: secret_scan.redacted(t, secret_scan.find(t)) for k, t in clean.items()}
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append((r.piece, r.length, r.ids_crc32))
    assert set(whole) == set(final)
    for (k, text), raw in zip(final.items(), Encoder(WORDS).whole(list(final.values())), strict=True):
        raw += (1).to_bytes(4, "little")
        assert sorted(whole[k]) == [(i, len(raw[a : a + 16384]) // 4, zlib.crc32(raw[a : a + 16384])) for i, a in enumerate(range(0, len(raw), 16384))]


def test_stages_take_odd_rows_and_none(spark, docs):
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        if stage is not corpus_pipeline.packed:
            assert out.columns == corpus_pipeline.COLUMNS
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {*range(len(ODD)), None}
        assert stage(spark, docs.filter("false"), SF).count() == 0, name


def test_stages_decide_rows_whatever_their_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    make = lambda rows: spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    # Equal rows, near copies without ids, a clean text and a copy under one id, a copy without an id.
    rows = [(1, a), (1, a), (None, b), (None, b + " end"), (2, c), (3, a), (3, d), (None, c)]
    got = texts(corpus_pipeline.near_duplicates(spark, make(rows), SF))
    assert len(got) == 4 and {x for x in got if x[0]} == {(1, a), (2, c), (3, d)}
    assert [x for x in got if x[0] is None][0][1] in (b, b + " end")

    rows = [(None, f"{a} {item} {b}"), (None, c), (1, item), (1, d), (2, c), (2, c)]
    assert texts(corpus_pipeline.decontaminated(spark, make(rows), SF)) == sorted([(None, c), (1, d), (2, c), (2, c)], key=str)


def test_sha_of_turns(spark):
    got = {r.conv_id: r for r in QUERIES["op6_chat_formatting"](spark, SF).collect()}
    odd = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and got[-1].loss_chars == len(odd)


def test_links_along_a_long_chain_of_near_copies(spark):
    """2,000 texts, each near the one before at 0.75 to 0.85: no link is made up, and 99 of 100 are found."""
    rng = random.Random(41)
    new = itertools.count()
    text = [f"w{next(new)}" for _ in range(100)]
    texts = {}
    for k in range(2000):
        texts[k] = " ".join(text)
        for at in rng.sample(range(4, 96), rng.choice([2, 2, 3])):
            text[at] = f"w{next(new)}"
    sets = {k: {tuple(w[i : i + 4]) for i in range(97)} for k, w in ((k, t.split()) for k, t in texts.items())}
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    shared = {}
    for own in holders.values():
        for pair in itertools.combinations(own, 2):
            shared[pair] = shared.get(pair, 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (2 * 97 - n)]
    parent = list(range(2000))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.deduplicate(df, size=4, percent=80).collect()}
    assert len(links) > 1000 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    for a, b in got.items():
        assert top(a) == top(b)


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    rng = random.Random(4)
    one, two = (" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(2))
    rows = [(9, one + " x"), (5, one), (5, two), (3, two + " y")]
    got = near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_languages_are_learned_whatever_ids_repeat(spark):
    rng = random.Random(5)
    own = {"en": ["the", "of", "and", "there", "with"], "de": ["der", "und", "nicht", "eine", "über"]}
    rows = [(k, " ".join(rng.choices(own[lang], k=12)), lang) for k, lang in enumerate(own) for _ in range(400)]
    rows += [(0, "the same words again and again", "en")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(df, F.lit(True), sample_rows=100)
    assert sorted(net.languages) == ["de", "en"]


def test_a_cut_document_that_lost_ids_is_refused(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, " ".join(str(rng.randrange(10**6)) for _ in range(30_000))) for k in range(3)], "doc_id long, text string")
    path = new_folder(spark, "tokens")
    token_file.write_tokens(token_file.token_ids(df, BYTES, 2), path)
    assert token_file.read_index(spark, path).count() == 3
    real = token_file.read_pieces
    monkeypatch.setattr(token_file, "read_pieces", lambda *a: real(*a).filter("doc_id is null or offset > 0 or size = n"))
    with pytest.raises(Exception):
        token_file.read_index(spark, path).collect()


def _classes(spark, rows):
    return spark.createDataFrame([(r, 9, *ab) for r, ab in enumerate(rows)], "rep long, n long, a array<long>, b array<long>")


def test_table_keys_are_listed_for_shared_subkeys_only(spark):
    """Classes without a subkey in common list no key, and two that share one of either collection list that table's."""
    alone = [([100 * r + k for k in range(10)], [100 * r + 50 + k for k in range(10)]) for r in range(40)]
    assert near_dup._keys(near_dup._subkeyed(_classes(spark, alone))).count() == 0
    alone[7][0][2], alone[7][1][5] = alone[3][0][2], alone[3][1][5]
    alone[9][0][4] = alone[3][0][4]  # of one collection only
    listed = near_dup._keys(near_dup._subkeyed(_classes(spark, alone))).collect()
    assert sorted((r.rep, r.t) for r in listed) == [(3, 25), (3, 45), (7, 25)]
    assert sorted((r.rep, r.n, r.t) for r in near_dup._buckets(_classes(spark, alone)).collect()) == [(3, 9, 25), (7, 9, 25)]


def test_buckets_are_all_tables_in_which_two_classes_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "KEYED_CLASSES", 16)
    random = np.random.default_rng(5)
    rows = [(random.integers(0, 25, 10).tolist(), random.integers(0, 25, 10).tolist()) for _ in range(120)]
    members: dict[tuple, list[int]] = {}
    for r, (a, b) in enumerate(rows):
        for t in range(100):
            members.setdefault((t, a[t // 10], b[t % 10]), []).append(r)
    want = sorted((r, key[0]) for key, own in members.items() if len(own) > 1 for r in own)
    got = near_dup._buckets(_classes(spark, rows)).collect()
    assert len(want) > 500 and sorted((r.rep, r.t) for r in got) == want
    # No task lists the keys of many more classes than it is to hold.
    listed = near_dup._keys(near_dup.written(near_dup._subkeyed(_classes(spark, rows)), "subkeyed"))
    sizes = listed.groupBy(F.spark_partition_id()).agg(F.countDistinct("rep").alias("n")).collect()
    assert len(sizes) > 4 and max(r.n for r in sizes) < 40
