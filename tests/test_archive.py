import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.operators.items import resolve_ids
from siftwell.sources import archive, json_ranges
from siftwell.sources.archive import decode_posts, import_archive, scan_archive


def wrapped(posts, prefix="window.posts.part0 = "):
    return f"{prefix}{json.dumps(posts, indent=2)}"


def sample(n=50):
    return [{"tweet": {"id_str": f"post_{i}", "full_text": f"Sample text {i}", "user": {"screen_name": "u"}}} for i in range(n)]


def test_reads_doubly_bracketed_file(spark, tmp_path):
    file = tmp_path / "posts.js"
    file.write_text(f"window.posts.part0 = [{json.dumps(sample(), indent=2)}]")
    rows = scan_archive(spark, str(file)).orderBy("pos").collect()
    assert [(r.id_str, r.item_text) for r in rows] == [(f"post_{i}", f"Sample text {i}") for i in range(50)]
    assert [r.pos for r in rows] == list(range(50))


def test_reads_folder_of_parts_and_ignores_other_files(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"posts-{part}.JS").write_text(wrapped(sample(7)))
    (tmp_path / "notes.txt").write_text("[{}]")
    rows = scan_archive(spark, str(tmp_path)).collect()
    assert len(rows) == 21
    assert sorted(r.pos for r in rows) == sorted(list(range(7)) * 3)


def test_ids_keep_their_digits(spark, tmp_path):
    big = 1991055144646050238
    posts = [
        {"tweet": {"id": big, "full_text": "number"}},
        {"tweet": {"id_str": str(big), "id": 1, "full_text": "both"}},
        {"tweet": {"id_str": "", "id": 7}},
        {"tweet": {"id": 0}},
        {"tweet": None},
        {},
    ]
    file = tmp_path / "p.js"
    file.write_text(wrapped(posts))
    rows = resolve_ids(scan_archive(spark, str(file))).orderBy("pos").collect()
    assert [r.item_id for r in rows] == [str(big), str(big), "7", None, None, None]


def test_text_survives(spark, tmp_path):
    text = 'quote " backslash \\ brackets ]} [{ line\nbreak\ttab é 😀  '
    file = tmp_path / "p.js"
    file.write_text(wrapped([{"tweet": {"id_str": "1", "full_text": text}}]), encoding="utf-8")
    assert scan_archive(spark, str(file)).first()["item_text"] == text


@pytest.mark.parametrize(
    "content",
    [
        "window.posts.part0 = [ { invalid json } ]",
        "window.posts.part0 = []",
        "nothing here",
        '[{"tweet": {"id_str": "1"}}]; other = [{"tweet": {"id_str": "2"}}]',
        '[{"tweet": {"id_str": "1"}}, 5, {}]',
    ],
)
def test_rejects_what_is_no_array_of_posts(spark, tmp_path, content):
    file = tmp_path / "bad.js"
    file.write_text(content)
    with pytest.raises(ValueError):
        import_archive(spark, str(file), str(tmp_path / "items"))
    with pytest.raises(Exception):
        scan_archive(spark, str(file)).count()


def test_one_bad_file_among_good_ones_is_not_skipped(spark, tmp_path):
    (tmp_path / "a.js").write_text(wrapped(sample(3)))
    (tmp_path / "b.js").write_text("broken")
    with pytest.raises(ValueError):
        import_archive(spark, str(tmp_path), str(tmp_path / "items"))


def test_missing_and_misnamed_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_archive(spark, str(tmp_path / "absent.js"))
    (tmp_path / "posts.txt").write_text("some text")
    with pytest.raises(ValueError, match=".js"):
        scan_archive(spark, str(tmp_path / "posts.txt"))


def test_oversized_file_is_refused(spark, tmp_path):
    file = tmp_path / "p.js"
    file.write_text(wrapped(sample(50)))
    with pytest.raises(ValueError, match="parts"):
        scan_archive(spark, str(file), max_file_bytes=100)


def decoded(text):
    """Ids and texts of the posts, or None where the plain decoder fails."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        return None
    if not isinstance(data, list) or not all(isinstance(p, dict) for p in data):
        return None
    posts = [p.get("tweet") for p in data]
    posts = [p if isinstance(p, dict) else {} for p in posts]
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return [(as_text(p.get("id_str")), as_text(p.get("full_text"))) for p in posts]


@pytest.mark.parametrize("with_id", [True, False])
def test_damaged_archives_are_judged_as_in_python(spark, with_id):
    rng = random.Random(11)
    texts = []
    for k in range(3000):
        posts = [
            {"tweet": {"id_str": f"{k}{n}", "full_text": f"t {n}", "tags": [1, {"a": None}], **({"id": "9"} if with_id else {})}}
            for n in range(rng.choice([1, 2, 5]))
        ]
        chars = list(json.dumps(posts))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(chars))
            if rng.random() < 0.5:
                chars[at : at + rng.choice([1, 2, 8])] = []
            else:
                chars.insert(at, rng.choice('{}[]",:\\ -0N'))
        found = re.search(r"\[\s*{.*}\s*\]", "".join(chars), re.DOTALL)
        if found:
            texts.append(found.group(0))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, found string")
    df = decode_posts(df).select("k", F.col("posts").alias("p"))
    for row in df.orderBy("k").collect():
        got = row.p and [(p.tweet and p.tweet.id_str, p.tweet and p.tweet.full_text) for p in row.p]
        want = decoded(texts[row.k])
        assert (got is None) == (want is None), texts[row.k]
        if want is not None and all("{" not in (t or "") and "[" not in (t or "") for pair in want for t in pair):
            assert got == want, texts[row.k]


def test_large_file_in_one_piece(spark, tmp_path):
    file = tmp_path / "p.js"
    file.write_text(wrapped([{"tweet": {"id_str": str(i), "id": str(i), "full_text": "word " * 40}} for i in range(100_000)]))
    assert scan_archive(spark, str(file)).agg(F.max("pos"), F.countDistinct("id_str")).first() == (99_999, 100_000)


def test_array_that_closes_early_is_refused(spark, tmp_path):
    file = tmp_path / "posts.js"
    file.write_text('window.posts.part0 = [{"tweet":{"id_str":"1","id":"1","full_text":"a"}}],[]] junk [{"tweet":{"id_str":"2","id":"2","full_text":"b"}}]')
    with pytest.raises(Exception, match="Damaged array"):
        scan_archive(spark, str(file)).collect()


# --- files read in ranges


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


ODD_TEXTS = ["", "a } b", '"}"', "\\\\", '\\"}],[{', "{[", "]}", "[{}]", "é😀}", "\n", 'ends with \\', "}" * 30, "x" * 300]


def odd_archive(rng, n):
    posts = []
    for k in range(n):
        tweet = {"id_str": str(k), "full_text": "".join(rng.choice(ODD_TEXTS) for _ in range(rng.randint(0, 4)))}
        if rng.random() < 0.5:
            tweet |= {"id": str(k), "entities": {"tags": [{"a": [rng.choice(ODD_TEXTS)]}, {}], rng.choice(["}", "b"]): {"c": {}}}}
        posts.append({"tweet": tweet} if rng.random() < 0.9 else {rng.choice(["tweet", "other"]): None})
    text = json.dumps(posts, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
    return posts, rng.choice(["window.posts.part0 = ", 'var a = "[x"; ', "", "[", "é = "]) + text + rng.choice(["", "\n", ";", "]", " // [end"])


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
def test_posts_at_the_borders_of_ranges_are_whole(spark, tmp_path, split_size, size):
    rng = random.Random(size)
    split_size(size)
    want, number = [], 0
    for k in range(3):
        posts, text = odd_archive(rng, rng.choice([1, 4, 9]))
        (tmp_path / f"p{k}.js").write_bytes(text.encode())
        for pos, p in enumerate(posts):
            t = p.get("tweet") or {}
            want.append((f"p{k}.js", pos, number, t.get("id_str"), t.get("id"), t.get("full_text")))
            number += 1
    rows = scan_archive(spark, str(tmp_path))
    got = sorted((r.src_file.rsplit("/", 1)[1], r.pos, r.number, r.id_str, r.id, r.item_text) for r in rows.collect())
    assert got == want
    assert rows.count() == len(want)


def in_ranges(raw, size):
    """The rows in which Spark's line reader gives a file that is split at `size` bytes and parted at braces."""
    rows, at = [], 0
    for piece in raw.split(b"}") if not raw.endswith(b"}") else raw[:-1].split(b"}"):
        block = 0 if at == 0 else (at - 1) // size * size
        rows.append((block, piece))
        at += len(piece) + 1
    return rows


class Batch:
    def __init__(self, rows):
        self.rows = rows

    def column(self, name):
        values = {"file": "f", "block": None, "value": None}
        return type("Column", (), {"to_pylist": lambda _: [values["file"] if name == "file" else r[0] if name == "block" else r[1] for r in self.rows]})()


def read_in_ranges(raw, size, batch):
    names = ("file", "block", "value")
    rows = in_ranges(raw, size)
    batches = lambda: iter([Batch(rows[k : k + batch]) for k in range(0, len(rows), batch)])
    known, posts = json_ranges.states(list(json_ranges.effects(batches(), names)))
    if posts["f"] is None:
        return None
    records, closed = {}, {}
    for _, pos, block, piece, ends, whole in json_ranges.pieces(batches(), names, known):
        assert not whole or pos not in records
        records.setdefault(pos, []).append((block, piece))
        closed[pos] = closed.get(pos, False) or ends
    out = []
    for pos in sorted(records):
        text = b"".join(p for _, p in sorted(records[pos])).decode()
        if not closed[pos]:
            if not re.match(r"[ \t\n\r]*\]", text) or re.search(r"\}\s*\]", text):
                return None
            continue
        head = re.match(r"\[[ \t\n\r]*(?=\{)" if pos == 0 else r"[ \t\n\r]*,[ \t\n\r]*(?=\{)", text)
        try:
            post = head and json.loads(text[head.end() :])
        except json.JSONDecodeError:
            return None
        if not isinstance(post, dict):
            return None
        out.append(post)
    return out


def test_ranges_judge_damaged_archives_as_a_whole_reader_does():
    rng = random.Random(12)
    sound = 0
    for _ in range(4000):
        _, text = odd_archive(rng, rng.choice([1, 2, 4]))
        chars = list(text)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(chars))
            if rng.random() < 0.5:
                chars[at : at + rng.choice([1, 2, 8])] = []
            else:
                chars.insert(at, rng.choice('{}[]",:\\ 0'))
        text = "".join(chars)
        found = re.search(r"\[\s*{.*}\s*\]", text, re.DOTALL)
        want = None
        if found:
            try:
                want = json.loads(found.group(0))
                want = want if isinstance(want, list) and all(isinstance(p, dict) for p in want) else None
            except json.JSONDecodeError:
                pass
        size, batch = rng.choice([1, 5, 60, 10**6]), rng.choice([1, 3, 1000])
        assert read_in_ranges(text.encode(), size, batch) == want, (text, size, batch)
        sound += want is not None
    assert 1000 < sound < 3900


def test_broken_archives_are_refused_in_ranges(spark, tmp_path, split_size):
    split_size(400)
    file = tmp_path / "p.js"
    good = wrapped(sample(20))
    for bad in (good[:-1], good[:-200], good.replace('"post_7"', '"post_7'), good + "; x = [{}]", good.replace("},", "}", 1)):
        file.write_text(bad)
        with pytest.raises(Exception, match="Damaged array|No array"):
            scan_archive(spark, str(file)).count()
    (tmp_path / "p.js").write_text("")
    with pytest.raises(ValueError):
        scan_archive(spark, str(file))


def test_a_large_file_is_many_tasks(spark, tmp_path, split_size):
    file = tmp_path / "p.js"
    file.write_text(wrapped([{"tweet": {"id_str": str(i), "id": str(i), "full_text": "word } " * 40}} for i in range(40_000)]))
    split_size(1 << 20)
    rows = scan_archive(spark, str(file))
    assert archive._ranges(spark, str(file)).rdd.getNumPartitions() >= 10
    assert rows.agg(F.count("*"), F.max("pos"), F.countDistinct("id_str"), F.min(F.length("item_text"))).first() == (40_000, 39_999, 40_000, 280)


def test_chunks_of_many_small_files_are_even(spark, tmp_path):
    from siftwell.operators.items import assign_chunks

    for k in range(23):
        (tmp_path / f"p{k:02}.js").write_text(wrapped(sample(1 + k % 2)))
    rows = assign_chunks(scan_archive(spark, str(tmp_path)), 5)
    assert sorted(r["count"] for r in rows.groupBy("chunk_id").count().collect()) == [6, 7, 7, 7, 7]
    assert sorted(r.number for r in rows.collect()) == list(range(34))


def test_what_is_worked_on_at_a_time_does_not_grow_with_spark_s_batches():
    import tracemalloc

    import pyarrow as pa

    from siftwell.sources import archive

    post = b'{"tweet":{"id":"1","id_str":"1","full_text":"' + b"a" * 3000 + b'"'
    values = [b"x = [" + post, *[b""] * 3, *[x for k in range(5000) for x in (b"," + post, b"")], b"]", b"y" * (3 << 20), b"z"]
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * len(values), "block": [0] * len(values), "value": values})
    tracemalloc.start()
    sizes, back, most = [], [], 0
    for part in archive._slices(iter([batch, batch.slice(0, 0)])):
        sizes.append(part.num_rows and sum(map(len, part.column("value").to_pylist())))
        back.append(part)
    effect = list(json_ranges.effects(archive._slices(iter([batch])), ("file", "block", "value")))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pa.Table.from_batches(back).column("value").to_pylist() == values
    assert max(sizes) <= (4 << 20) + 4000 and most < 40 << 20
    assert effect == list(json_ranges.effects(iter([batch]), ("file", "block", "value")))
