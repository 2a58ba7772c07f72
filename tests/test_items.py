import pytest
from pyspark.sql import functions as F

from siftwell.functions.ids import resolve_id, store_key
from siftwell.operators.items import assign_chunks, drop_invalid_ids, resolve_ids, select_chunk
from siftwell.spec import AuditSpec, Criteria, UrlSpec


def test_resolve_id_follows_truth(spark):
    cases = [("a", "b"), ("", "b"), (None, "b"), ("", ""), (None, None), (None, "0"), ("0", "b"), (None, "00")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, s string, i string")
    got = [r[0] for r in df.orderBy("k").select(resolve_id(F.col("s"), F.col("i"))).collect()]
    assert got == [(s or (i if i not in ("", "0") else None)) or None for s, i in cases]


def test_store_key_strips_like_python(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    ids = [b + "4 2" + b for b in blanks] + ["  a\t\n", "x", "", "​z"]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, i string")
    got = [r[0] for r in df.orderBy("k").select(store_key(F.col("i"))).collect()]
    assert got == [i.strip() for i in ids]


def test_round_robin_chunks(posts):
    items = posts([(f"post_{i}", "t") for i in range(47)])
    by_chunk = {k: [r.item_id for r in select_chunk(items, k, 5).orderBy("pos").collect()] for k in range(5)}
    assert by_chunk[0][:3] == ["post_0", "post_5", "post_10"]
    assert by_chunk[2][:3] == ["post_2", "post_7", "post_12"]
    assert [len(v) for v in by_chunk.values()] == [10, 10, 9, 9, 9]
    assert len({i for v in by_chunk.values() for i in v}) == 47


def test_hash_chunks_cover_all(posts):
    items = assign_chunks(posts([(f"post_{i}", "t") for i in range(100)]), 7, by="hash")
    assert {r.chunk_id for r in items.select("chunk_id").distinct().collect()} <= set(range(7))
    assert sum(select_chunk(items, k, 7).count() for k in range(7)) == 100
    with pytest.raises(ValueError):
        assign_chunks(items, 7, by="size")


@pytest.mark.parametrize("chunk_id", [-1, 5, 100])
def test_chunk_id_out_of_range(posts, chunk_id):
    with pytest.raises(ValueError, match="out of range"):
        select_chunk(posts([("a", "t")]), chunk_id, 5)


@pytest.mark.parametrize("n", [0, -5])
def test_chunk_count_must_be_positive(posts, n):
    with pytest.raises(ValueError, match="number_of_chunks must be > 0"):
        assign_chunks(posts([("a", "t")]), n)
    with pytest.raises(ValueError, match="number_of_chunks must be > 0"):
        AuditSpec(Criteria(), UrlSpec("u", "x"), number_of_chunks=n)


def test_invalid_ids_become_failures(posts):
    kept, dropped = drop_invalid_ids(posts([("a", "t"), (None, "u"), ("unknown", "v"), ("", "w"), ("b", "x")]))
    assert sorted(r.item_id for r in kept.collect()) == ["a", "b"]
    rows = sorted(dropped.collect(), key=lambda r: r.ord.row)
    assert [(r.item_id, r.stage, r.fail_reason, r.ord.file, r.ord.row) for r in rows] == [
        (None, "id", "no_id", "src", 1),
        ("unknown", "id", "no_id", "src", 2),
        (None, "id", "no_id", "src", 3),
    ]


def test_no_posts(posts, spark):
    empty = posts([("a", "t")]).limit(0)
    assert select_chunk(empty, 0, 5).collect() == []


def test_dropped_posts_are_found_without_reading_texts(spark, posts, tmp_path):
    posts([("a", "t"), (None, "u")]).drop("item_id", "store_key").write.parquet(str(tmp_path / "p"))
    _, dropped = drop_invalid_ids(resolve_ids(spark.read.parquet(str(tmp_path / "p"))))
    plan = dropped._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "item_text" not in plan
    assert dropped.count() == 1
