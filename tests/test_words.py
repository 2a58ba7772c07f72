"""Dictionary entries against a token matcher in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions.words import dictionary, entry_table, found_words, join_words


def brute(text, forbidden):
    text = (text or "").lower()
    tokens, words = re.findall(r"[^\W_]+|[^\w\s]|_", text), re.findall(r"[^\W_]+", text)
    holds = lambda have, e: any(have[i : i + len(e)] == e for i in range(len(have) - len(e) + 1))
    return [shown for e, _, words_only, shown in dictionary(forbidden) if holds(words if words_only else tokens, e.split(" "))]


CASES = ["vitamin c is fine", "I write C++ daily", "c + + ", "win $$$ now", "win $$ now", "👍🏽 ok", "👍 ok", "old, times", "older times", "a_b", "a b", "É!", None, "", "c++c", "x++"]
LIST = ["c++", "$$$", "👍", "old times", "a_b", "é", "", "  ", "__", "C++", "x"]


def found(spark, texts, forbidden, joined):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("lower", F.lower(F.coalesce("text", F.lit(""))))
    entries = dictionary(forbidden)
    if joined:
        out = join_words(rows, "lower", entry_table(spark, entries))
    else:
        out = rows.withColumn("explicit_words", found_words(F.col("lower"), entries))
    return {r.k: r.explicit_words for r in out.collect()}


@pytest.mark.parametrize("joined", [False, True])
def test_symbols_are_tokens(spark, joined):
    got = found(spark, CASES, LIST, joined)
    assert got == {k: brute(t, LIST) for k, t in enumerate(CASES)}
    assert got[0] == [] and got[1] == ["c++"] and got[3] == ["$$$"] and got[4] == [] and got[7] == ["old times"] and got[9] == ["a_b"]


@pytest.mark.parametrize("joined", [False, True])
def test_matches_are_those_of_brute_force(spark, joined):
    rng = random.Random(6)
    parts = ["ab", "c", "d1", "é", "+", "-", "$", "_", "😀"]
    make = lambda n: "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, n)))
    texts = [make(30) for _ in range(200)] + ["ab c"] * 50
    forbidden = [make(4) for _ in range(60)]
    assert found(spark, texts, forbidden, joined) == {k: brute(t, forbidden) for k, t in enumerate(texts)}


def test_a_hundred_thousand_entries(spark, posts, spec):
    from siftwell.operators.scoring import score_rules
    from siftwell.spec import Criteria

    words = [f"word{k} x{k}" if k % 3 else f"w{k}+" for k in range(100_000)]
    items = posts([("0", "word7, x7 and w9+ here"), ("1", "word7 x8 w9"), ("2", None), ("0", "w99999+")])
    rows = score_rules(items, Criteria(words), spec.url).orderBy("ord.row").collect()
    assert [r.explicit_words for r in rows] == [["word7 x7", "w9+"], [], [], ["w99999+"]]
    assert [r.deletion for r in rows] == ["DELETE", "KEEP", "KEEP", "DELETE"]
