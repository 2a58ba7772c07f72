"""Answers read by Spark: each shape with the outcome it must have."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.operators.responses import failed, good, parse_responses
from siftwell.operators.stats import failures_by_reason, response_stats
from siftwell.sources.responses import scan_responses
from tests.helpers import VERDICT, answer, envelope

OK = json.dumps(VERDICT)


def changed(**values):
    return json.dumps({**VERDICT, **values})


#: Answer texts that hold a verdict, with its decision, reason, words and further keys where they aren't the usual ones.
VERDICTS = [
    (OK, {}),
    (f"```json\n{OK}\n```", {}),
    (f"My verdict on this one:\n{OK}\nHope that helps!", {}),
    (json.dumps(VERDICT, indent=4), {}),
    (f"[{OK}]", {}),
    (f"{OK}]", {}),
    (f"x ]{OK}[ y", {}),
    (OK + " ", {}),
    ("\ufeff" + OK, {}),
    (changed(deletion=None), {"deletion": None}),
    (changed(deletion="MAYBE"), {"deletion": "MAYBE"}),
    (changed(explicit_words="none"), {"words": None}),
    (changed(explicit_words=None, topic_of_tweet={"a": 1}), {"words": None, "topics": None}),
    (changed(note={"deep": [1, 2.5, "x"]}, score=0.25), {"extras": {"note", "score"}}),
    (changed(reason_for_flag='braces } { and "quotes" \\ and\nlines é😀'), {"reason": 'braces } { and "quotes" \\ and\nlines é😀'}),
    (changed(reason_for_flag="fence ``` inside ```json too"), {"reason": "fence  inside  too"}),
    (OK.replace('"KEEP"', '"KEEP", "deletion": "DELETE"'), {"deletion": "DELETE"}),
    (OK.replace('"KEEP"', '"KEEP", "note": 1, "note": 2, "deletion": "DELETE", "deletion": "N/A"'), {"deletion": "N/A", "extras": {"note"}}),
    (OK.replace("fine", "\\u00e9 \\ud83d\\ude00 \\/"), {"reason": "é 😀 /"}),
]
#: Answer texts that hold none.
NO_VERDICTS = [
    "{ half a thought, no quotes }",
    f"{OK} or else {OK}",
    f"{OK},{{}}",
    f"{OK}] x [{OK}",
    "",
    "nothing of that kind",
    "{}",
    "null",
    json.dumps({k: v for k, v in VERDICT.items() if k != "deletion"}),
    OK.replace('"KEEP"', "'KEEP'"),
    OK.replace('"KEEP"}', '"KEEP",}'),
    OK.replace("fine", "raw\nline break"),
    OK.replace("fine", "raw\ttab"),
    OK.replace("fine", "\\x41"),
    OK.replace("[]", "[1, 2"),
    OK.replace("[]", "[01]"),
    OK[:-1],
]
BODY = {"candidates": [{"content": {"parts": [{"text": OK}]}}]}
#: Whole lines with the reason why they fail, if they do, and the id they have.
LINES = [
    (json.dumps({"key": "n1", "response": BODY}), None, "n1"),
    (json.dumps({"key": "n2", "tweet_url": None, "response": BODY}), None, "n2"),
    (json.dumps({"key": None, "tweet_url": "u", "response": BODY}), None, "None"),
    (json.dumps({"key": 123456789012345678901, "tweet_url": "u", "response": BODY}), None, "123456789012345678901"),
    (json.dumps({"key": "n13", "response": {"candidates": BODY["candidates"] + [7]}}), None, "n13"),
    (json.dumps({"key": "n14", "response": BODY, "usage": {"tokens": [1]}, "extra": None}), None, "n14"),
    ('{"key": "a", "key": "n15", "response": %s}' % json.dumps(BODY), None, "n15"),
    (answer("n19") + " ", None, "n19"),
    (answer("n20") + "\r", None, "n20"),
    (json.dumps({"key": "n3"}), "no_text", "n3"),
    (json.dumps({"key": "n4", "response": None}), "no_text", "n4"),
    (json.dumps({"key": "n5", "response": "text"}), "no_text", "n5"),
    (json.dumps({"key": "n6", "response": [BODY]}), "no_text", "n6"),
    (json.dumps({"key": "n7", "response": {"candidates": []}}), "no_text", "n7"),
    (json.dumps({"key": "n8", "response": {"candidates": {}}}), "no_text", "n8"),
    (json.dumps({"key": "n9", "response": {"candidates": [{}]}}), "no_text", "n9"),
    (json.dumps({"key": "n10", "response": {"candidates": [5]}}), "no_text", "n10"),
    (json.dumps({"key": "n11", "response": {"candidates": [{"content": {"parts": []}}]}}), "no_text", "n11"),
    (json.dumps({"key": "n12", "response": {"candidates": [{"content": {"parts": "x"}}]}}), "no_text", "n12"),
    (json.dumps({"tweet_url": "u", "response": BODY}), "bad_line", None),
    ("no JSON here", "bad_line", None),
    ("5", "bad_line", None),
    ("null", "bad_line", None),
    ("[]", "bad_line", None),
    ("{}", "bad_line", None),
    (json.dumps([{"key": "n16", "response": BODY}]), "bad_line", None),
    (answer("n17") + "]", "bad_line", None),
    (answer("n18") + ",{}", "bad_line", None),
    ("\r", "bad_line", None),
    (" ", "bad_line", None),
    ('{"key": "n21"', "bad_line", None),
]


def in_order(parsed):
    return sorted(parsed.collect(), key=lambda r: r.ord.row)


def test_texts_with_a_verdict(responses):
    rows = in_order(parse_responses(responses([envelope(f"t{k}", text) for k, (text, _) in enumerate(VERDICTS)])))
    usual = {"deletion": "KEEP", "reason": "fine", "words": [], "topics": ["news"], "extras": set()}
    for k, (row, (text, own)) in enumerate(zip(rows, VERDICTS, strict=True)):
        got = {"deletion": row.deletion, "reason": row.reason, "words": row.explicit_words, "topics": row.topics, "extras": set(row.extras)}
        assert (row.fail_reason, row.item_id, row.line) == (None, f"t{k}", None), text
        assert got == usual | own, text


def test_texts_without_a_verdict(responses):
    lines = [envelope(f"t{k}", text) for k, text in enumerate(NO_VERDICTS)]
    rows = in_order(parse_responses(responses(lines)))
    assert [(r.fail_reason, r.item_id, r.line, r.raw) for r in rows] == [("bad_verdict", f"t{k}", line, None) for k, line in enumerate(lines)]


def test_lines(responses):
    rows = in_order(parse_responses(responses([line for line, _, _ in LINES])))
    assert [(r.fail_reason, r.item_id, r.line) for r in rows] == [(reason, key, line if reason else None) for line, reason, key in LINES]


def test_the_answer_s_own_object_is_kept(responses):
    text = json.dumps({**VERDICT, "note": {"deep": [1, None]}, "score": 0.25}, indent=1)
    row = parse_responses(responses([envelope("a", f"So:\n{text}\n")])).first()
    assert json.loads(row.raw) == {**VERDICT, "note": {"deep": [1, None]}, "score": 0.25}


def test_repeated_keys_take_the_last(responses):
    line = envelope("k", OK.replace('"KEEP"', '"KEEP", "note": 1, "note": 2, "deletion": "DELETE"'))
    row = parse_responses(responses([line])).first()
    assert row.deletion == "DELETE" and row.extras == {"note": "2"}


def test_empty_lines_are_skipped_uncounted(responses):
    parsed = parse_responses(responses(["", answer("a"), "", "junk", ""]))
    assert response_stats(parsed).first().asDict() == {"chunk_id": 0, "n_ok": 1, "n_failed": 1, "n_total": 2}


def test_absent_link_is_empty(responses):
    lines = [json.dumps({"key": "a", "response": BODY}), answer("b")]
    rows = {r.item_id: r.item_url for r in good(parse_responses(responses(lines))).collect()}
    assert rows == {"a": "", "b": "https://posts.example/u/status/1"}


def test_failures_keep_line_and_reason(responses):
    lines = [answer("a"), "junk", json.dumps({"key": "b"}), envelope("c", "{}"), envelope("d", "no")]
    parsed = parse_responses(responses(lines))
    assert {(r.item_id, r.fail_reason, r.line) for r in failed(parsed).collect()} == {
        (None, "bad_line", "junk"),
        ("b", "no_text", lines[2]),
        ("c", "bad_verdict", lines[3]),
        ("d", "bad_verdict", lines[4]),
    }
    counts = {(r.fail_reason, r.n_lines, r.n_ids) for r in failures_by_reason(parsed).collect()}
    assert counts == {("bad_line", 1, 0), ("no_text", 1, 1), ("bad_verdict", 2, 2)}


def test_scan_splits_at_newline_only_and_keeps_order(spark, tmp_path):
    folder = tmp_path / "in" / "chunk_id=3"
    folder.mkdir(parents=True)
    lines = [f"line {i}\r" if i % 3 else f"a\rb {i}" for i in range(500)]
    (folder / "answers.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "in" / "answers_chunk_12.jsonl").write_bytes(b"other")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        scanned = scan_responses(spark, str(tmp_path / "in"))
        rows = scanned.where("chunk_id = 3").collect()
        assert len({r.ord.block for r in rows}) > 5
        assert [r.line for r in sorted(rows, key=lambda r: (r.ord.file, r.ord.block, r.ord.row))] == lines
        assert [(r.line, r.chunk_id) for r in scanned.where("chunk_id <> 3").collect()] == [("other", 12)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_parsed_once_under_a_filter(responses):
    plan = good(parse_responses(responses([answer("a")])))._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert filters and not any("from_json" in x for x in filters)


@pytest.mark.parametrize("text", ["plain", "fenced", "prose"])
def test_usual_shapes(responses, text):
    shaped = {"plain": OK, "fenced": f"\n```json\n{OK}\n```\n", "prose": f"Look:\n{OK}\nDone."}[text]
    row = good(parse_responses(responses([envelope("1", shaped)]))).first()
    assert (row.item_id, row.deletion, row.topics, row.reason) == ("1", "KEEP", ["news"], "fine")


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')


def spoiled(rng, text):
    """Sound JSON without one of the marks that hold it together: a bracket, colon, comma or the quote of a text."""
    tokens = _TOKEN.findall(text)
    at = rng.choice([k for k, t in enumerate(tokens) if t[0] in '"{}[]:,'])
    tokens[at] = rng.choice([tokens[at][1:], tokens[at][:-1]])
    return "".join(tokens)


def spaced(rng, text):
    """The same JSON with white space between its tokens."""
    return "".join(rng.choice(["", " ", "\t", "\r", "  "]) + t for t in _TOKEN.findall(text))


def test_damage_to_a_line_or_an_answer_is_seen(responses):
    """Whichever mark is missing, the line fails at the level it belongs to; white space never matters."""
    rng = random.Random(7)
    lines, want = [], []
    for k in range(6000):
        text = changed(reason_for_flag=rng.choice(["fine", "a, b: [c]", 'says \\ "x"', "é😀"]), note=rng.choice([[1, {"a": []}], "n", None, 2.5]))
        kind = k % 3
        if kind == 0:
            line = spaced(rng, envelope(f"m{k}", spaced(rng, text)))
        elif kind == 1:
            line = spoiled(rng, envelope(f"m{k}", text))
        else:
            line = envelope(f"m{k}", spoiled(rng, text))
        lines.append(line)
        want.append([(None, f"m{k}"), ("bad_line", None), ("bad_verdict", f"m{k}")][kind])
    rows = in_order(parse_responses(responses(lines)))
    wrong = [(line, w, (r.fail_reason, r.item_id)) for r, line, w in zip(rows, lines, want, strict=True) if (r.fail_reason, r.item_id) != w]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("tail", [",{}]", ",{}] and {\"x\":1}", ",{}]}", ",{\"key\":\"0\"}]"])
def test_text_that_closes_the_array_itself_is_no_answer(spark, tail):
    from siftwell.functions import answers

    text = '{"a":"1"}'
    df = spark.createDataFrame([(text,), (text + tail,)], "t string").withColumn("e", answers.elements(F.col("t"), answers.OBJECT))
    assert [r.v for r in df.select(answers.sole(F.col("e")).alias("v")).collect()] == [{"a": "1"}, None]


def test_chunk_is_that_of_the_last_name_in_the_path(spark):
    from siftwell.sources.responses import _chunk_of_path

    paths = ["job_chunk_7/chunk_id=3/p.txt", "a/answers_chunk_4.jsonl", "chunk_20240601123456/p", "plain"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.c for r in df.select(_chunk_of_path(F.col("p")).alias("c")).collect()] == [3, 4, None, None]
