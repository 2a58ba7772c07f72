"""Chat formatting by Spark expressions only: collected turns are sorted, adjacent
turns of one role are merged, and their texts concatenated.

Template, per merged turn: <|im_start|>ROLE\nTEXT<|im_end|>\n, with <|im_sep|>
between the texts that were merged. A control string inside a text or role is
escaped by one tilde more after its "<": <| becomes <~|, <~| becomes <~~|, and so
on, which no template mark contains and which unescape() undoes exactly. A line
feed inside a role becomes the mark <|im_nl|>.

The output row keeps the formatted string as segments with the loss mask: joined
they are the formatted string, and the flagged ones, in order, are what a model
is trained on. Segments avoid offsets into long strings, so a very long
conversation costs time in proportion to its length.

Defined results: null text and null role are empty; a null conv_id is a
conversation of its own; rows of equal turn are ordered by role, then text; a
null turn comes first; repeated rows are turns of their own; extra columns are
ignored; an empty table gives no rows. A conversation is one output row, so its
turns meet in one task, as the format itself demands; turns are not cut or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.quality import let

START, END, JOIN, LINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def formatted(turns: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """Per conversation: conv_id, segments array<struct<text, loss>> whose texts joined are the formatted string."""
    text = lambda name: F.coalesce(turns[name].cast("string"), F.lit(""))
    rows = turns.select(
        turns["conv_id"].alias("conv_id"),
        F.struct(
            turns["turn"].alias("turn"),
            F.replace(escape(text("role")), F.lit("\n"), F.lit(LINE)).alias("role"),
            escape(text("text")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def merged(t: Column) -> Column:
        """A struct of role and texts for each run of one role."""
        role = lambda k: F.get(t, k).getField("role")
        first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: ~role(k).eqNullSafe(role(k - 1)))

        def runs(starts: Column) -> Column:
            end = lambda n: F.coalesce(F.get(starts, n + 1), F.size(t))
            return F.transform(
                starts,
                lambda k, n: F.struct(
                    role(k).alias("role"),
                    F.transform(F.slice(t, k + 1, end(n) - k), lambda x: x["text"]).alias("texts"),
                ),
            )

        return let(first, runs)

    mark = lambda *parts: F.struct(F.concat(*parts).alias("text"), F.lit(False).alias("loss"))
    learned = F.lit(learned_role)

    def segments(run: Column) -> Column:
        head = mark(F.lit(START), run["role"], F.lit("\n"))
        body = lambda x: F.struct(x.alias("text"), (run["role"] == learned).alias("loss"))
        texts = F.transform(run["texts"], lambda x, n: F.when(n > 0, F.array(mark(F.lit(JOIN)), body(x))).otherwise(F.array(body(x))))
        return F.concat(F.array(head), F.flatten(texts), F.array(mark(F.lit(END), F.lit("\n"))))

    return ordered.select("conv_id", F.flatten(F.transform(merged(F.col("turns")), segments)).alias("segments"))


def text_of(segments: Column) -> Column:
    """The formatted string of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_of(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def turns_of(text: Column) -> Column:
    """The original turns, array<struct<role, text>>, read from a formatted string alone."""

    def turns(block: Column) -> Column:
        at = F.locate("\n", block)
        role = unescape(F.replace(F.substring(block, F.lit(1), at - 1), F.lit(LINE), F.lit("\n")))
        body = F.substring(block, at + 1, F.length(block) - at - len(END) - 1)
        return F.transform(
            F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    blocks = F.filter(F.split(text, r"<\|im_start\|>"), lambda b, k: k > 0)
    return F.flatten(F.transform(blocks, turns))
