"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

A rule is a row (measure, least, most); RULES is the table in use. compile_rules
turns any such table into a single boolean expression over the measures, and
measures() gives the measures as expressions over the text, so everything is
evaluated in the scan's own projection: no shuffle, no Python.

Defined results: a null text has no words, no lines and no symbols; it fails
the base rule (fewer than 50 words). White space is x20 and x09 to x0D, a word
a run of anything else. A measure whose base is 0 is 0. Repeated rows are judged
each on their own; extra columns of the input are ignored unless asked for.
Equality of three-word windows is equality of their 64-bit xxhash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent words of the languages served, lower case; fixed values.
STOP_WORDS = (
    "the of and to in is that for with on as are this be by it was from at or an not",
    "der die das und in den von zu mit des ist im auf für nicht ein eine dem sich auch",
    "de la le les et des en un une du que est pour dans qui sur pas au avec il",
    "el la los de que y en un una por con para las del se es no al lo su",
)

#: measure, smallest and largest value allowed (None: no bound).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2, 20),
    ("symbol_word_ratio", None, 0.5),
    ("stop_word_ratio", 0.005, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
)


def _octets_of(text: Column, chars: str) -> Column:
    """How often these one-octet characters are in text."""
    rest = [F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return F.octet_length(text) * F.lit(len(chars)) - sum(rest[1:], rest[0])


def words_of(text: Column) -> Column:
    """The words in order; an empty array for a null or blank text."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once, within a single projection."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more, the first finding included.

    Only texts with a repeated window sort their windows, with their places; one
    that equals a neighbour in that order is repeated. Each of the sorted places
    of those adds the words up to the next place, three at most, so that overlaps
    count once.
    """
    zero = F.lit(0)
    last = F.size(words) - 2
    windows = F.when(last < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )

    def places(pairs: Column) -> Column:
        at = lambda k: F.get(pairs, k).getField("h")
        found = F.filter(pairs, lambda w, k: at(k - 1).eqNullSafe(w["h"]) | at(k + 1).eqNullSafe(w["h"]))
        return F.sort_array(F.transform(found, lambda w: w["i"]))

    def covered(at: Column) -> Column:
        gap = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))
        return F.aggregate(F.transform(at, gap), zero, lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(pairs, lambda x: let(places(x), covered)))

    return let(windows, count)


def stop_words(words: Column) -> Column:
    known = sorted({w for line in STOP_WORDS for w in line.split()})
    return F.size(F.filter(words, lambda w: F.lower(w).isin(known)))


def measures(text: Column) -> Column:
    """One struct of all that the rules look at; counts are long, ratios double."""
    text = F.coalesce(text, F.lit(""))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def counted(words: Column, lines: Column) -> Column:
        n_words, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
        word_chars = F.char_length(text) - _octets_of(text, SPACE)
        n_symbols = _octets_of(text, SYMBOLS)
        n_dup = n_lines - F.size(F.array_distinct(lines))
        bullets = F.size(F.filter(lines, lambda x: F.ltrim(x, F.lit(SPACE)).rlike("^[-*\u2022]")))
        ellipses = F.size(F.filter(lines, lambda x: F.rtrim(x, F.lit(SPACE)).rlike("(\\.\\.\\.|\u2026)$")))
        return F.struct(
            n_words.alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            n_dup.cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            n_lines.alias("n_lines"),
            ratio(word_chars, n_words).alias("mean_word_chars"),
            ratio(n_symbols, n_words).alias("symbol_word_ratio"),
            ratio(stop_words(words), n_words).alias("stop_word_ratio"),
            ratio(n_dup, n_lines).alias("dup_line_ratio"),
            ratio(bullets, n_lines).alias("bullet_line_ratio"),
            ratio(ellipses, n_lines).alias("ellipsis_line_ratio"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    return let(words_of(text), lambda words: let(lines, lambda x: counted(words, x)))


def compile_rules(measured: Column, rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> Column:
    """True where every measure lies within its bounds; an empty table lets all pass."""
    verdict = F.lit(True)
    for name, least, most in rules:
        x = measured.getField(name)
        if least is not None:
            verdict = verdict & (x >= F.lit(least))
        if most is not None:
            verdict = verdict & (x <= F.lit(most))
    return verdict


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """Per row: doc_id, measures (struct), base_failed, kept."""
    seen = docs.select(docs[id_col].alias("doc_id"), measures(docs[text_col]).alias("measures"))
    m = F.col("measures")
    failed = (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
    return seen.select("doc_id", "measures", failed.alias("base_failed"), (~failed & compile_rules(m, rules)).alias("kept"))
