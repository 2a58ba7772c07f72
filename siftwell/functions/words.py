"""Word matching for the rule score.

Texts and dictionary entries are read as tokens: a run of letters and digits is one, every other
character but white space is one by itself. An entry of words only is found where its words
follow one another, whatever stands between them that is no word; an entry with symbols where
its tokens follow one another. So `c++` is not found in "vitamin c", and `old times` is in
"old, times".

Sequences of tokens are compared as a whole, as text with a blank between tokens. A short list
is a literal in the expression; a long one is a table, and joined.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries up to which a list is a literal of every task.
SHORT_LIST = 1000
#: First tokens up to which texts are searched for them beforehand.
FEW_FIRSTS = 32
_WORD = r"[\p{L}\p{N}]+"
_TOKEN = rf"(?U){_WORD}|[^\s\p{{L}}\p{{N}}]"

#: An entry's tokens with a blank between them, how many they are, whether all are words, and how the entry is shown.
Entry = tuple[str, int, bool, str]


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def dictionary(forbidden: list[str]) -> list[Entry]:
    """The different entries that have a token, single words first, else in list order."""
    entries: dict[str, Entry] = {}
    for raw in forbidden:
        tokens = re.findall(r"[^\W_]+|[^\w\s]|_", raw.lower())
        key, words_only = " ".join(tokens), all(re.fullmatch(r"[^\W_]+", t) for t in tokens)
        if tokens:
            entries.setdefault(key, (key, len(tokens), words_only, key if words_only else " ".join(raw.lower().split())))
    return sorted(entries.values(), key=lambda e: e[1] > 1)


def entry_table(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    return spark.createDataFrame([(k, *e) for k, e in enumerate(entries)], "place long, entry string, n int, words_only boolean, shown string")


def _sequences(tokens: Column, n: int) -> Column:
    """All runs of n tokens, as texts."""
    if n == 1:
        return tokens
    last = F.size(tokens) - F.lit(n - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(tokens, k, n), " "))
    return F.when(last > 0, runs).otherwise(F.array().cast("array<string>"))


def token_runs(lower: Column, shapes: list[tuple[int, bool]]) -> Column:
    """The runs of tokens of a lowered text that entries of these lengths, of words only or not, could be; each once."""
    parts = []
    for pattern, words_only in ((_WORD, True), (_TOKEN, False)):
        if sizes := [n for n, w in shapes if w == words_only]:
            parts.append(_runs_of(F.regexp_extract_all(lower, F.lit(pattern), 0), sizes))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def _runs_of(tokens: Column, sizes: list[int]) -> Column:
    """Runs of these lengths. Tokens are an element of an array here, so that they are cut once and not for each run."""
    return F.get(F.transform(F.array(tokens), lambda t: F.concat(*[_sequences(t, n) for n in sizes])), 0)


def found_words(lower: Column, entries: list[Entry]) -> Column:
    """Those of the entries that a lowered text holds, in their order.

    An entry of words only and one with symbols are never the same text, so all runs can
    be looked up together.
    """
    if not entries:
        return F.array().cast("array<string>")
    own = F.array(*[F.lit(e[0]) for e in entries])
    found = F.array_intersect(own, token_runs(lower, sorted({(n, w) for _, n, w, _ in entries})))
    if any(e[0] != e[3] for e in entries):
        shown = F.map_from_arrays(own, F.array(*[F.lit(e[3]) for e in entries]))
        found = F.transform(found, lambda e: F.element_at(shown, e))
    firsts = sorted({e[0].split(" ")[0] for e in entries})
    if len(firsts) > FEW_FIRSTS:
        return found
    # Texts that hold no entry's first token anywhere needn't be cut into tokens.
    holds = reduce(or_, [F.contains(lower, F.lit(w)) for w in firsts])
    return F.when(holds, found).otherwise(F.array().cast("array<string>"))


def join_words(rows: DataFrame, lower: str, entries: DataFrame) -> DataFrame:
    """Adds explicit_words by a join with a table of entries of any length.

    Runs of tokens move to the entries, not texts, and what is found comes back by a digest of
    the text, so equal texts are one. The digest's hash is a second key: with it the join
    back has shuffles of its own, in which a frequent text is split.
    """
    shapes = sorted((r["n"], r["words_only"]) for r in entries.select("n", "words_only").distinct().collect())
    marked = rows.withColumn("digest", F.unhex(F.sha2(lower, 256))).withColumn("digest_hash", F.xxhash64("digest"))
    runs = marked.select("digest", F.explode(token_runs(F.col(lower), shapes)).alias("entry"))
    hits = runs.join(entries.select("entry", "place", "shown"), "entry").groupBy("digest").agg(F.collect_set(F.struct("place", "shown")).alias("hits"))
    found = hits.select("digest", F.xxhash64("digest").alias("digest_hash"), F.sort_array("hits")["shown"].alias("hits"))
    nothing = F.array().cast("array<string>")
    return marked.join(found, ["digest", "digest_hash"], "left").select(*rows.columns, F.coalesce("hits", nothing).alias("explicit_words"))
