"""Phrase collocations by SON partitioning: complete local mining, then one exact global count.

Texts are lower-cased in A-Z, split at . , ; : ! ? and x0A to x0D into pieces, and those at
blanks and tabs into words. All counts are per language; a null language is `und`.

1. Local mining. Texts are dealt out in shards of about SHARD bytes, which a task mines completely:
   all phrases of 1 to LONGEST words, by hash, those of a length where both phrases one word shorter
   are frequent in the shard. Only words are held; phrases' hashes are made anew for each part of their range. A shard that holds the share w of all bytes
   reports what it has at least t = ceil(w * support) times. A phrase reported by no shard
   is found less than w * support times in each, so less than `support` times in all.
2. Union. Where a shard doesn't report a phrase, it holds it t - 1 times at most. A phrase is
   a candidate if the reported counts and those bounds reach the support; the sum is taken
   as what reports exceed t - 1 by. Equal hashes of different phrases only add candidates.
3. Global count. A bitmap of the candidates, of bounded size, goes to all tasks; what passes
   it is counted exactly, by the words themselves, and held against the support.

Shards are sized by memory, so the local support falls as the corpus grows; where it has come
to one, step 1 counts every phrase by hash and step 2 is exact, at the cost of a shuffle
of 16 bytes for each different phrase of a shard.

A candidate cut after its first k words, with a, l and r occurrences of it and its parts, has
the score floor(2000000 * a / (l + r)); its lowest counts. A candidate is dropped if a longer
one that contains it is found at least 80% as often. All arithmetic is in whole numbers.
Defined results: null and empty texts have no words; a language without a candidate has no
row; ids aren't read; repeated rows count each; ties end in the order of the phrases' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.bit_filter import bitmap, holds
from siftwell.llm.frames import arrow_schema, only, pieces, record_batch, written
from siftwell.llm.word_arrays import Alphabet, buffer_of, mix, words

SUPPORT = 30
LONGEST = 4
TOP = 2000
COVERED_PERCENT = 80
SCALE = 2_000_000
#: Bytes of text that are mined together, about, the least number of shards, and bytes that are hashed or counted at a time.
SHARD = 64 << 20
LEAST_SHARDS = 8
SLICE = 8 << 20
SALTS = 64
#: Numbers worked on at a time where an array is as long as a shard has words.
STRETCH = 1 << 18
#: Hashes that are sorted at a time, about, stripes of them that one pass over a shard finds, and the
#: size of the table that tells frequent ones, as a power of two.
STRIPE = 1 << 20
PASS = 4
MOST_TABLE = 23
BREAKS = b".,;:!?\n\v\f\r"
_ALPHABET = Alphabet(b" \t" + BREAKS, folded=True)
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_STEP = np.uint64(0xA0761D6478BD642F)


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Slice:
    """Words of a slice of texts: hash, place, and whether the next word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column("lang").to_pylist()
        self.data, offsets = buffer_of(batch.column("text"))
        self.hashes, self.starts, self.ends, self.owner = words(self.data, offsets, STRETCH, _ALPHABET)
        piece = np.searchsorted(np.flatnonzero(_BREAK[self.data]), self.starts)
        self.linked = (piece[1:] == piece[:-1]) & (self.owner[1:] == self.owner[:-1])

    def seeds(self) -> np.ndarray:
        """A number of each text's language."""
        return np.array([language_hash(x) for x in self.langs], np.uint64)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: hashes that tell languages apart, and the first word of each phrase."""
        at = np.arange(len(self.hashes))
        found = mix(self.hashes + self.seeds()[self.owner])
        yield 1, found, at
        for n in range(2, longest + 1):
            on = at + n - 2 < len(self.linked)
            on[on] = self.linked[at[on] + n - 2]
            at = at[on]
            found = mix(found[on] * _STEP + self.hashes[at + n - 1])
            yield n, found, at

    def text_of(self, at: np.ndarray, n: int) -> list[bytes]:
        """Phrases of n words, lower-cased, one blank between words."""
        raw = self.data.tobytes().lower()  # bytes.lower() changes A-Z only
        return [b" ".join(raw[a:b].split()) for a, b in zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), strict=True)]


def local_support(own: int, total: int, support: int) -> int:
    """The least count at which a shard of `own` of `total` bytes reports a phrase."""
    return max(1, -(-support * own // total))


class Shard:
    """Words of many slices: hash, language and whether the next word is in the same piece. Texts are let go.

    Room for the most words that the bytes can hold is reserved at once; what isn't written to takes no memory.
    """

    def __init__(self, most: int):
        room = most // 2 + 1
        self.hashes, self.spoken, self.linked = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, bool)
        self.n, self.size, self.languages = 0, 0, {}

    def add(self, batch: pa.RecordBatch) -> None:
        s = Slice(batch)
        stop = self.n + len(s.hashes)
        if stop > len(self.hashes):  # a text longer than all that was reserved for
            self.hashes, self.spoken, self.linked = (np.concatenate([x[: self.n], np.empty(stop, x.dtype)]) for x in (self.hashes, self.spoken, self.linked))
        here = slice(self.n, stop)
        place = np.array([self.languages.setdefault(x, len(self.languages)) for x in s.langs])
        if len(self.languages) - 1 > np.iinfo(self.spoken.dtype).max:
            wider = np.empty(len(self.spoken), np.min_scalar_type(len(self.languages) << 8))
            wider[: self.n] = self.spoken[: self.n]
            self.spoken = wider
        self.hashes[here], self.spoken[here] = s.hashes, place[s.owner]
        self.linked[here] = np.append(s.linked, False)[: len(s.hashes)]
        self.n, self.size = stop, self.size + text_bytes(batch)


def shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """What a task reads in shards of up to `most` bytes, or a little more."""
    held = None
    for piece in pieces(batches, "text", min(SLICE // 8, most)):
        if held is None:
            held = Shard(most + (most >> 3))
        held.add(piece)
        if held.size >= most:
            yield held
            held = None
    if held is not None:
        yield held


def text_bytes(batch: pa.RecordBatch) -> int:
    offsets = buffer_of(batch.column("text"))[1]
    return int(offsets[-1] - offsets[0])


def _stretches(n: int) -> Iterator[slice]:
    return (slice(a, min(a + STRETCH, n)) for a in range(0, n, STRETCH))


def _phrases(shard: Shard, seeds: np.ndarray, begins: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, hash) of the phrases of n words that begin where they may, a stretch at a time. Hashes are not kept, so each pass makes them again."""
    for s in _stretches(shard.n):
        at = s.start + np.flatnonzero(begins[s])
        found = mix(shard.hashes[at] + seeds[shard.spoken[at]])
        for k in range(1, n):
            found = mix(found * _STEP + shard.hashes[at + k])
        yield at, found


def _frequent(phrases: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]], most: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes that are there `least` times or more, of up to `most`, and how often, a stripe of their range at a time."""
    bits = (most // STRIPE).bit_length()
    shift = np.uint64(64 - bits)
    for group in range(0, 1 << bits, PASS):
        held = [found for _, found in phrases()] if bits == 0 else [f[(top >= group) & (top < group + PASS)] for _, f in phrases() for top in [f >> shift]]
        for k in range(group, min(group + PASS, 1 << bits)):
            own = np.concatenate(held if bits == 0 else [f[f >> shift == k] for f in held]) if held else np.zeros(0, np.uint64)
            own.sort()
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
            counts = np.diff(np.append(first, len(own)))
            often = counts >= least
            yield own[first[often]], counts[often]


def locally_frequent(shard: Shard, total: int, support: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of the phrases that a shard reports, their counts, and its local support. Those of a length come in stripes."""
    least = local_support(shard.size, total, support)
    seeds = np.array([language_hash(x) for x in shard.languages], np.uint64)
    begins = np.ones(shard.n + 1, bool)
    begins[-1] = False
    for n in range(1, longest + 1):
        most = int(np.count_nonzero(begins))
        # What is not frequent here has no longer phrase that is. A table of hash bits tells nearly all of that.
        table = np.zeros(1 << min(MOST_TABLE, max(10, (16 * most // least).bit_length())), bool)
        mask = np.uint64(len(table) - 1)
        for often, counts in _frequent(lambda n=n: _phrases(shard, seeds, begins, n), most, least):
            table[often & mask] = True
            yield often, counts, least
        if n == longest:
            break
        if least > 1:
            for at, found in _phrases(shard, seeds, begins, n):
                begins[at] = table[found & mask]
        for s in _stretches(shard.n):
            at = s.start + np.flatnonzero(begins[s])
            begins[at] = begins[at + 1] & shard.linked[at + n - 1]


def _tasks(total: int, shard: int) -> int:
    """Tasks of about a shard each. Neighbouring partitions are read by one task; no text is shuffled for it."""
    return max(LEAST_SHARDS, -(-total // shard))


def candidates(docs: DataFrame, total: int, support: int, longest: int, shard: int) -> DataFrame:
    """h: hashes of all phrases that may be found `support` times. docs: lang and text, of `total` bytes."""
    fields = arrow_schema(docs.sparkSession, "h long, over long")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Twice the size, so that a task of about one shard is one: a small rest would have a local
        # support of one and report all it holds.
        for one in shards(batches, 2 * shard):
            least = 1
            for hashes, counts, least in locally_frequent(one, total, support, longest):
                yield record_batch({"h": hashes.view(np.int64), "over": counts - (least - 1)}, fields)
            yield record_batch({"h": [None], "over": [least - 1]}, fields)

    dealt = docs.coalesce(_tasks(total, shard))
    counted = written(dealt.mapInArrow(mine, "h long, over long").groupBy("h").agg(F.sum("over").alias("over")), "phrase-reports")
    bound = counted.filter("h is null").agg(F.sum("over")).first()[0] or 0
    return counted.filter(F.col("h").isNotNull() & (F.col("over") + bound >= support)).select("h")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) found `support` times or more, and (lang, n), all words. docs: lang and text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(candidates(docs, total, support, longest, shard)))
    fields = arrow_schema(docs.sparkSession, "lang string, phrase string, a long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SLICE):
            s = Slice(piece)
            langs, of_text = np.unique(np.array(s.langs, object).astype(str), return_inverse=True)
            yield record_batch({"lang": langs.tolist(), "phrase": [None] * len(langs), "a": np.bincount(of_text[s.owner], minlength=len(langs))}, fields)
            for n, hashes, at in s.phrases(longest):
                may = holds(shared.value, hashes)
                _, first, counts = np.unique(hashes[may], return_index=True, return_counts=True)
                at = at[may][first]
                text = pa.array(s.text_of(at, n), pa.binary()).cast(pa.string())
                yield record_batch({"lang": langs[of_text[s.owner[at]]].tolist(), "phrase": text, "a": counts}, fields)

    counted = docs.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    kept = written(counted.filter(F.col("phrase").isNull() | (F.col("a") >= support)), "phrases")
    return kept.filter("phrase is not null"), kept.filter("phrase is null").select("lang", F.col("a").alias("n"))


def _part(of: Column, first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(of, first, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of all phrases of two words and more, by their lowest-scoring cut."""
    w, k = F.col("w"), F.col("k")
    split = phrases.withColumn("w", F.split("phrase", " ")).filter(F.size("w") >= 2)
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", _part(w, 1, k).alias("first"), _part(w, k + 1, F.size(w) - k).alias("rest"))
    left = phrases.select(F.col("lang").alias("lang_l"), F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = phrases.select(F.col("lang").alias("lang_r"), F.col("phrase").alias("rest"), F.col("a").alias("r"))
    met = parts.join(left, (F.col("lang") == F.col("lang_l")) & (parts["first"] == left["first"])).drop(left["first"])
    met = met.join(right, (F.col("lang") == F.col("lang_r")) & (parts["rest"] == right["rest"])).drop(right["rest"])
    # Whole numbers of 38 digits: the product may pass 64 bits.
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """lang, part and the count of the most frequent longer phrase that contains it."""
    split = phrases.withColumn("w", F.split("phrase", " ")).filter(F.size("w") >= 3)
    every = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), s -> array_join(slice(w, s, n), ' '))))")
    return split.select("lang", F.explode(F.array_distinct(every)).alias("part"), "a").groupBy("lang", "part").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shard: int = SHARD, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    plain = only(docs, lang=F.coalesce(docs[lang_col].cast("string"), F.lit("und")), text=docs[text_col].cast("string"))
    phrases, totals = frequent_phrases(plain, support, longest, shard)
    covered = inside_longer(phrases).select(F.col("lang").alias("lang_p"), "part", "longer")
    judged = scored(phrases).join(covered, (F.col("lang") == F.col("lang_p")) & (F.col("phrase") == F.col("part")), "left")
    much = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED_PERCENT
    left = judged.filter(~F.coalesce(much, F.lit(False))).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within salts, so that no task sorts all phrases of a language.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    named = totals.select(F.col("lang").alias("lang_n"), "n")
    return ranked.join(named, F.col("lang") == F.col("lang_n")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
