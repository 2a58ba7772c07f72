"""Posts, stored verdicts and model answers derived from the test tables.

documents are the posts. labels play the verdicts that exist already: a
labelled document was decided by people. Model answers are derived from every
document: the word rule's verdict with the document's whole text as its reason,
bent into one of twenty kinds (see bent_answers).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.urls import permalink
from siftwell.functions.words import dictionary, found_words, lowered
from siftwell.operators.items import assign_chunks, resolve_ids
from siftwell.operators.responses import parse_responses
from siftwell.operators.scoring import score_rules
from siftwell.schemas import ANSWERS
from siftwell.session import new_folder
from siftwell.sinks.publish import published
from siftwell.sources.responses import scan_responses
from siftwell.sources.store import VerdictStore
from siftwell.spec import AuditSpec, Criteria, UrlSpec

WORDS = ["license", "token", "apache", "mit"]
CHUNKS = 5
MANY_CHUNKS = 500
PART_ROWS = 500
SMALL_PART_ROWS = 40
KINDS = 20

SPEC = AuditSpec(
    criteria=Criteria(
        forbidden_words=WORDS,
        topics_to_exclude=["Legal notices", "Access data"],
        tone_requirements=["Plain language"],
        additional_instructions="Look for 100% of the words above",
    ),
    url=UrlSpec(user="reviewer", base_url="https://posts.example/{user}/status/{id}"),
    number_of_chunks=CHUNKS,
)
#: The same for posts that fill four of fifty chunks.
FEW_FULL = dataclasses.replace(SPEC, number_of_chunks=50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id_str"),
        F.lit(None).cast("string").alias("id"),
        F.col("text").alias("item_text"),
        F.lit("documents").alias("src_file"),
        F.col("doc_id").alias("pos"),
        "lang",
        "source",
    )


def items(spark: SparkSession, sf_dir: str, n: int = CHUNKS) -> DataFrame:
    return assign_chunks(resolve_ids(posts(spark, sf_dir)), n)


def as_answers(df: DataFrame) -> DataFrame:
    """Fills up the answer layout with nulls."""
    return df.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in ANSWERS.fields
        ]
    )


def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("item_id", F.col("doc_id").cast("string"))
    deletion = F.when(F.col("toxic") == 1, "DELETE").otherwise("KEEP")
    reason = F.concat(F.lit("label, quality "), F.col("quality").cast("string"))
    verdict = F.struct(
        F.array().cast("array<string>").alias("explicit_words"),
        reason.alias("reason_for_flag"),
        F.array().cast("array<string>").alias("topic_of_tweet"),
        deletion.alias("deletion"),
    )
    return as_answers(
        labels.select(
            "item_id",
            permalink(F.col("item_id"), SPEC.url).alias("item_url"),
            F.array().cast("array<string>").alias("explicit_words"),
            reason.alias("reason"),
            F.array().cast("array<string>").alias("topics"),
            deletion.alias("deletion"),
            F.create_map().cast("map<string,string>").alias("extras"),
            F.to_json(verdict).alias("raw"),
            F.pmod("doc_id", F.lit(CHUNKS)).alias("chunk_id"),
            F.struct(F.lit("labels").alias("file"), F.lit(0).alias("block"), F.col("doc_id").alias("row")).alias("ord"),
        )
    )


def new_store(spark: SparkSession) -> VerdictStore:
    return VerdictStore.open(spark, new_folder(spark, "store"))


def warm_store(spark: SparkSession, sf_dir: str) -> VerdictStore:
    """A store that holds the labelled documents."""
    store = new_store(spark)
    store.append(label_verdicts(spark, sf_dir), "r0-labels")
    return store


def _envelope(key, url, answer):
    response = F.struct(
        F.array(F.struct(F.struct(F.array(F.struct(answer.alias("text"))).alias("parts")).alias("content"))).alias(
            "candidates"
        )
    )
    fields = ([key.alias("key")] if key is not None else []) + ([url.alias("tweet_url")] if url is not None else [])
    return F.to_json(F.struct(*fields, response.alias("response")))


def bent_answers(items: DataFrame) -> DataFrame:
    """chunk_id and value: what a model service might answer to each post.

    The kind is the position modulo 20:
    0 fenced, 1 prose around, 2 no decision, 3 not JSON, 4 two objects,
    5 no candidates, 6 line without key, 7 empty line, 8 line is not JSON,
    9 decision is null, 10 decision N/A, 11 no link, 12 two lines with opposite
    decisions, 13 extra keys, 14 text where a list belongs, others clean.
    """
    url = permalink(F.col("item_id"), SPEC.url)
    words = F.col("words")
    flagged = F.when(F.size(words) > 0, "DELETE").otherwise("KEEP")
    opposite = F.when(F.size(words) > 0, "KEEP").otherwise("DELETE")
    topics = F.array("lang", "source")

    def verdict(deletion, explicit=words, *more):
        fields = [explicit.alias("explicit_words"), F.col("item_text").alias("reason_for_flag"), topics.alias("topic_of_tweet")]
        fields += [deletion.alias("deletion")] if deletion is not None else []
        return F.to_json(F.struct(*fields, *more), {"ignoreNullFields": "false"})

    clean = verdict(flagged)
    extra = [F.lit(0.5).alias("confidence"), F.struct(F.lit("a").alias("by"), F.array(F.lit(1)).alias("at")).alias("note")]
    answers = {
        0: F.concat(F.lit("```json\n"), clean, F.lit("\n```")),
        1: F.concat(F.lit("This is how I see it:\n"), clean, F.lit("\nThat would be all.")),
        2: verdict(None),
        3: F.lit("{ a sentence in braces }"),
        4: F.concat(clean, F.lit(" and "), clean),
        9: verdict(F.lit(None).cast("string")),
        10: verdict(F.lit("N/A")),
        13: verdict(flagged, words, *extra),
        14: verdict(flagged, F.lit("none")),
    }
    kind = F.pmod("pos", F.lit(KINDS))
    bent = clean
    for k, text in answers.items():
        bent = F.when(kind == k, text).otherwise(bent)
    key, answer = F.col("item_id"), F.col("answer")
    line = (
        F.when(kind == 5, F.concat(F.lit('{"key":"'), key, F.lit('","tweet_url":"'), url, F.lit('","response":{"candidates":[]}}')))
        .when(kind == 6, _envelope(None, url, answer))
        .when(kind == 7, F.lit(""))
        .when(kind == 8, F.concat(F.lit('{"key":"'), key))
        .when(kind == 11, _envelope(key, None, answer))
        .when(kind == 12, F.concat(_envelope(key, url, answer), F.lit("\n"), _envelope(key, url, verdict(opposite))))
        .otherwise(_envelope(key, url, answer))
    )
    low = items.withColumn("lower", lowered(F.col("item_text")))
    worded = low.withColumn("words", found_words(F.col("lower"), dictionary(WORDS)))
    return worded.withColumn("answer", bent).select("chunk_id", line.alias("value"))


def answer_folder(spark: SparkSession, items: DataFrame) -> str:
    """Writes the answers as one folder of lines per chunk."""
    path = new_folder(spark, "answers")
    bent_answers(items).write.partitionBy("chunk_id").text(path)
    return path


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_responses(spark, answer_folder(spark, items(spark, sf_dir)))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_responses(responses(spark, sf_dir), SPEC.criteria.digest)


def bent_scorer(pending: DataFrame, folder: str) -> DataFrame:
    """Stands for a model service that gives the bent answers."""
    spark = pending.sparkSession
    return parse_responses(scan_responses(spark, answer_folder(spark, pending)), SPEC.criteria.digest)


def archive(spark: SparkSession, sf_dir: str, part_rows: int = PART_ROWS) -> str:
    """The documents as archive files of at most part_rows posts each."""
    path = f"{new_folder(spark, 'archive')}.js"
    tweet = F.struct("id_str", F.col("id_str").alias("id"), F.col("item_text").alias("full_text"))
    post = F.to_json(F.struct(tweet.alias("tweet")))
    part = F.floor(F.col("pos") / part_rows)
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "post"))), lambda s: s["post"]), ",\n")
    (
        posts(spark, sf_dir)
        .select("pos", post.alias("post"), part.alias("part"))
        .groupBy("part")
        .agg(F.concat(F.lit("window.posts.part = [\n"), inner, F.lit("\n]\n")).alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    return path


def report_files(spark: SparkSession, sf_dir: str) -> str:
    """A CSV file per chunk: the first with link and decision, the others with more columns, in other orders."""
    folder = new_folder(spark, "reports")
    # Posts are scored by all tasks; what one task writes a chunk's file from are its narrow rows only.
    narrow = score_rules(items(spark, sf_dir), SPEC.criteria, SPEC.url).select(
        F.col("item_url").alias("tweet_url"), "deletion", F.col("reason").alias("more"), F.col("item_id").alias("id"), "chunk_id"
    )
    scored = new_folder(spark, "scored-rows")
    narrow.write.partitionBy("chunk_id").parquet(scored)
    rows = spark.read.schema(narrow.schema).parquet(scored)
    headers = [["tweet_url", "deletion"], ["deletion", "more", "tweet_url"], ["id", "tweet_url"], ["more", "deletion", "id", "tweet_url"], ["deletion", "tweet_url"]]
    for k in range(CHUNKS):
        own = rows.where(F.col("chunk_id") == k).select(*headers[k])
        # Each is one file by its nature, as other tools leave it.
        published(spark, f"{folder}/report_chunk_{k}.csv", lambda f, own=own: own.coalesce(1).write.option("header", True).csv(f), single=True)
    return folder


#: What a driver that dies in the middle says.
LOST = "the service's machine was lost"


def dying_client_factory():
    """Makes clients as rule_client_factory does, but for the first partition, whose job it ends."""
    make, lost = rule_client_factory(), LOST

    def factory():
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0:
            raise RuntimeError(lost)
        return make()

    return factory


def no_time() -> float:
    return 0.0


class BusyService:
    """Makes clients of a service that is too busy for chunk 1 until it was waited for once, for chunk 2 always, and broken for chunk 3."""

    def __init__(self) -> None:
        self.waits = 0

    def wait(self, seconds: float) -> None:
        self.waits += 1

    def __call__(self):
        rule, waits, chunks = rule_client_factory()(), self.waits, CHUNKS

        class Client:
            def run_batch(self, lines):
                import json

                chunk = int(json.loads(lines[0])["key"]) % chunks
                if chunk == 2 or (chunk == 1 and not waits):
                    raise RuntimeError("429 too busy")
                if chunk == 3:
                    raise ValueError("broken")
                return rule.run_batch(lines)

        return Client()


def rule_client_factory():
    """Makes local clients for the word rule that answer line by line."""
    words = list(WORDS)

    class RuleClient:
        def run_batch(self, lines):
            import json
            import re

            answers = []
            for line in lines:
                request = json.loads(line)
                prompt = request["request"]["contents"][0]["parts"][0]["text"]
                text = prompt.split('Tweet: "', 1)[1].rsplit('"\n\n        Criteria for flagging', 1)[0]
                seen = set(re.findall(r"[^\W_]+", text.lower()))
                found = [w for w in words if w in seen]
                verdict = {
                    "explicit_words": found,
                    "reason_for_flag": "rule",
                    "topic_of_tweet": [],
                    "deletion": "DELETE" if found else "KEEP",
                }
                part = {"text": json.dumps(verdict)}
                response = {"candidates": [{"content": {"parts": [part]}}]}
                answers.append(
                    json.dumps({"key": request["key"], "tweet_url": request["tweet_url"], "response": response})
                )
            return answers

    return RuleClient
