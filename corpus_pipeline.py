"""From raw documents to packed sequences: five stages, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of documents. Each calls one operator of siftwell.llm and acts on its findings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontamination, language_id, near_dup, packing, secret_scan
from siftwell.llm.frames import table, written
from siftwell.llm.queries import SEQUENCE_TOKENS, language_network

#: Documents whose best language has less probability than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; a missing lang is filled in."""
    found = language_id.predict(docs, language_network(docs), keep=[c for c in COLUMNS if c != "doc_id"])
    known = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keyed(docs: DataFrame, label: str) -> DataFrame:
    """The rows with a key of their own, written, since ids may be null or shared and keys must not change when read again."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), label)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least doc_id, null last, and of those one. Rows without a word stay."""
    rows = keyed(docs, "near-dedup-rows")
    found = near_dup.deduplicate(rows, id_col="row_key").select(F.col("doc_id").alias("key"), "component_id")
    ranked = found.join(rows.select(F.col("row_key").alias("key"), "doc_id"), "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    kept = ranked.groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias("kept"))
    gone = found.join(kept, F.col("key") == F.col("kept"), "left_anti").select(F.col("key").alias("gone"))
    return rows.join(gone, F.col("row_key") == F.col("gone"), "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    rows = keyed(docs, "decontamination-rows")
    hits = decontamination.find(rows, table(spark, sf_dir, "benchmark"), id_col="row_key")
    hit = hits.select(F.col("doc_id").alias("hit")).distinct()
    return rows.join(hit, F.col("row_key") == F.col("hit"), "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    found = secret_scan.scan(docs, keep=[c for c in COLUMNS if c != "doc_id"])
    text = F.coalesce("clean", "text")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("clean").isNull(), F.col("n_chars")).otherwise(F.length("clean").cast("long")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequence and place that best-fit packing gave them."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS, 1)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packed:
            docs = written(docs, name.replace(" ", "-"))
    return docs


#: The stages learn, hash and search by edit distance, which SQL can't express; tests/llm compares with brute force.
ORACLE_SQL = None
