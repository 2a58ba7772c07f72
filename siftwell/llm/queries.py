"""The operators applied to whole test tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import chat, collocations, conversation_repair, decontamination, language_id, main_text, near_dup, packing, quality, secret_scan, substring_dedup, token_file, warc
from siftwell.llm.frames import crc32_text, table, written
from siftwell.session import new_folder

SEQUENCE_TOKENS = 4096


def op1_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = token_file.token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    path = new_folder(spark, "token-file")
    token_file.write_tokens(written(ids, "token-ids", "uncompressed"), path)
    return token_file.read_index(spark, path)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_headers(spark, path)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS, 1)


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    whole = chat.formatted(turns.unionByName(extra))
    read = whole.select("conv_id", chat.text_of(F.col("segments")).alias("text"), chat.learned_of(F.col("segments")).alias("learned"))
    back = read.select("conv_id", "learned", F.length("text").alias("n"), chat.turns_of(F.col("text")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: Column) -> Column:
    return crc32_text(doc_id) % 3 == 1


def language_network(docs: DataFrame) -> language_id.Network:
    """Fitted on the labelled rows that are not held out."""
    return language_id.fit(docs, ~held_out(docs["doc_id"]))


def op8_byte_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_network(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("measures")
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op10_novelty_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.listed(F.col("spans"), novel=False), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op11_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_path_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.repaired(conversation_repair.damaged(rows), rows.select("conv_id"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rans_token_ids,
        op2_warc_archive,
        op3_best_fit_packing,
        op4_page_differencing,
        op5_tensored_minhash,
        op6_chat_formatting,
        op7_cgk_decontamination,
        op8_byte_language_id,
        op9_quality_rules,
        op10_novelty_secret_scan,
        op11_son_collocations,
        op12_path_repair,
        op13_prefix_suffix_trees,
    )
}
