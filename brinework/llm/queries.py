"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, langid, line_dedup, near_dups, oracles, packing, pii, pseudo_likelihood, quality, sharding
from .shared import read_table

LANG_FOLD = 2


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == LANG_FOLD
    held = F.coalesce(fold, F.lit(False))
    known = langid.profiles(docs.filter(~held))
    out = langid.identify(docs.select("doc_id", "text"), known)
    again = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == LANG_FOLD, F.lit(False))
    return out.select("doc_id", again.alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judged(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), packing.tokens_by_bytes("text"), cluster=F.col("text"), source=F.col("source"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_chats(turns.withColumn("parts", chat.text_parts("text"))))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(read_table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii, op2_near_duplicates, op3_line_dedup, op4_language_id, op5_quality_rules, op6_best_fit_packing, op7_chat_formatting,
        op8_sharding, op9_decontamination, op10_pseudo_likelihood,
    )}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
