"""The corpus pipeline: documents through five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.llm import decontamination, line_dedup, near_dups, packing, quality
from brinework.llm.shared import Kept, read_table, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokens_by_bytes("text"), cluster=F.col("text"), source=F.col("source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Sketch quantiles, edit joins and best-fit search have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage put aside goes once its documents are written."""
    kept = Kept(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):
            made = stage(spark, before, sf_dir)
            docs = kept.put(made, aside=False)
        kept.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
