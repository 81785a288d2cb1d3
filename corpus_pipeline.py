"""The training-data pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlens.llm import decontamination, jaccard_join, language_id, lm_scoring, packing, substring_dedup
from facetlens.llm.common import stage
from facetlens.llm.queries import BYTE_BPE

#: Texts whose nearest profile is farther than this share of the largest distance allows are rejected.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without a letter and texts like none of them go."""
    learn = lm_scoring.split_remainder(docs["doc_id"]) != 0
    found = language_id.identify(docs, language_id.profiles(docs, learn), docs.columns, names=("__lang", "__score"))
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).drop("__lang", "__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has."""
    return substring_dedup.without_passages(docs, stage(substring_dedup.passages(docs), "passages"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens."""
    return packing.packed_digest(docs, BYTE_BPE, 2048, 1)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Rank orders, chains and searches have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
