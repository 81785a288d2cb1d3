"""Registered queries of this package and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlens.llm.chat_format import SQL as CHAT_SQL
from facetlens.llm.hard_negatives import SQL as NEGATIVES_SQL
from facetlens.llm.merkle_manifest import SQL as MERKLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark, sf_dir):
    from facetlens.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, 512)


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    from facetlens.llm.lm_scoring import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark, sf_dir):
    from facetlens.llm.language_id import identify, profiles
    from facetlens.llm.lm_scoring import split_remainder

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", split_remainder(docs["doc_id"]) == 0)
    return identify(docs, profiles(docs, ~docs["held_out"]), ["doc_id", "held_out"])


@query("op4_decontamination")
def op4(spark, sf_dir):
    from facetlens.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_chat_format", CHAT_SQL)
def op5(spark, sf_dir):
    from facetlens.llm.chat_format import digest

    trick = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trick), (-7, 1, "assistant", trick)], "conv_id long, turn long, role string, text string")
    return digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


@query("op6_packing")
def op6(spark, sf_dir):
    from facetlens.llm.packing import packed_digest

    return packed_digest(table(spark, sf_dir, "documents"), BYTE_BPE, 2048, 1)


@query("op7_jaccard_join")
def op7(spark, sf_dir):
    from facetlens.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 5, 75)


@query("op8_rans_files")
def op8(spark, sf_dir):
    from facetlens.llm.rans_files import read_files, write_files

    return read_files(write_files(table(spark, sf_dir, "documents"), BYTE_BPE, 0))


@query("op9_quality_rules")
def op9(spark, sf_dir):
    from facetlens.llm.quality_rules import apply_rules, train

    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op10_substring_dedup")
def op10(spark, sf_dir):
    from facetlens.llm.substring_dedup import passages

    return passages(table(spark, sf_dir, "documents"), 50)


@query("op11_license_scan")
def op11(spark, sf_dir):
    from facetlens.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark, sf_dir):
    from facetlens.llm.merkle_manifest import audit, seventh

    docs = table(spark, sf_dir, "documents")
    return audit(docs, seventh(docs["doc_id"]))


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark, sf_dir):
    from facetlens.llm.hard_negatives import mine, relabelled

    return mine(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)
