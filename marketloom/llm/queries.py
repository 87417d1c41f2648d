"""Registered queries of this folder: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import (
    bpe_codec, bpe_count, cap_dedup, decontaminate, fingerprints, hard_negatives, license_scan, line_dedup, mixing, simhash_dedup, suffix_dedup, toxicity,
    vector_codes,
)
from marketloom.llm.shipping import ship


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sizes(_table(spark, folder, "documents"))
    return mixed.withColumn("n_shards", F.size("shard_words")).drop("shard_words")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_table(spark, folder, "documents")).drop("places")


def op4_cap_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cap_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.token_counts(_table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents"), with_text=False)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.document_tokens(_table(spark, folder, "documents"))


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, folder, "documents"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, folder, "embeddings"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_source_mix, op3_license_scan, op4_cap_dedup, op5_fingerprints, op6_line_dedup, op7_token_counts, op8_suffix_dedup, op9_byte_bpe, op10_simhash_dedup,
        op11_decontamination, op12_hard_negatives, op13_vector_codes)
}
ORACLES: dict[str, str] = {
    "op11_decontamination": decontaminate.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_vector_codes": vector_codes.ORACLE,
}
