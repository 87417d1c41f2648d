"""A training corpus from raw documents: clean, without repeated lines and near-duplicates, mixed by source, as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe_codec, line_dedup, mixing, simhash_dedup, toxicity
from marketloom.llm.scratch import put
from marketloom.llm.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; learnt from the labelled documents outside the held-out part."""
    ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; a text of which no line stays is empty, and its document stays."""
    ship(spark)
    return line_dedup.strip_lines(docs).drop("_lines", "_removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest number of each group of near-duplicates."""
    ship(spark)
    return simhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    ship(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether decoding the ids gives the text again."""
    ship(spark)
    coded = bpe_codec.encode_texts(docs.select("doc_id", "lang", "source", "text"), round_trip="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: A trained classifier decides in the first stage, so SQL cannot express the rows; the tests hold each stage against the operator it calls, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = put(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
