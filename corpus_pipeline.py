"""Corpus pipeline: documents to packed training sequences, each stage written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeqa.llm import decontaminate, language, ngram_join, packing, secrets
from lakeqa.scale import cut_lineage, short_shuffles, small_batches, small_files

# A document whose best language has a smaller calibrated chance is of none.
LEAST_LANGUAGE_SCORE = 0.4
# Texts that go to a worker at once to be tokenized; each distinct word of them is encoded once.
TOKENIZED_BYTES = 4 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that look like no language there is, go."""
    clear = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    with small_batches(spark), small_files(spark):
        found = language.predict(docs, language.learn(docs)).where(clear)
        return cut_lineage(found.select(*[F.col(f"`{c}`") for c in docs.columns]))


def join_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the smallest doc_id stays."""
    with small_batches(spark), short_shuffles(spark):
        return ngram_join.keep_one(docs, words=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    with small_files(spark):
        return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark."""
    with small_files(spark):
        return secrets.redact(docs, secrets.train(docs.select("doc_id", "text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and its place there."""
    with small_batches(spark, TOKENIZED_BYTES):
        return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near copies", join_copies),
    ("benchmark", remove_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

# Trained models and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return rows
