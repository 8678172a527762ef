"""A training-corpus pipeline over ``documents``: five stages, each an operator of rillmark.llm.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with all columns of
``documents``; the last one returns the encoded documents.  Stages work on all their predecessor
kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import bpe, decontaminate, exact_dedup, jaccard_join, language
from rillmark.llm.shared import materialize

#: A document is rejected if its language cannot be told: no letter, or no language above this share.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; rows without a letter, or without a clear language, go."""
    return language.drop_untold(docs, LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier."""
    return exact_dedup.drop_copies(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by a Jaccard similarity of 0.8 or more."""
    return jaccard_join.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and whether decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded=True)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return both.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("encode", encode),
]

#: The classifier, the near-copy groups and the encoder are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
