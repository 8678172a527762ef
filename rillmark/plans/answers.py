"""Evaluation data sets of answers: build, cache, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "question string, answer string, contexts array<string>, model string, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, ground_truth string, reference string"


def dataset(answers: DataFrame, truths: DataFrame | None = None) -> DataFrame:
    """(question, answer, contexts, model, usage, ground_truth, reference): answers (query_id, query,
    ...) with truths (query_id, ground_truth); truths that are all empty count as none."""
    rows = answers.withColumnRenamed("query", "question")
    if truths is None or not truths.filter("ground_truth <> ''").limit(1).count():
        rows = rows.withColumn("ground_truth", F.lit(None).cast("string"))
    else:
        rows = rows.join(truths.select("query_id", "ground_truth"), "query_id", "left")
    return rows.withColumn("reference", F.col("ground_truth")).select("question", "answer", "contexts", "model", "usage", "ground_truth", "reference")


def write_cache(data: DataFrame, path: str) -> None:
    data.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).json(path)
