"""Connected components of an edge table by alternating large-star and small-star steps.

Each step hangs neighbours on the smallest one, so the edges end as one star a component.  Only
joins and partially aggregated minima are used: no neighbourhood is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.shared import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, component): every node of an edge with the smallest node it reaches."""
    edges = materialize(edges.filter("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "edges")
    state = None
    while True:
        before, edges = edges, materialize(_small_star(_large_star(edges)), "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
