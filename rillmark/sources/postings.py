"""A stored inverted index: for each token the numbers of the points that hold it, in blocks.

Points are numbered within the write that stores them (``segment``, ``number``).  A token's list is cut where
the number passes a multiple of BLOCK; a block holds its numbers as differences from its beginning, in
order, as small integers.  Blocks are stored by bucket and sorted by token, so that a search reads the
row groups of its tokens, and a block is found by (segment, token, block) without reading others.

A search starts from the rarest token of each question.  Only that token's numbers are spelled out; each
asks one block of each other token, so the rows that are joined number about as many as the rarest list
has, times the question's tokens, however common the others are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.text import index_tokens

BLOCK = 4096
#: Tokens that are broadcast.
MOST_TOKENS = 500_000
KEY = ["segment", "token", "block"]


def build(points: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(*keep, segment, token, block, n, offsets) of points (segment, number, tokens).

    A list's block has BLOCK numbers at most, so no group grows with the points."""
    keep = keep or []
    each = points.select(*keep, "segment", F.explode("tokens").alias("token"), F.floor(F.col("number") / BLOCK).alias("block"), (F.col("number") % BLOCK).cast("short").alias("at"))
    lists = each.groupBy(*keep, *KEY).agg(F.sort_array(F.collect_list("at")).alias("offsets"))
    return lists.select(*keep, *KEY, F.size("offsets").alias("n"), "offsets")


def rarest_first(blocks: DataFrame, queries: DataFrame, query_col: str = "query") -> tuple[DataFrame, DataFrame]:
    """(query_id, token) of each query's rarest token, and (query_id, token, n_others) of its other ones; a
    query with a token that no list has is left out, as it has no results."""
    each = queries.select("query_id", F.explode(index_tokens(F.col(query_col))).alias("token"))
    counts = blocks.join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
    known = each.join(counts, "token", "left").groupBy("query_id").agg(F.min(F.struct("df", "token")).alias("least"), F.count(F.lit(1)).alias("n"), F.count("df").alias("found")).filter("n = found")
    first = known.select("query_id", F.col("least.token").alias("token"))
    others = each.join(known.select("query_id", F.col("least.token").alias("rarest"), (F.col("n") - 1).alias("n_others")), "query_id").filter("token <> rarest").drop("rarest")
    return first, others


def match(blocks: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """(query_id, segment, number) of the points that hold every index token of a query."""
    tokens = queries.select(F.explode(index_tokens(F.col(query_col))).alias("token")).distinct()
    if tokens.count() <= MOST_TOKENS:  # only the lists asked for are moved
        blocks = blocks.join(F.broadcast(tokens), "token", "left_semi")
    first, others = rarest_first(blocks, queries, query_col)
    lists = blocks.join(first, "token").select("query_id", "segment", "block", F.explode("offsets").alias("at"))
    asked = lists.join(others, "query_id", "left")  # one row for each other token; one without, if there is none
    met = asked.filter("token IS NOT NULL").join(blocks.select(*KEY, "offsets"), KEY).filter(F.array_contains("offsets", F.col("at")))
    whole = met.groupBy("query_id", "segment", "block", "at").agg(F.count(F.lit(1)).alias("c"), F.max("n_others").alias("n")).filter("c = n")
    alone = asked.filter("token IS NULL")
    hits = whole.select("query_id", "segment", "block", "at").unionByName(alone.select("query_id", "segment", "block", "at"))
    return hits.select("query_id", "segment", (F.col("block") * BLOCK + F.col("at")).alias("number"))
