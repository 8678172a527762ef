"""Exact percentiles by selection, without a buffer of all values in any task.

A sketch of fixed size brackets the two ranks that a percentile lies between, a count of the rows below and
inside proves the bracket (or widens it to everything), and what is inside is bracketed again, until
FEW distinct values are left; those are ranked.  Rows are filtered and counted where they are; what a task
holds is a sketch, or the counts of distinct values of a bracket that has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a bracket that are ranked in one window; accuracy of the sketch.
FEW, ACCURACY = 10_000, 1000
MOST_ROUNDS = 24


def _between(low: Column, high: Column, share: Column) -> Column:
    """The value ``share`` of the way; equal ends (infinite ones too) stay as they are."""
    return F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share)


def exact_percentiles(rows: DataFrame, value: str, shares: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, share, value): the interpolated percentile of each share from 0 to 1, as SQL's
    ``quantile_cont``: nulls are left out, NaN is larger than all, a group without values has none."""
    keys = list(groups or [])
    names = [f"__g{i}" for i in range(len(keys))]
    data = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    n_keys = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names] + [F.col(n).isNull() for n in names]
    data = data.withColumn("__key", F.struct(*n_keys) if names else F.lit(0))  # null is a group of its own
    size = data.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), *[F.first(n).alias(n) for n in names])
    ranks = size.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("rank", F.col("share") * (F.col("n") - 1))
    ranks = ranks.select("__key", *names, "share", F.floor("rank").alias("first"), F.ceil("rank").alias("last"), (F.col("rank") - F.floor("rank")).alias("part"))
    # open: the rows of each bracket, and the number of rows below it
    state = ranks.select("__key", "share", "first", "last", F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    for _ in range(MOST_ROUNDS):
        inside = _inside(data, state)
        most = inside.groupBy("__key", "share").agg(F.approx_count_distinct("__v").alias("d")).agg(F.max("d")).first()[0]
        if most is None or most <= FEW:
            break
        state = _narrower(inside, state)
    counts = _inside(data, state).groupBy("__key", "share", "__v").agg(F.count(F.lit(1)).alias("c"), F.first("below").alias("below"))
    w = Window.partitionBy("__key", "share").orderBy("__v")
    reached = counts.withColumn("upto", F.col("below") + F.sum("c").over(w))
    met = ranks.join(reached.select("__key", "share", "__v", "upto", "c"), ["__key", "share"])
    at = lambda rank: F.min(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("c") <= F.col(rank)), F.col("__v")))
    found = met.groupBy("__key", "share").agg(at("first").alias("a"), at("last").alias("b"), F.first("part").alias("part"), *[F.first(n).alias(n) for n in names])
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "share", _between(F.col("a"), F.col("b"), F.col("part")).alias(value))


def _inside(data: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of each open bracket, with its state."""
    within = (F.col("low").isNull() | (F.col("__v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("__v") <= F.col("high")))
    return data.select("__key", "__v").join(state, "__key").filter(within)


def _narrower(inside: DataFrame, state: DataFrame) -> DataFrame:
    """Brackets from a sketch of what is inside, where the counts prove them."""
    here = ["__key", "share"]
    grid = [i / 64 for i in range(65)]
    sketch = inside.groupBy(*here).agg(F.percentile_approx("__v", grid, ACCURACY).alias("cuts"), F.count(F.lit(1)).alias("held"))
    aim = lambda rank: (F.col(rank) - F.col("below")) / F.col("held") * 64
    ends = state.join(sketch, here)
    ends = ends.withColumn("new_low", F.element_at("cuts", F.greatest(F.lit(1), F.floor(aim("first")).cast("int"))))
    ends = ends.withColumn("new_high", F.element_at("cuts", F.least(F.lit(65), F.ceil(aim("last")).cast("int") + 2)))
    tested = inside.join(ends.select(*here, "new_low", "new_high"), here)
    counted = tested.groupBy(*here).agg(F.count_if(F.col("__v") < F.col("new_low")).alias("under"), F.count_if((F.col("__v") >= F.col("new_low")) & (F.col("__v") <= F.col("new_high"))).alias("held"), F.first("new_low").alias("new_low"), F.first("new_high").alias("new_high"))
    proved = state.join(counted, here)
    good = (F.col("below") + F.col("under") <= F.col("first")) & (F.col("last") < F.col("below") + F.col("under") + F.col("held"))
    rows = proved.select(*here, "first", "last", F.when(good, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("below"), F.when(good, F.col("new_low")).otherwise(F.col("low")).alias("low"), F.when(good, F.col("new_high")).otherwise(F.col("high")).alias("high"))
    # a few numbers a group and share: kept as rows so that later rounds don't repeat the earlier ones
    return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows
