"""Retrieval metrics against gold evidence, latency and cost summaries, report means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import compute_cost, fuzzy_bound, fuzzy_ratio, normalize_path, normalize_text
from rillmark.operators.quantiles import exact_percentiles

K_VALUES = (1, 3, 5, 10)
FUZZY_THRESHOLD = 0.7
DIGITS = 6


def match_gold(retrieved: DataFrame, gold: DataFrame, fuzzy_threshold: float | None = None) -> DataFrame:
    """retrieved (query_id, pos, content, ...) with gold_index: the first gold item (query_id,
    gold_index, normalized_text, file_name) that each row matches, null if none.

    Texts match if one contains the other after normalisation, or (with a threshold) if difflib's
    ratio reaches it; files match only where no text does, by the row's paths and names."""
    names = [c for c in ("table_path", "table_title", "source", "doc_id", "section_path") if c in retrieved.columns]
    rows = retrieved.withColumn("__text", normalize_text(F.col("content"))).withColumn("__names", F.array(*[normalize_path(F.col(c).cast("string")) for c in names]) if names else F.array().cast("array<string>"))
    if "tags" in retrieved.columns:
        rows = rows.withColumn("__names", F.concat("__names", F.transform(F.coalesce("tags", F.array().cast("array<string>")), normalize_path)))
    pairs = rows.select("query_id", "pos", "__text", "__names").join(gold.select("query_id", "gold_index", "normalized_text", "file_name"), "query_id")
    g, d = F.col("normalized_text"), F.col("__text")
    given = F.coalesce(g != "", F.lit(False))
    contained = given & (F.contains(d, g) | F.contains(g, d))
    if fuzzy_threshold is not None:
        open_ = given & ~contained & (fuzzy_bound(g, d) >= fuzzy_threshold)
        pairs = pairs.withColumn("__ratio", fuzzy_ratio(F.when(open_, g), F.when(open_, d)))
        contained = contained | (open_ & (F.col("__ratio") >= fuzzy_threshold))
    by_file = F.coalesce((F.col("file_name") != "") & F.exists("__names", lambda n: F.contains(n, normalize_path(F.col("file_name")))), F.lit(False))
    hits = pairs.withColumn("__hit", contained).withColumn("__file", by_file).groupBy("query_id", "pos").agg(F.coalesce(F.min(F.when(F.col("__hit"), F.col("gold_index"))), F.min(F.when(F.col("__file"), F.col("gold_index")))).alias("gold_index"))
    return retrieved.join(hits, ["query_id", "pos"], "left")


def gold_counts(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """total_gold of every query: gold items with a text or a file."""
    valid = F.count_if((F.coalesce("normalized_text", F.lit("")) != "") | (F.coalesce("file_name", F.lit("")) != ""))
    counts = gold.groupBy("query_id").agg(valid.alias("total_gold"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("total_gold", F.lit(0)).cast("long").alias("total_gold"))


def metrics_at_k(matched: DataFrame, totals: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """query_id, k, precision, recall, covered, full_coverage, hit; zeros for queries without gold."""
    each = matched.select("query_id", "pos", "gold_index").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("pos <= k")
    found = each.groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("n"), F.count("gold_index").alias("relevant"), F.count_distinct("gold_index").alias("covered"))
    grid = totals.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    rows = grid.join(found, ["query_id", "k"], "left").fillna(0, ["n", "relevant", "covered"])
    some = (F.col("total_gold") > 0) & (F.col("n") > 0)
    return rows.select(
        "query_id",
        "k",
        F.when(some, F.round(F.col("relevant") / F.col("n"), DIGITS)).otherwise(0.0).alias("precision"),
        F.when(some, F.round(F.col("covered") / F.col("total_gold"), DIGITS)).otherwise(0.0).alias("recall"),
        F.when(F.col("total_gold") > 0, F.col("covered")).otherwise(0).cast("long").alias("covered"),
        F.when(some & (F.col("covered") >= F.col("total_gold")), 1.0).otherwise(0.0).alias("full_coverage"),
        F.when(some & (F.col("covered") > 0), 1.0).otherwise(0.0).alias("hit"),
    )


def rank_metrics(matched: DataFrame, totals: DataFrame) -> DataFrame:
    """query_id, average_precision, reciprocal_rank, hit; only the first hit of a gold item counts."""
    first = matched.filter("gold_index is not null").groupBy("query_id", "gold_index").agg(F.min("pos").alias("rank"))
    numbered = first.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    found = numbered.groupBy("query_id").agg(F.sum(F.round(F.col("i") / F.col("rank"), 9)).alias("precisions"), F.min("rank").alias("best"))
    rows = totals.join(found, "query_id", "left")
    some = (F.col("total_gold") > 0) & F.col("best").isNotNull()
    return rows.select(
        "query_id",
        F.when(some, F.round(F.col("precisions") / F.col("total_gold"), DIGITS)).otherwise(0.0).alias("average_precision"),
        F.when(some, F.round(1.0 / F.col("best"), DIGITS)).otherwise(0.0).alias("reciprocal_rank"),
        F.when(some, 1.0).otherwise(0.0).alias("hit"),
    )


def summary_at_k(at_k: DataFrame, totals: DataFrame) -> DataFrame:
    """Macro means and the micro evidence recall of each k, over all queries."""
    joined = at_k.join(totals, "query_id")
    return joined.groupBy("k").agg(
        F.round(F.avg("precision"), DIGITS).alias("precision"),
        F.round(F.avg("recall"), DIGITS).alias("recall"),
        F.round(F.avg("full_coverage"), DIGITS).alias("full_coverage"),
        F.round(F.avg("hit"), DIGITS).alias("hit"),
        F.round(F.coalesce(F.sum("covered") / F.nullif(F.sum("total_gold"), F.lit(0)), F.lit(0.0)), DIGITS).alias("evidence_recall"),
    )


def latency_summary(records: DataFrame, latency: str, prompt: str, completion: str, price_in: float = 0.0008, price_out: float = 0.004, accuracy: int | None = None) -> DataFrame:
    """One row: count, mean, 50th, 90th and 99th percentile of latency, tokens and costs.

    Percentiles are exact and interpolated (``quantiles.exact_percentiles``); with ``accuracy`` they are of
    a sketch, in one pass (relative rank error 1 / accuracy)."""
    cost = compute_cost(F.col(prompt), F.col(completion), price_in, price_out)
    shares = {p: p / 100 for p in (50, 90, 99)}
    sketched = [] if accuracy is None else [F.round(F.percentile_approx(F.col(latency).cast("double"), s, accuracy), 4).alias(f"p{p}_ms") for p, s in shares.items()]
    one = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(latency), 4).alias("avg_ms"),
        *sketched,
        F.sum(F.col(prompt) + F.col(completion)).cast("long").alias("total_tokens"),
        F.round(F.sum(cost), 4).alias("total_cost"),
        F.round(F.avg(cost), DIGITS).alias("avg_cost"),
    )
    if accuracy is None:
        exact = exact_percentiles(records, latency, list(shares.values()))
        one = one.crossJoin(exact.agg(*[F.round(F.max(F.when(F.col("share") == s, F.col(latency))), 4).alias(f"p{p}_ms") for p, s in shares.items()]))  # one row each
    return one.select("n", "avg_ms", *[f"p{p}_ms" for p in shares], "total_tokens", "total_cost", "avg_cost")


def token_totals(records: DataFrame, by: list[str], prompt: Column, completion: Column, price_in: float = 0.0008, price_out: float = 0.004) -> DataFrame:
    """by, tokens, cost: the tokens of each group's calls, and what they cost."""
    cost = F.round(F.sum(compute_cost(prompt, completion, price_in, price_out)), DIGITS)
    return records.groupBy(*by).agg(F.sum(prompt + completion).cast("long").alias("tokens"), cost.alias("cost"))


def chat_statistics(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, exchanges (pairs of turns) and n_roles of each chat."""
    return turns.groupBy(key).agg(F.floor(F.count(F.lit(1)) / 2).alias("exchanges"), F.count_distinct("role").alias("n_roles"))


def query_details(matched: DataFrame, totals: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """One row a query: its rank metrics, metrics at every k, and its list with the gold each row matches."""
    at_k = metrics_at_k(matched, totals, ks)
    fields = ("k", "precision", "recall", "covered", "full_coverage", "hit")
    each = at_k.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("at_k"))
    shown = [c for c in ("pos", "id", "score", "doc_id", "gold_index") if c in matched.columns]
    lists = matched.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("retrieved"))  # top_k rows a query
    return rank_metrics(matched, totals).join(totals, "query_id").join(each, "query_id").join(lists, "query_id", "left")


def throughput(done: int, total: int | None, seconds: float) -> str:
    """A progress line: chunks, chunks a second, and the seconds left if the total is known."""
    rate = done / seconds if seconds > 0 else 0.0
    left = f", {(total - done) / rate:.0f} s left" if total is not None and rate > 0 else ""
    return f"{done}{'' if total is None else f'/{total}'} chunks, {rate:.1f} chunks/s{left}"


def numeric_means(results: DataFrame) -> DataFrame:
    """Mean of each numeric column, NaN skipped: one row."""
    kinds = {"int", "bigint", "float", "double"}
    return results.agg(*[F.round(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))), DIGITS).alias(c) for c, kind in results.dtypes if kind in kinds])


def compare_top_k(matched: DataFrame, totals: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row for each top_k: the retrieval metrics of lists cut there, without retrieving again."""
    return summary_at_k(metrics_at_k(matched, totals, ks), totals).withColumnRenamed("k", "top_k")
