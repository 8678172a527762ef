"""Question answering over a collection, for all questions at once."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark import providers
from rillmark.config import RetrievalConfig
from rillmark.operators import postprocess, prompts, search


log = logging.getLogger(__name__)


def _text_leg(points: DataFrame, asked: DataFrame, leg: int, config: RetrievalConfig, text_leg: Callable[[DataFrame, int], DataFrame] | None) -> DataFrame | None:
    """The text leg's rows, or None if it fails: a search then goes on with the dense leg alone.

    A leg that is passed in may be a service or a stored index, so its rows (``leg`` a query) are made at
    once, where a failure can still be met."""
    try:
        if text_leg is not None:
            return text_leg(asked, leg).select("query_id", "id", "pos").checkpoint()
        return search.text_match(points, asked, leg) if config.text_mode == "match" else search.bm25(points, asked, leg)
    except Exception:
        log.warning("the text leg failed; dense search alone", exc_info=True)
        return None


def retrieve(points: DataFrame, queries: DataFrame, config: RetrievalConfig, keywords: list[str] | None = None, reranker: Callable[[], providers.Reranker] | None = None, text_leg: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Lists of points for queries (query_id, query, query_vec): filtered, fused, boosted, topped up
    with tables, routed, balanced, reranked and cut.

    Candidates are found on identifiers and vectors alone; what else a point holds is joined to the
    few rows that remain.  ``text_leg`` (queries, number of rows) takes the place of the text search over the
    points, as ``Collection.text_match`` does with its stored lists."""
    points = search.named_vector(points, config.vector_name)
    hybrid = config.hybrid_search and (text_leg is not None or bool({"content", "tokens"} & set(points.columns))) and "query" in queries.columns  # else dense alone
    fetch = search.pool_size(config.top_k)
    leg = max(fetch, config.hybrid_prefetch)
    asked = search.company_filter(queries).withColumn("targets", postprocess.route_sections(F.col("query")))
    text = _text_leg(points, asked, leg, config, text_leg) if hybrid else None
    found = search.dense_topk(points.select("id", "vector", "source"), asked, fetch if text is None else leg, config.score_threshold)
    if text is not None:
        found = search.rrf([found, text], fetch)
    title, path = (F.col(c) if c in points.columns else F.lit(None).cast("string") for c in ("table_title", "table_path"))
    points = points.withColumn("table_path", postprocess.table_path(F.col("type"), path, title)) if "type" in points.columns else points
    payload = points.drop("vector", "tokens", "query", "targets", "score", "original_score", "pos", "query_id")
    rows = found.join(payload, "id").join(asked.select("query_id", "query", "targets"), "query_id").withColumn("original_score", F.col("score"))
    rows = postprocess.boost(rows, keywords)
    rows = postprocess.table_topup(rows, payload.filter("type = 'table'"), fetch, dedupe=config.dedupe_tables)
    lost = asked.select("query_id", F.col("query").alias("__q"), F.col("targets").alias("__t"))
    rows = rows.join(lost, "query_id").withColumns({"query": F.col("__q"), "targets": F.col("__t")}).drop("__q", "__t")
    rows = postprocess.balance_companies(postprocess.filter_sections(rows, fetch), fetch)
    if reranker is not None and config.rerank_top_n > 0:
        rows = postprocess.rerank(rows, providers.rerank_scores(rows, reranker, config.rerank_top_n), config.rerank_top_n)
    return rows.filter(F.col("pos") <= config.top_k)


def contexts(rows: DataFrame, config: RetrievalConfig) -> DataFrame:
    """query_id, contexts after the adaptive filter (if on) and the limit."""
    kept = postprocess.adaptive_filter(rows, config.adaptive_min_keep, config.max_chunks_per_doc, config.adaptive_score_ratio, config.adaptive_score_drop) if config.adaptive else rows
    return prompts.collect_contexts(kept, config.final_contexts)


def answer(points: DataFrame, queries: DataFrame, config: RetrievalConfig, generator: Callable[[], providers.Generator] = providers.EchoGenerator, **more) -> DataFrame:
    """query_id, query, contexts, messages, answer, model, usage; a question without rows is asked
    without contexts."""
    found = contexts(retrieve(points, queries, config, **more), config)
    rows = queries.select("query_id", "query").join(found, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return providers.generate(rows.withColumn("messages", prompts.messages(F.col("query"), F.col("contexts"))), generator)
