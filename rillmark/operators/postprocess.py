"""What happens to retrieved rows before they become contexts.

A retrieved list is rows (query_id, pos, id, score, original_score, ...metadata) with the order of
the list in ``pos``; every function returns rows with a new dense ``pos`` from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import blank, first_given

#: Section hints and the words in a question that ask for them.
SECTION_ROUTES = {
    "risk": ["risk factors", "item 1a", "risks"],
    "md&a": ["md&a", "management discussion", "management’s discussion", "item 7"],
    "financials": ["financial statements", "balance sheet", "income statement", "cash flow", "item 8"],
    "controls": ["controls", "internal control", "item 9a"],
    "business": ["business", "item 1"],
    "directors": ["board of directors", "directors", "item 10"],
}
#: Terms that are boosted when no list of terms is given.
DEFAULT_KEYWORDS = [
    "goodwill impairment",
    "non-gaap",
    "non gaap",
    "credit risk",
    "revenue recognition",
    "lease liability",
    "operating lease",
    "deferred revenue",
    "stock-based compensation",
    "tax provision",
    "foreign currency",
    "liquidity",
    "going concern",
    "material weakness",
    "internal control",
    "cybersecurity",
]
TABLE_BOOST, KEYWORD_BOOST, COMPANY_BOOST, SECTION_BOOST, LABEL_BOOST = 1.5, 1.3, 1.4, 2.0, 1.2
DIGITS = 6


def _renumber(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def route_sections(query: Column) -> Column:
    """Target sections of a question: ``item_<x>`` for each item it names, then routes by their words."""
    q = F.lower(query)
    items = F.transform(F.regexp_extract_all(q, F.lit(r"(?U)item\s+(\d+[a-z]?)"), 1), lambda m: F.concat(F.lit("item_"), m))
    routes = F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w)), F.lit(name)) for name, words in SECTION_ROUTES.items()])
    return F.concat(items, F.filter(routes, lambda r: r.isNotNull()))


def _inside(value: Column, query: Column) -> Column:
    """Whether a metadata value occurs in the question."""
    return F.coalesce(F.contains(query, F.lower(blank(value))), F.lit(False))


def boost(rows: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Multiply scores by what a row and its question (``query``, ``targets``) have in common, and sort."""
    q = F.lower("query")
    terms = F.array(*[F.lit(k) for k in (DEFAULT_KEYWORDS if keywords is None else keywords)]).cast("array<string>")
    section = first_given(F.col("section_name"), F.col("section_path"))
    about = _inside(section, q) | F.coalesce(F.exists("targets", lambda t: F.contains(section, t)), F.lit(False))
    label = _inside(first_given(F.col("table_title"), F.col("table_id")), q) | _inside(F.col("row_label"), q) | _inside(F.col("column_label"), q) | _inside(F.col("fiscal_year"), q)
    keyword = (F.coalesce(F.size("keywords_hit"), F.lit(0)) > 0) & F.exists(terms, lambda t: F.contains(q, t))
    factor = (
        F.when(F.col("type") == "table", TABLE_BOOST).otherwise(1.0)
        * F.when(keyword, KEYWORD_BOOST).otherwise(1.0)
        * F.when(_inside(first_given(F.col("company"), F.col("source"), F.col("doc_id")), q), COMPANY_BOOST).otherwise(1.0)
        * F.when(about, SECTION_BOOST).otherwise(1.0)
        * F.when(label, LABEL_BOOST).otherwise(1.0)
    )
    boosted = rows.withColumn("original_score", F.col("score")).withColumn("score", F.round(F.col("score") * factor, DIGITS))
    return _renumber(boosted, F.col("score").desc(), F.col("pos"))


def table_path(kind: Column, path: Column, title: Column, prefix: str = "data/csvs") -> Column:
    """A table's path; one that only has a title gets a path from it."""
    return F.when((kind == "table") & blank(path).isNull() & blank(title).isNotNull(), F.concat(F.lit(f"{prefix}/"), title, F.lit(".csv"))).otherwise(path)


def table_topup(rows: DataFrame, tables: DataFrame, fetch_k: int, enough: int = 3, sample: int = 6, dedupe: bool = False) -> DataFrame:
    """Add table chunks (id, doc_id, page, table_id, ...) of the retrieved documents to lists with
    fewer than ``enough`` tables: up to ``sample`` evenly spaced ones of each document, scored above
    the list's first row.  A table already in the list stays twice unless ``dedupe``."""
    key = first_given(F.col("doc_id"), F.col("source"))
    lists = rows.groupBy("query_id").agg(F.count_if(F.col("type") == "table").alias("n_tables"), F.min_by("score", "pos").alias("top"), F.min_by("original_score", "pos").alias("top_original")).filter(F.col("n_tables") < enough)
    wanted = rows.withColumn("key", key).filter(blank(F.col("key")).isNotNull()).groupBy("query_id", "key").agg(F.min("pos").alias("doc_pos")).join(lists, "query_id")
    first = tables.withColumn("scroll", F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))).filter(F.col("scroll") <= fetch_k)
    joined = wanted.join(first, wanted.key == first.doc_id)
    w = Window.partitionBy("query_id", "key")
    ranked = joined.withColumn("i", F.row_number().over(w.orderBy(F.coalesce("page", F.lit(0)), F.coalesce("table_id", F.lit("")), "scroll")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(sample - 1)), lambda j: F.round(j * (F.col("n") - 1) / (sample - 1)).cast("int"))
    idx = F.when(F.col("n") <= sample, F.col("i")).otherwise(F.array_position(places, F.col("i")) - 1)
    picked = ranked.withColumn("idx", idx).filter("idx >= 0")
    added = picked.withColumn("score", F.round(F.col("top") + 1.0 - F.col("idx") * 0.01, DIGITS)).withColumn("original_score", F.round(F.col("top_original") + 1.0 - F.col("idx") * 0.01, DIGITS))
    added = added.select("query_id", F.lit(1).alias("added"), (F.col("doc_pos") * sample + F.col("idx")).cast("int").alias("pos"), *[F.col(c) if c in added.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("query_id", "pos")])
    both = rows.select("query_id", F.lit(0).alias("added"), "pos", *[c for c in rows.columns if c not in ("query_id", "pos")]).unionByName(added)
    if dedupe:
        once = Window.partitionBy("query_id", "id").orderBy("added", "pos")
        both = both.withColumn("once", F.row_number().over(once)).filter("once = 1").drop("once")
    return _renumber(both, F.col("score").desc(), F.col("added"), F.col("pos")).drop("added")


def filter_sections(rows: DataFrame, top_k: int) -> DataFrame:
    """Keep the rows of a question's target sections (``targets``); with too few of them, fill up
    with rows of the same documents, then with the rest."""
    m = min(5, top_k)
    section = F.lower(F.coalesce(first_given(F.col("section_name"), F.col("section_path")), F.lit("")))
    key = F.coalesce(first_given(F.col("doc_id"), F.col("source")), F.lit(""))
    q = Window.partitionBy("query_id")
    flagged = rows.withColumn("r", F.exists("targets", lambda t: F.contains(section, F.lower(t)))).withColumn("key", key)
    flagged = flagged.withColumn("n_r", F.count_if("r").over(q)).withColumn("same", F.max(F.col("r") & (F.col("key") != "")).over(Window.partitionBy("query_id", "key")))
    flagged = flagged.withColumn("class", F.when(F.col("r"), 0).when(F.col("same"), 1).otherwise(2))
    once = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("class", "pos"))
    few = (F.size("targets") > 0) & (F.col("n_r") > 0) & (F.col("n_r") < m)
    flagged = flagged.withColumn("few", few).withColumn("once", once)
    kept = flagged.filter(~F.col("few") | (F.col("once") == 1))
    kept = kept.withColumn("rank", F.row_number().over(q.orderBy(F.when(F.col("few"), F.col("class")).otherwise(0), "pos")))
    keep = F.when(F.size("targets") == 0, True).when(F.col("n_r") == 0, F.col("pos") <= top_k).when(F.col("few"), F.col("rank") <= m).otherwise(F.col("r"))
    return _renumber(kept.filter(keep), F.col("rank")).drop("r", "key", "n_r", "same", "class", "few", "once", "rank")


def balance_companies(rows: DataFrame, top_k: int) -> DataFrame:
    """Take the companies a question names in turns, then fill up in order; other lists stay."""
    company = F.lower(F.coalesce(first_given(F.col("company"), F.col("source"), F.col("doc_id")), F.lit("")))
    own = rows.withColumn("c", F.when((company != "") & F.contains(F.lower("query"), company), company))
    per = Window.partitionBy("query_id", "c")
    own = own.withColumn("i", F.row_number().over(per.orderBy("pos"))).withColumn("first", F.min("pos").over(per))
    n = own.groupBy("query_id").agg(F.count_distinct("c").alias("n"))
    own = own.join(n, "query_id").withColumn("quota", F.greatest(F.lit(2), F.floor(F.lit(top_k) / F.greatest("n", F.lit(1)))))
    turn = F.col("c").isNotNull() & (F.col("i") <= F.col("quota"))
    own = own.withColumn("phase", F.when(turn, 0).otherwise(1))
    # a repeated identifier uses up its company's turn
    once = F.row_number().over(Window.partitionBy("query_id", "id", "phase").orderBy("i", "first"))
    used = F.min("phase").over(Window.partitionBy("query_id", "id"))
    own = own.withColumn("once", once).withColumn("used", used)
    balanced = F.col("n") >= 2
    kept = own.filter(~balanced | ((F.col("phase") == 0) & (F.col("once") == 1)) | ((F.col("phase") == 1) & (F.col("used") == 1)))
    order = [F.when(balanced, F.col("phase")).otherwise(0), F.when(balanced & (F.col("phase") == 0), F.col("i")).otherwise(0), F.when(balanced & (F.col("phase") == 0), F.col("first")).otherwise(F.col("pos")), F.col("pos")]
    out = _renumber(kept, *order)
    return out.filter(~balanced | (F.col("pos") <= top_k)).drop("c", "i", "first", "n", "quota", "phase", "once", "used")


def adaptive_filter(rows: DataFrame, min_keep: int = 3, max_per_doc: int = 0, score_ratio: float = 0.0, max_drop: float = 0.0) -> DataFrame:
    """Cap each document's rows, then cut the list at the first row that falls too far behind.

    A row beyond ``min_keep`` fails if its score is below ``score_ratio`` of the first row's and more
    than ``max_drop`` below it; a test with value 0 is off and counts as passed."""
    key = F.coalesce(first_given(F.col("source"), F.col("doc_id")), F.lit(""))
    capped = rows.withColumn("key", key).withColumn("i", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("pos")))
    if max_per_doc > 0:
        capped = capped.withColumn("ok", (F.col("key") == "") | (F.col("i") <= max_per_doc))
    else:
        capped = capped.withColumn("ok", F.lit(True))
    q = Window.partitionBy("query_id")
    kept = capped.withColumn("p", F.when(F.col("ok"), F.count_if("ok").over(q.orderBy("pos"))))
    kept = kept.withColumn("top", F.max(F.when(F.col("p") == 1, F.col("score"))).over(q))
    top, score = F.col("top"), F.col("score")
    ratio_ok = F.lit(True) if score_ratio <= 0 else (top <= 0) | (score >= top * score_ratio)
    drop_ok = F.lit(True) if max_drop <= 0 else (top < score) | (top - score <= max_drop)
    fail = F.col("ok") & (F.col("p") - 1 >= min_keep) & ~(ratio_ok | drop_ok)
    kept = kept.withColumn("cut", F.min(F.when(fail, F.col("p"))).over(q)).withColumn("any", F.max("ok").over(q))
    keep = F.when(F.col("any"), F.col("ok") & (F.col("cut").isNull() | (F.col("p") < F.col("cut")))).otherwise(F.col("pos") <= max(min_keep, 1))
    return _renumber(kept.filter(keep), F.col("pos")).drop("key", "i", "ok", "p", "top", "cut", "any")


def rerank(rows: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """Reorder the first ``top_n`` rows by a reranker's (query_id, pos, rerank_score); a row without
    a score comes last among them, the rest follows as it was."""
    joined = rows.join(scores.select("query_id", "pos", "rerank_score"), ["query_id", "pos"], "left")
    tail = F.col("pos") > top_n
    order = F.when(tail, F.lit(0.0)).otherwise(F.coalesce("rerank_score", F.lit(float("-inf"))))
    return _renumber(joined, tail.cast("int"), order.desc(), F.col("pos"))


def final_contexts(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` rows; all of them if it is not positive."""
    return rows if limit <= 0 else rows.filter(F.col("pos") <= limit)
