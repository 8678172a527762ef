"""Token windows, paragraph chunks and layout of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import first_given, tokens

SLIDING_SIZE, SLIDING_OVERLAP = 512, 153
PARAGRAPH_SIZE, PARAGRAPH_OVERLAP, SHORTEST = 320, 48, 80
#: First lines that open a section, case-insensitive.
HEADING_PATTERNS = [
    r"^\s*Table\s+of\s+Contents\b.*",
    r"^\s*Item\s+\d+[A-Z]?\b.*",
    r"^\s*Management[’']?s\s+Discussion\b.*",
    r"^\s*Consolidated\s+(Statements?|Statement)\b.*",
    r"^\s*Notes?\s+to\s+Consolidated\s+Financial\s+Statements\b.*",
    r"^\s*Report\s+of\s+Independent\b.*",
    r"^\s*Exhibit\s+Index\b.*",
    r"^\s*Signatures\b.*",
]


def sliding_windows(docs: DataFrame, text_col: str = "text", size: int = SLIDING_SIZE, overlap: int = SLIDING_OVERLAP, split: Callable[[Column], Column] = tokens, joint: str = " ") -> DataFrame:
    """One row a window of ``size`` tokens every ``size - overlap``: offset, chunk, n_tokens.

    ``split`` makes the tokens, white-space ones if not given; ``joint`` stands between them in a chunk.
    Windows start while a token is left, so trailing ones may lie inside their predecessor."""
    step = size - overlap
    rows = docs.withColumn("__tokens", split(F.col(text_col)))
    starts = F.expr(f"if(size(__tokens) > 0, sequence(0, size(__tokens) - 1, {step}), array())")
    windows = F.transform(starts, lambda s: F.slice(F.col("__tokens"), s + 1, size))
    each = rows.select(*docs.columns, F.posexplode(windows).alias("offset", "__window"))
    return each.select(*docs.columns, "offset", F.array_join("__window", joint).alias("chunk"), F.size("__window").alias("n_tokens"))


def paragraph_chunks(docs: DataFrame, text_col: str = "text", size: int = PARAGRAPH_SIZE, overlap: int = PARAGRAPH_OVERLAP, split: Callable[[Column], Column] = tokens, joint: str = " ") -> DataFrame:
    """A text of at most ``size`` tokens whole; else parts of ``size - overlap`` tokens, each behind
    the last ``overlap`` tokens of the one before: offset, chunk, n_tokens."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    step = size - overlap
    rows = docs.withColumn("__tokens", split(F.col(text_col)))
    parts = F.expr(f"if(size(__tokens) <= {size}, array(0), sequence(0, cast(ceil(size(__tokens) / {step}) - 1 as int)))")
    whole = F.size("__tokens") <= size
    windows = F.transform(parts, lambda i: F.when(whole, F.col("__tokens")).otherwise(F.slice(F.col("__tokens"), F.greatest(F.lit(0), i * step - overlap) + 1, (i + 1) * step - F.greatest(F.lit(0), i * step - overlap))))
    each = rows.select(*docs.columns, F.posexplode(windows).alias("offset", "__window"))
    return each.select(*docs.columns, "offset", F.array_join("__window", joint).alias("chunk"), F.size("__window").alias("n_tokens"))


def minimum_length(chunks: DataFrame, doc_col: str, order: list[str], chunk_col: str = "chunk", shortest: int = SHORTEST) -> DataFrame:
    """Chunks of at least ``shortest`` characters, numbered anew in each document: ``order``."""
    w = Window.partitionBy(doc_col).orderBy(*order)
    return chunks.filter(F.length(chunk_col) >= shortest).withColumn("order", (F.row_number().over(w) - 1).cast("int"))


def normalize_block(text: Column) -> Column:
    """Line ends unified and trimmed, three or more of them two, outer space cut."""
    unified = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n")
    cut = F.regexp_replace(unified, r"(?Um)[\s&&[^\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(cut, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Non-empty trimmed parts between blank lines."""
    parts = F.transform(F.split(text, r"(?U)\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def is_heading(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(HEADING_PATTERNS))


def carry_sections(blocks: DataFrame, doc_col: str, order: list[str], text_col: str = "text", default: str = "General") -> DataFrame:
    """section_path: the last heading in reading order, across pages."""
    line = F.regexp_replace(F.split(F.col(text_col), "\n")[0], r"(?U)^\s+|\s+$", "")
    heading = F.when(is_heading(line), line)
    w = Window.partitionBy(doc_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_path", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(default)))


def detect_columns(blocks: DataFrame, keys: list[str], width: float | str, least: int = 8, share: float = 0.08, each_side: int = 3) -> DataFrame:
    """keys, gutter (null for a page of one column) of blocks with x0 and x1."""
    wide = F.col(width) if isinstance(width, str) else F.lit(width)
    mids = blocks.select(*keys, ((F.col("x0") + F.col("x1")) / 2.0).alias("mid"), wide.alias("wide"))
    w = Window.partitionBy(*keys).orderBy("mid")
    gaps = mids.withColumn("prev", F.lag("mid").over(w)).withColumn("gap", F.col("mid") - F.col("prev"))
    best = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("wide").alias("wide"), F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("mid")).alias("first"), ((F.col("prev") + F.col("mid")) / 2.0).alias("gutter")))).alias("best"))
    sides = mids.drop("wide").join(best, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("wide").alias("wide"), F.max("best.gap").alias("gap"), F.max("best.gutter").alias("gutter"), F.count_if(F.col("mid") < F.col("best.gutter")).alias("left"))
    good = (F.col("n") >= least) & (F.col("gap") >= share * F.col("wide")) & (F.col("left") >= each_side) & (F.col("n") - F.col("left") >= each_side)
    return sides.select(*keys, F.when(good, F.col("gutter")).alias("gutter"))


def reading_order(blocks: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with ``column`` and ``position``: the left column first, then by y and x."""
    joined = blocks.join(columns, keys)
    column = F.when(F.col("gutter").isNotNull() & ((F.col("x0") + F.col("x1")) / 2.0 >= F.col("gutter")), 1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy("column", F.bround("y0", 2), F.bround("x0", 2), "block_no")
    return joined.withColumn("column", column).withColumn("position", F.row_number().over(w)).drop("gutter")


def record_chunks(records: DataFrame, size: int = SLIDING_SIZE, overlap: int = SLIDING_OVERLAP) -> DataFrame:
    """Chunks of raw records (line_no, example_id, source, query, text, document_text)."""
    base = (F.col("line_no") * 100000).cast("long")
    named = records.select(
        first_given(F.col("example_id").cast("string"), F.col("source"), F.col("query"), base.cast("string")).alias("doc_id"),
        F.col("source").alias("given_source"),
        F.coalesce("query", F.lit("")).alias("query"),
        base.alias("order_base"),
        F.coalesce(first_given(F.col("text"), F.col("document_text")), F.lit("")).alias("body"),
    )
    each = sliding_windows(named, "body", size, overlap)
    order = F.col("order_base") + F.col("offset")
    return each.select(
        "doc_id",
        first_given(F.col("given_source"), F.col("doc_id")).alias("source"),
        F.lit("text").alias("type"),
        F.lit("General").alias("section_path"),
        F.lit(1).alias("page"),
        order.alias("order"),
        F.col("n_tokens").alias("tokens"),
        F.md5(F.concat(F.col("doc_id"), F.lit("|"), order.cast("string"), F.lit("|"), F.substring("chunk", 1, 50))).alias("hash"),
        F.lit("jsonl_naive").alias("parser"),
        "query",
        F.col("chunk").alias("text"),
    )


def page_chunks(pages: DataFrame, size: int = SLIDING_SIZE, overlap: int = SLIDING_OVERLAP) -> DataFrame:
    """Windows of pre-extracted pages (doc_id, page, text), restarting on each page, numbered by document."""
    each = sliding_windows(pages, "text", size, overlap)
    order = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "offset")) - 1).cast("int")
    numbered = each.withColumn("order", order)
    digest = F.md5(F.concat("doc_id", F.lit("|text|"), F.col("order").cast("string"), F.lit("|"), F.substring("chunk", 1, 50)))
    return numbered.select("doc_id", F.lit("text").alias("type"), F.lit("General").alias("section_path"), "page", "order", F.col("n_tokens").alias("tokens"), digest.alias("hash"), F.col("chunk").alias("text"))


def report_chunks(blocks: DataFrame, tables: DataFrame | None = None, size: int = PARAGRAPH_SIZE, overlap: int = PARAGRAPH_OVERLAP, shortest: int = SHORTEST) -> DataFrame:
    """Layout-aware chunks of text blocks (doc_id, page, position, text) and tables (doc_id, page,
    table_no, file): sections carried forward, paragraphs chunked, tables numbered behind the text."""
    paras = blocks.select("doc_id", "page", "position", F.posexplode(paragraphs(normalize_block(F.col("text")))).alias("para", "text"))
    sections = carry_sections(paras, "doc_id", ["page", "position", "para"])
    chunks = minimum_length(paragraph_chunks(sections, "text", size, overlap), "doc_id", ["page", "position", "para", "offset"], shortest=shortest)
    digest = F.md5(F.concat("doc_id", F.lit("|text|"), F.col("order").cast("string"), F.lit("|"), F.substring("chunk", 1, 50)))
    text = chunks.select("doc_id", F.lit("text").alias("type"), "section_path", "page", "order", F.lit(None).cast("string").alias("table_id"), F.col("n_tokens").alias("tokens"), digest.alias("hash"), F.col("chunk").alias("text"))
    if tables is None:
        return text
    counts = text.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_text"))
    w = Window.partitionBy("doc_id").orderBy("page", "table_no")
    numbered = tables.withColumn("t", (F.row_number().over(w) - 1).cast("int")).join(counts, "doc_id", "left")
    table = numbered.select(
        "doc_id",
        F.lit("table").alias("type"),
        F.lit("None").alias("section_path"),
        "page",
        (F.coalesce("n_text", F.lit(0)) + F.col("t")).alias("order"),
        F.concat(F.lit("T"), F.col("t").cast("string")).alias("table_id"),
        F.lit(0).alias("tokens"),
        F.md5(F.concat("doc_id", F.lit("|table|"), F.col("page").cast("string"), F.lit("|"), F.col("table_no").cast("string"))).alias("hash"),
        F.col("file").alias("text"),
    )
    return text.unionByName(table)
