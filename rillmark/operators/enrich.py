"""Metadata of chunks: defaults, titles, headers, numbers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import blank, company_and_year, first_given, point_id

#: Phrases of a section's name that make it a table's title.
TITLE_PHRASES = ["statement of", "balance sheet", "cash flow", "income"]
UNTITLED_PHRASES = ["statement of", "balance sheet"]


def number_chunks(chunks: DataFrame, line_col: str = "line_no", doc_col: str | list[str] = "doc_id") -> DataFrame:
    """chunk_id (from 0 in line order) and total_chunks of each document, in one window."""
    w = Window.partitionBy(doc_col)
    return chunks.withColumn("chunk_id", (F.row_number().over(w.orderBy(line_col)) - 1).cast("int")).withColumn("total_chunks", F.count(F.lit(1)).over(w).cast("int"))


def default_metadata(chunks: DataFrame, given: str | None = None) -> DataFrame:
    """source, parser, company and fiscal_year where a chunk lacks them.

    With ``given`` (a column with the array of keys that the record held) an explicit null stays
    null; without it null counts as missing."""
    company, year = company_and_year(F.col("doc_id"))
    defaults = {"source": F.col("doc_id"), "parser": F.lit("prechunked"), "company": company, "fiscal_year": year}
    out = {}
    for name, value in defaults.items():
        own = F.col(name) if name in chunks.columns else F.lit(None).cast("string")
        missing = own.isNull() if given is None else ~F.array_contains(F.col(given), name)
        out[name] = F.when(missing, value).otherwise(own)
    return chunks.withColumns(out)


def flatten_table(rows: Column) -> Column:
    """An array of rows (arrays of cells) as text: columns line, then cells joined by bars."""
    lines = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.trim(c)), lambda c: c != ""), " | "))
    kept = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    head = F.when((F.size(rows) > 0) & (F.size(F.get(rows, F.lit(0))) > 0), F.concat(F.lit("Table columns: "), F.array_join(F.get(rows, F.lit(0)), ", "), F.lit(".\n"))).otherwise("")
    return F.concat(head, kept)


def quarterly(content: Column, title: Column) -> tuple[Column, Column]:
    """Content and title of a table; one that names both quarters' ends gets a title line."""
    both = F.contains(content, F.lit("June 30")) & F.contains(content, F.lit("September 30"))
    return F.when(both, F.concat(F.lit("Quarterly Financial Results\n"), content)).otherwise(content), F.when(both, F.coalesce(title, F.lit("Quarterly Financial Results"))).otherwise(title)


def infer_title(title: Column, section_name: Column) -> Column:
    """A file's name is no title: the section's name, if it sounds like one, or a general one."""
    section = F.lower(F.coalesce(section_name, F.lit("")))

    def sounds(phrases: list[str]) -> Column:
        out = F.lit(False)
        for phrase in phrases:
            out = out | F.contains(section, F.lit(phrase))
        return out

    return (
        F.when(blank(title).isNotNull() & title.endswith(".csv"), F.when(sounds(TITLE_PHRASES), section_name).otherwise("Financial Table"))
        .when(blank(title).isNull() & sounds(UNTITLED_PHRASES), section_name)
        .otherwise(title)
    )


def augment_section(content: Column, section_path: Column, section_name: Column) -> Column:
    def about(word: str) -> Column:
        return F.contains(F.lower(F.coalesce(section_path, F.lit(""))), F.lit(word)) | F.contains(F.lower(F.coalesce(section_name, F.lit(""))), F.lit(word))

    return (
        F.when(about("directors"), F.concat(F.lit("List of Board of Directors and Executive Officers.\n"), content))
        .when(about("properties"), F.concat(F.lit("List of Properties and Real Estate.\n"), content))
        .otherwise(content)
    )


def context_header(source: Column, doc_id: Column, section: Column, page: Column, kind: Column, title: Column) -> Column:
    """The given parts joined by bars; empty if there are none."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Document: "), first_given(source, doc_id)),
        F.concat(F.lit("Section: "), blank(section)),
        F.concat(F.lit("Page: "), page.cast("string")),
        F.concat(F.lit("Content type: "), blank(kind)),
        F.concat(F.lit("Table: "), blank(title)),
    )


def with_header(header: Column, content: Column) -> Column:
    """Header and content with a blank line between; either alone if the other is empty."""
    return F.concat_ws("\n\n", blank(header), blank(content))


def enrich(chunks: DataFrame, header_once: bool = False) -> DataFrame:
    """Numbered chunks (doc_id, source, type, section_path, section_name, page, table_title, text)
    to points: id, content, embedding_content and metadata."""
    rows = default_metadata(chunks)
    table = F.col("type") == "table"
    content, title = quarterly(F.col("text"), F.col("table_title"))
    rows = rows.withColumns({"content": F.when(table, content).otherwise(F.col("text")), "table_title": F.when(table, title).otherwise(F.col("table_title"))})
    rows = rows.withColumn("table_title", infer_title(F.col("table_title"), F.col("section_name")))
    rows = rows.withColumn("content", augment_section(F.coalesce("content", F.lit("")), F.col("section_path"), F.col("section_name")))
    rows = rows.withColumn("context_header", context_header(F.col("source"), F.col("doc_id"), F.col("section_path"), F.col("page"), F.col("type"), F.col("table_title")))
    rows = rows.withColumn("content", with_header(F.col("context_header"), F.col("content")))
    embedding = F.col("content") if header_once else with_header(F.col("context_header"), F.col("content"))
    return rows.withColumn("embedding_content", embedding).withColumn("id", point_id(F.col("source"), F.col("chunk_id")))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """doc_id, type, n and n_sources (a chunk without source counts its document) of chunks."""
    return chunks.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("source", "doc_id")).alias("n_sources"))
