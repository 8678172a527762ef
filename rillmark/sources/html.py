"""Tables of HTML pages, by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, table_no (from 0), rows (array of arrays of cells) of every table with two rows or more.

    Columns that are empty but for their head, columns whose head starts with ``Unnamed`` and rows
    without a cell are left out; shorter rows are filled with empty cells."""
    tables = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), 1)
    each = pages.select(F.col(id_col), F.posexplode(tables).alias("table_no", "body"))
    rows = F.regexp_extract_all("body", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr>|(?=<tr\b)|$)"), 1)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?:</t[dh]>|(?=<t[dh]\b)|$)"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))))
    full = each.select(id_col, "table_no", F.filter(cells, lambda r: F.exists(r, lambda c: c != "")).alias("grid")).filter(F.size("grid") >= 2)
    wide = full.withColumn("width", F.array_max(F.transform("grid", lambda r: F.size(r))))
    even = wide.withColumn("grid", F.transform("grid", lambda r: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))))
    body = F.slice("grid", 2, F.size("grid"))
    keep = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.exists(body, lambda r: F.get(r, i) != "") & ~F.lower(F.get(F.get("grid", F.lit(0)), i)).startswith("unnamed"))
    kept = even.withColumn("keep", keep)
    return kept.select(id_col, "table_no", F.transform("grid", lambda r: F.transform("keep", lambda i: F.get(r, i))).alias("rows"))
