"""Queries over PDF files that Spark writes from the tables: texts, page chunks, layout tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.operators import chunking, layout
from rillmark.queries import _docs, _query, _scratch, _table
from rillmark.sources import pdf, pdf_write

#: Words of a document on one page.
PAGE_WORDS = 250


def _pages_sql(columns: str) -> str:
    """Each document's words by pages of PAGE_WORDS; what is in a file that can't be read is left out."""
    return f"""WITH w AS (SELECT doc_id, string_split_regex(trim(coalesce(text, ''), E' \\t\\n\\x0b\\f\\r'), '[ \\t\\n\\x0b\\f\\r]+') AS words FROM documents WHERE doc_id % 50 <> 7),
p AS (SELECT doc_id, unnest(generate_series(1, greatest(1, (len(words) + {PAGE_WORDS} - 1) // {PAGE_WORDS}))) AS page, words FROM w),
t AS (SELECT doc_id, page::INT AS page, words[(page - 1) * {PAGE_WORDS} + 1 : page * {PAGE_WORDS}] AS own FROM p) {columns}"""


def _is_prose(text: str) -> bool:
    """Whether a page's lines fill a column: narrow ones side by side would be a table."""
    lines = [line for own in pdf_write.wrapped(text, pdf_write.TWO) for line in own]
    return len(lines) >= 16 and all(sum(map(len, half)) >= 30 * len(half) for half in (lines[: -(-len(lines) // 2)], lines[-(-len(lines) // 2) :]))


def document_files(docs: DataFrame) -> DataFrame:
    """(path, content): a PDF file of each document, in one of the forms that files have; one of fifty is no
    PDF, one of ten has lost its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = [w for line in (text or "").split("\n") for w in [*line.split(), "\n"]]
                pages, own, n = [], [], 0
                for w in words:
                    if n == PAGE_WORDS and w != "\n":
                        pages.append(own)
                        own, n = [], 0
                    own.append(w)
                    n += w != "\n"
                pages.append(own)
                texts = [" ".join(p).replace(" \n ", "\n").replace(" \n", "\n").replace("\n ", "\n") for p in pages]
                longest = max(map(len, words), default=0)
                columns = i % 2 == 1 and longest <= pdf_write.TWO
                data = pdf_write.write_pdf([(pdf_write.text_page(t, columns and _is_prose(t)), []) for t in texts], wide=i % 3 == 0, packed=i % 4 == 1, compressed=i % 5 != 2)
                data = (text or "").encode() if i % 50 == 7 else data[:-40] if i % 10 == 3 else data
                out.append((f"{i}.pdf", data))
            yield pd.DataFrame(out, columns=["path", "content"])

    # a small table may be one task's; writing and decoding files is the work here
    spread = docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return spread.mapInPandas(run, "path string, content binary")


def _spans(spark, files: DataFrame) -> DataFrame:
    """The files' spans as a written table: layout reads them more than once, decoding is once."""
    path = _scratch(spark, "spans")
    pdf.pdf_spans(files).write.parquet(path)
    return spark.read.schema(pdf.SPANS).parquet(path)


def _doc_id():
    return F.regexp_extract("path", r"(-?\d+)\.pdf$", 1).cast("long")


@_query("pdf_text", _pages_sql("SELECT doc_id, page, len(list_filter(own, lambda x: x <> ''))::INT AS n_words, md5(array_to_string(own, ' ')) AS text_md5 FROM t UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 50 = 7"))
def pdf_text(spark, sf_dir):
    """Every page's text in reading order, of one and two columns; a file that is no PDF has one row."""
    spans = _spans(spark, document_files(_docs(spark, sf_dir)))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    pages = layout.page_texts(spans).select("path", "page", flat.alias("flat"))
    good = pages.select(_doc_id().alias("doc_id"), "page", F.size(F.filter(F.split("flat", " "), lambda x: x != "")).alias("n_words"), F.md5("flat").alias("text_md5"))
    bad = spans.filter("error IS NOT NULL").select(_doc_id().alias("doc_id"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"))
    return good.union(bad)


@_query("pdf_page_chunks", _pages_sql("""
, c AS (SELECT doc_id, page, own, unnest(generate_series(0, len(own) - 1, 80)) AS s FROM t WHERE own[1] <> ''),
n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page, s) - 1)::INT AS ord FROM c)
SELECT doc_id, page, ord AS "order", len(own[s + 1 : s + 100])::INT AS tokens, md5(array_to_string(own[s + 1 : s + 100], ' ')) AS text_md5 FROM n
"""))
def pdf_page_chunks(spark, sf_dir):
    """Windows over the pages of PDF files, restarting on each page, numbered by document."""
    pages = layout.page_texts(_spans(spark, document_files(_docs(spark, sf_dir)))).select(_doc_id().alias("doc_id"), "page", "text")
    return chunking.page_chunks(pages, 100, 20).select("doc_id", "page", "order", "tokens", F.md5("text").alias("text_md5"))


def table_files(parts: DataFrame) -> DataFrame:
    """(path, content): a PDF file of each eight orders; every fifth row is one merged cell, every third lacks
    its second cell, odd files have lines between the columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, rows in zip(batch["path"], batch["rows"], strict=True):
                number = int(path.removesuffix(".pdf"))
                grid = [["order", "customer", "status", "priority"]]
                for r in sorted(rows, key=lambda r: r["o_orderkey"]):
                    grid.append([f"total of order {r['o_orderkey']}"] if r["o_orderkey"] % 5 == 4 else [str(r["o_orderkey"]), "" if r["o_orderkey"] % 3 == 0 else str(r["o_custkey"]), r["o_orderstatus"], r["o_orderpriority"]])
                grid.append(["end", "of", "the", "table"])
                out.append((path, pdf_write.write_pdf([pdf_write.table_page(f"Orders of group {number}, as they stand", grid, number % 2 == 1)], packed=number % 2 == 0)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return parts.mapInPandas(run, "path string, content binary")


@_query("pdf_tables", """
WITH o AS (SELECT o_orderkey // 8 AS g, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN 'total of order ' || o_orderkey || '|||'
  ELSE o_orderkey || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_custkey::VARCHAR END || '|' || o_orderstatus || '|' || o_orderpriority END AS line FROM orders)
SELECT g AS number, 0 AS table_no, 'order|customer|status|priority' || chr(10) || string_agg(line, chr(10) ORDER BY k) || chr(10) || 'end|of|the|table' AS cells FROM o GROUP BY g
""")
def pdf_tables(spark, sf_dir):
    """Tables of positioned text, with merged and empty cells, with and without ruling lines."""
    orders = _table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("g"), F.struct("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_orderpriority").alias("r"))
    # a small table may be one task's; writing and decoding files is the work here
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g")
    files = table_files(orders.groupBy("g").agg(F.collect_list("r").alias("rows")).select(F.concat("g", F.lit(".pdf")).alias("path"), "rows"))
    found = layout.layout_tables(_spans(spark, files))
    lines = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return found.select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("number"), "table_no", lines.alias("cells"))
