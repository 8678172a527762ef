"""Files that go in: chunks, raw records, questions, gold evidence, lists of names."""

from __future__ import annotations

import csv
import io
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.text import first_given, normalize_text, path_suffixes
from rillmark.operators.enrich import enrich, flatten_table, number_chunks
from rillmark.operators.postprocess import DEFAULT_KEYWORDS

_S = T.StringType()
METADATA = T.StructType(
    [T.StructField(n, _S) for n in ("doc_id", "source", "type", "section_path", "section_name", "table_id", "table_title", "table_path", "table_csv_path", "company", "fiscal_year", "parser", "query", "hash", "row_label", "column_label")]
    + [T.StructField(n, T.IntegerType()) for n in ("page", "order", "tokens")]
    + [T.StructField("pages", T.ArrayType(T.IntegerType())), T.StructField("keywords_hit", T.ArrayType(_S)), T.StructField("tags", T.ArrayType(_S))]
)
CHUNK = T.StructType([T.StructField("text", _S), T.StructField("metadata", METADATA)])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, value): non-blank lines with a number that ascends within each file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("line_no"), "value")
    return rows.filter(F.trim("value") != "")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk JSONL with ``given_keys``: the metadata keys a record holds, null or not."""
    parsed = lines(spark, path).withColumn("j", F.from_json("value", CHUNK))
    keys = F.map_keys(F.from_json(F.get_json_object("value", "$.metadata"), T.MapType(_S, _S)))
    return parsed.select("line_no", F.col("j.text").alias("text"), "j.metadata.*", keys.alias("given_keys"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*", excluded: DataFrame | None = None) -> DataFrame:
    """(name, path) of a folder's files in order of names, without those on a list (name)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    return files.orderBy("name") if excluded is None else without_excluded(files, excluded)


def relative_path(path: Column, root: str = "") -> Column:
    """A file's path without its scheme, the root and a leading ``./``, as records name it."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), r"^\./", "")
    top = "/" + root.split(":", 1)[-1].strip("/") + "/" if root else ""
    return F.when(F.startswith(plain, F.lit(top)), F.substring(plain, len(top) + 1, 1 << 20)).otherwise(plain) if top else plain


def read_table_files(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(path, content) of CSV files, each flattened to text; paths are relative to ``root``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    return files.select(relative_path(F.col("_metadata.file_path"), root).alias("path"), flatten_table(csv_rows(F.col("value"))).alias("content"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def csv_rows(texts: pd.Series) -> pd.Series:
    """Rows of cells of a CSV text, blank lines left out; in time linear in the text."""

    def one(text: str | None) -> list[list[str]] | None:
        if text is None:
            return None
        csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
        return [row for row in csv.reader(io.StringIO(text, newline="")) if row]

    return texts.map(one)


def csv_text(text: Column) -> Column:
    """A CSV text as lines of cells joined by bars, without a columns line."""
    joined = F.transform(csv_rows(text), lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.trim(c)), lambda c: c != ""), " | "))
    return F.array_join(F.filter(joined, lambda line: line != ""), "\n")


def load_chunks(spark: SparkSession, path: str, tables: DataFrame | None = None) -> DataFrame:
    """Numbered and enriched chunks of a JSONL file, with table files (path, content) put in."""
    if not path.endswith((".jsonl", "/", "*")) and "." in os.path.basename(path) and os.path.splitext(path)[1] not in ("", ".jsonl"):
        raise ValueError(f"only .jsonl can be ingested, not {path}")
    chunks = number_chunks(read_chunks(spark, path))
    if tables is not None:
        wanted = F.replace(F.when(F.col("type") == "table", first_given(F.col("table_csv_path"), F.col("text"))), F.lit("/app/data/"), F.lit("data/"))
        wanted = relative_path(wanted)
        named = tables.select(F.col("path").alias("__path"), F.col("content").alias("__content"))
        chunks = chunks.withColumn("__wanted", wanted).join(named, F.col("__wanted") == F.col("__path"), "left").withColumn("table_path", F.coalesce("table_path", "__wanted")).withColumn("text", F.coalesce("__content", "text")).drop("__wanted", "__path", "__content")
    return enrich(chunks)


def numbered(rows: DataFrame) -> DataFrame:
    """``lines`` (file, block, line_no, value) with n, the line's number in its file from 1: lines are
    counted in each block, and blocks behind each other, so a file of any length is read in parallel."""
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("line_no"))
    return rows.withColumn("n", inside).join(starts, ["file", "block"]).withColumn("n", F.col("start") + F.col("n")).drop("start")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records (line_no from 1, example_id, source, query, text, document_text)."""
    schema = "example_id string, source string, query string, text string, document_text string"
    return numbered(lines(spark, path)).withColumn("j", F.from_json("value", schema)).select(F.col("n").alias("line_no"), "j.*")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk JSONL (text, metadata) that ``read_chunks`` reads back, in order of documents and places."""
    known = [f for f in METADATA.fieldNames() if f in chunks.columns]
    place = [c for c in ("doc_id", "order", "chunk_id", "line_no") if c in chunks.columns]
    record = F.to_json(F.struct(F.col("text"), F.struct(*[F.col(c).cast(METADATA[c].dataType).alias(c) for c in known]).alias("metadata")))
    chunks.repartitionByRange(*place).sortWithinPartitions(*place).select(record.alias("value")).write.text(path)


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """A JSON list of terms in lower case, blank ones left out; the default terms if it is missing or no list."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return DEFAULT_KEYWORDS
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (TypeError, ValueError):
        return DEFAULT_KEYWORDS
    return [str(x).lower() for x in found if str(x).strip()] if isinstance(found, list) else DEFAULT_KEYWORDS


def read_questions(spark: SparkSession, path: str, question: str = "question", truth: str = "ground_truth") -> DataFrame:
    """(question, ground_truth) of a CSV, JSON list or JSONL file; truths that are all missing are null."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        rows = spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)
    if question not in rows.columns:
        raise KeyError(question)
    given = F.col(truth) if truth in rows.columns else F.lit(None).cast("string")
    out = rows.select(F.col(question).alias("question"), given.alias("ground_truth"))
    some = out.filter("ground_truth is not null").limit(1).count() > 0
    return out.withColumn("ground_truth", F.coalesce("ground_truth", F.lit(""))) if some else out


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, query, answer) and gold (query_id, gold_index, gold_type, content,
    normalized_text, file_name) of a golden set; entries without a query are left out."""
    schema = "array<struct<query:string,answer:string,gold:array<struct<type:string,content:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("query_id", "e"))
    kept = raw.select("query_id", "e.*").filter(F.coalesce(F.trim("query"), F.lit("")) != "")
    return kept.select("query_id", "query", "answer"), explode_gold(kept)


def explode_gold(entries: DataFrame) -> DataFrame:
    each = entries.select("query_id", F.posexplode("gold").alias("gold_index", "g"))
    kind = F.upper(F.coalesce(F.nullif("g.type", F.lit("")), F.lit("TEXT")))
    is_file = kind == "FILE"
    file = F.element_at(F.split(F.replace(F.coalesce("g.content", F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    return each.select("query_id", "gold_index", kind.alias("gold_type"), F.col("g.content").alias("content"), F.when(is_file, "").otherwise(normalize_text(F.col("g.content"))).alias("normalized_text"), F.when(is_file, F.lower(file)).alias("file_name"))


def without_excluded(files: DataFrame, excluded: DataFrame, name: str = "name") -> DataFrame:
    """Files whose name isn't on a list of names, in order of names."""
    listed = excluded.select(F.trim(name).alias(name)).filter(F.col(name) != "")
    return files.join(listed, name, "left_anti").orderBy(name)


def question_samples(records: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first ``n`` records as (query, example_id, source, text)."""
    return records.orderBy(order).limit(n).select(F.trim("question").alias("query"), "example_id", "source", "text")


def resolve_references(gold: DataFrame, files: DataFrame) -> DataFrame:
    """gold items of type FILE with ``reference``: the text of the file (path relative to a root,
    text) that the longest suffix of the item's path names, under the root or its ``data`` folder;
    CSV files as lines of cells.  Null if no file fits."""
    wanted = gold.filter("gold_type = 'FILE'").select("query_id", "gold_index", F.posexplode(path_suffixes(F.col("content"))).alias("at", "suffix"))
    places = wanted.select("query_id", "gold_index", F.explode(F.array(F.struct((F.col("at") * 2).alias("rank"), F.col("suffix").alias("path")), F.struct((F.col("at") * 2 + 1).alias("rank"), F.concat(F.lit("data/"), "suffix").alias("path")))).alias("x"))
    text = F.when(F.lower("path").endswith(".csv"), csv_text(F.col("text"))).otherwise(F.col("text"))
    hits = places.select("query_id", "gold_index", "x.rank", "x.path").join(files.select("path", text.alias("reference")), "path")
    best = hits.groupBy("query_id", "gold_index").agg(F.min_by("reference", "rank").alias("reference"))
    return gold.join(best, ["query_id", "gold_index"], "left")
