"""Command line: chunk, ingest, retrieve, query, evaluate, and pipeline for the first, second and last in a row."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark import providers
from rillmark.config import RetrievalConfig, normalize_ks
from rillmark.functions.vectors import hash_embedding
from rillmark.operators import chunking, evaluation
from rillmark.plans import rag
from rillmark.progress import Progress
from rillmark.sources import readers
from rillmark.sources.store import Collection

log = logging.getLogger("rillmark")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("rillmark").getOrCreate()


def _vectors(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn(name, hash_embedding(F.col(text)).cast("array<float>"))


def _queries(spark: SparkSession, texts: list[str]) -> DataFrame:
    return _vectors(spark.createDataFrame(list(enumerate(texts)), "query_id int, query string"), "query", "query_vec")


def chunk(args) -> int:
    spark = _spark()
    readers.write_chunks(chunking.record_chunks(readers.read_records(spark, args.path)), args.chunks)
    return 0


def ingest(args) -> int:
    spark = _spark()
    tables = readers.read_table_files(spark, args.tables, args.root) if args.tables else None
    chunks = _vectors(readers.load_chunks(spark, args.path, tables), "embedding_content", "vector")
    with Progress(spark, show=log.info) as progress:
        n = Collection(spark, args.collection).upsert(progress.counted(chunks.drop("given_keys")), overwrite=not args.no_overwrite)
    print(f"{n} chunks")
    return 0


def pipeline(args) -> int:
    """Records to chunk files, chunk files to the collection, and its evaluation."""
    chunk(args)
    args.path = args.chunks
    return ingest(args) or evaluate(args)


def retrieve(args) -> int:
    spark = _spark()
    rows = rag.retrieve(Collection(spark, args.collection).read(), _queries(spark, [args.query]), RetrievalConfig(top_k=args.top_k))
    for row in rows.orderBy("pos").select("pos", "score", "doc_id", F.substring("content", 1, 500).alias("excerpt")).collect():  # top_k rows
        print(f"[{row['pos']}] {row['score']:.4f} {row['doc_id']}\n{row['excerpt']}\n")
    return 0


def query(args) -> int:
    spark = _spark()
    row = rag.answer(Collection(spark, args.collection).read(), _queries(spark, [args.query]), RetrievalConfig(top_k=args.top_k)).first()
    print(row["answer"], f"\nmodel: {row['model']}, tokens: {row['usage']['total_tokens']}, contexts: {len(row['contexts'])}")
    return 0


def evaluate(args) -> int:
    spark = _spark()
    points = Collection(spark, args.collection).read()
    if args.golden_path:
        ks, top_k = normalize_ks(args.k_values, args.top_k)
        asked, gold = readers.read_gold(spark, args.golden_path)
        rows = rag.retrieve(points, _vectors(asked, "query", "query_vec"), RetrievalConfig(top_k=top_k), readers.read_keywords(spark, args.keywords) if args.keywords else None)
        totals = evaluation.gold_counts(asked, gold)
        matched = evaluation.match_gold(rows, gold, args.fuzzy_threshold)
        out = evaluation.summary_at_k(evaluation.metrics_at_k(matched, totals, tuple(ks)), totals).orderBy("k")
        report = [r.asDict() for r in out.collect()]  # one row a k
        if args.details:
            evaluation.query_details(matched, totals, tuple(ks)).write.mode("overwrite").json(args.details)
    elif args.csv_path or args.json_path or args.question:
        if args.question:
            asked = spark.createDataFrame([(args.question, args.ground_truth)], "question string, ground_truth string")
        else:
            asked = readers.read_questions(spark, args.csv_path or args.json_path, args.question_col, args.ground_truth_col)
        asked = _vectors(asked.withColumn("query_id", F.monotonically_increasing_id()).withColumn("query", F.col("question")), "query", "query_vec")
        answers = rag.answer(points, asked, RetrievalConfig(top_k=args.top_k)).join(asked.select("query_id", "question", "ground_truth"), "query_id")
        report = [evaluation.numeric_means(providers.lexical_judge(answers).drop("query_id")).first().asDict()]
    else:
        log.error("no input: give --golden-path, --csv-path, --json-path or --question")
        return 1
    text = json.dumps(report, indent=2)
    print(text)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as out_file:
            out_file.write(text)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rillmark")
    commands = top.add_subparsers(dest="command")
    for name, f in (("chunk", chunk), ("ingest", ingest), ("retrieve", retrieve), ("query", query), ("evaluate", evaluate), ("pipeline", pipeline)):
        p = commands.add_parser(name)
        p.set_defaults(run=f)
        p.add_argument("--collection", default="collection")
        if name in ("chunk", "ingest", "pipeline"):
            p.add_argument("path")
        if name in ("chunk", "pipeline"):
            p.add_argument("--chunks", default="chunks")
        if name in ("ingest", "pipeline"):
            p.add_argument("--no-overwrite", action="store_true")
            p.add_argument("--tables")
            p.add_argument("--root", default="")
        if name in ("evaluate", "pipeline"):
            for option in ("--csv-path", "--json-path", "--golden-path", "--question", "--ground-truth", "--output", "--details", "--keywords"):
                p.add_argument(option)
            p.add_argument("--question-col", default="question")
            p.add_argument("--ground-truth-col", default="ground_truth")
            p.add_argument("--k-values", type=int, nargs="+", default=[1, 3, 5, 10])
            p.add_argument("--fuzzy-threshold", type=float, default=0.7)
            p.add_argument("--top-k", type=int, default=10)
        if name in ("retrieve", "query"):
            p.add_argument("query")
            p.add_argument("--top-k", type=int, default=5)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 1
    try:
        return args.run(args)
    except Exception:
        log.exception("%s failed", args.command)
        return 1


if __name__ == "__main__":
    sys.exit(main())
