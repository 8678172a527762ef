"""Clashing column names, nulls in any column, repeated rows and identifiers, empty tables: all operators and stages."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rillmark.llm import bpe, chat, decontaminate, exact_dedup, html_extract, jaccard_join, language, lm_score, token_files, warc

CLASHING = ["lang_pred", "score", "token_ids", "decoded", "digest", "tag", "gone", "hit", "text_hash", "body", "row_id", "letter", "body_hash", "main_text", "n_chars", "held_out", "group", "sid", "n", "Body", "payload"]
NAMES = [c for c in CLASHING if c not in ("n_chars", "Body")]
CLEAN = "ein langer satz der nur einmal vorkommt und mit nichts anderem in diesen daten etwas gemeinsam hat"
NEAR = " ".join(f"wort{i}" for i in range(80))
LEAK = "these ten words of a benchmark item stand in here now exactly"


def documents(spark, empty=False):
    rows = [
        (1, NEAR, "de", "a"), (1, CLEAN, "de", "b"), (2, NEAR + " ende", "de", "c"), (3, NEAR, "de", "d"), (3, NEAR, "de", "d"),
        (4, "vorne " + LEAK + " und hinten", "de", "e"), (4, CLEAN + " aber anders weil es viele andere woerter enthaelt die sonst fehlen und so weiter", "de", "f"),
        (5, None, None, "g"), (None, "ohne kennung aber mit text und noch mehr text", None, "h"), (6, "", "de", "i"), (7, "123 456", "en", "j"), (None, None, None, None),
    ]
    frame = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string")
    return frame.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in NAMES})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("items")
    spark.createDataFrame([(0, LEAK), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


EXPECTED = {  # sources of the rows that each stage keeps of the whole table
    "language_id": ["a", "b", "c", "d", "d", "e", "f", "h"],
    "exact_copies": ["b", "c", "d", "e", "f", "h", "i", "j"],  # null and empty texts are equal, and 6 is the largest
    "near_copies": [None, "a", "b", "e", "f", "g", "h", "i", "j"],
    "benchmark_leaks": [None, "a", "b", "c", "d", "d", "f", "g", "h", "i", "j"],
}


@pytest.mark.parametrize("name", EXPECTED)
def test_stages_drop_rows_and_keep_columns(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark).repartition(3)
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = got.collect()
    assert sorted((r["source"] for r in rows), key=lambda s: s or "") == EXPECTED[name]
    assert all(r[c] == "x" for r in rows for c in NAMES)
    none = stage(spark, documents(spark, empty=True), folder)
    assert none.columns == docs.columns and none.count() == 0


def test_last_stage_encodes_every_row(spark, folder):
    stage = dict(corpus_pipeline.STAGES)["encode"]
    got = stage(spark, documents(spark), folder).collect()
    assert len(got) == 12 and all(r["round_trip"] for r in got)
    assert stage(spark, documents(spark, empty=True), folder).count() == 0


BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "bpe": lambda d, m: bpe.decode(bpe.encode(d, BPE, public_tokenizers.PATTERN, decoded=True), BPE, public_tokenizers.PATTERN),
    "html": lambda d, m: html_extract.extract(d.withColumnRenamed("text", "html")),
    "lm": lambda d, m: lm_score.score(d, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))),
    "jaccard": lambda d, m: jaccard_join.jaccard_components(d),
    "language": lambda d, m: language.identify(d, F.lit(False), keep=d.columns),
    "decontaminate": lambda d, m: decontaminate.decontaminate(d, m),
    "dedup": lambda d, m: exact_dedup.exact_dedup(d),
    "warc": lambda d, m: warc.read_archives(d.sparkSession, warc.write_archives(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"}))),
    "tokens": lambda d, m: token_files.read_tokens(d.sparkSession, token_files.write_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_every_row_a_result(spark, folder, name):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert len(OPERATORS[name](documents(spark), items).collect()) == 12
    assert OPERATORS[name](documents(spark, empty=True), items).count() == 0


def test_chat_takes_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, None), (None, None, None, None), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    turns = turns.withColumns({c: F.lit("x") for c in ("message", "seq", "event", "piece", "formatted", "loss_from")})
    got = {r["conv_id"]: r["n_turns"] for r in chat.digest_chats(chat.format_chats(chat.log_of_turns(turns))).collect()}
    assert got == {1: 3, None: 1}
