"""The pipeline and the registered queries over the smallest tables."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rillmark.llm import language
from rillmark.llm.queries import QUERIES
from tests.llm.test_ops import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r["doc_id"] for r in language.predict(docs, language.train(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in told}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: rows[i] for i in last.values()}
    rows = {i: t for (_, i), _, c in brute_components(rows.items()) if i == c for t in [rows[i]]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for (_, i), _, n, _ in brute_hits(rows.items(), items) if not n}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == clean and len(got) == len(clean)
    assert all(r["round_trip"] and len(r["token_ids"]) == 4 * r["n_tokens"] for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["op6_language", "op10_token_files", "op4_lm_score"])
def test_whole_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert got.count() == docs.count()
    if name == "op6_language":
        held = got.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
        assert held >= 0.95


def test_bpe_query_digests(spark):
    import public_tokenizers
    import tiktoken

    from rillmark.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(data).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
