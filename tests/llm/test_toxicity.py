"""The toxicity classifier: its arithmetic against plain loops, accuracy on rows held out, defined cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import toxicity
from rillmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
RUDE = ["vilewort", "schimpf", "grobian"]


def rows(n, seed, long=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(5, 60) + long)]
        toxic = int(rnd.random() < 0.3)
        for _ in range(toxic * (1 + long // 200)):
            words.insert(rnd.randrange(len(words)), rnd.choice(RUDE) + rnd.choice(["", "en", "!", "er,"]))
        out.append((i, " ".join(words), "de" if i % 2 else "en", toxic))
    return out


def fitted(seed=1):
    known = rows(300, seed)
    return toxicity.fit([r[1] for r in known], np.array([r[3] for r in known]))


def test_words_and_prefixes():
    starts, found = toxicity.features(np.frombuffer("Réeux, réeuxpa 1x".encode(), np.uint8))
    assert starts.tolist() == [0, 8, 18]
    assert found[0, 0] != found[1, 0] and (found[0, 1:4] == found[1, 1:4]).all()  # whole words differ, stems agree
    _, upper = toxicity.features(np.frombuffer(b"IDIOT", np.uint8))
    _, lower = toxicity.features(np.frombuffer(b"an idiot.", np.uint8))
    assert (upper[0] == lower[1]).all()


def test_pieces_end_between_words(monkeypatch):
    data = np.frombuffer(("ab " * 50 + "x" * 90 + " über, " * 20).encode(), np.uint8)
    whole = toxicity.features(data)
    monkeypatch.setattr(toxicity, "PIECE", 17)
    assert all(np.array_equal(a, b) for a, b in zip(toxicity.features(data), whole, strict=True))


def test_pooling_equals_loops(monkeypatch):
    net = fitted()
    texts = ["", None, "vilewort", "a b c d e f vilewort g h", "x " * 500 + "schimpfer " + "y " * 300]
    buckets, begin = toxicity.rows_of(texts)
    expected = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        vectors = [net.embed[row].sum(0) for row in buckets[a:b]] + [np.zeros(toxicity.DIM)] * toxicity._PAD
        best = []
        for i, w in enumerate(toxicity.WIDTHS):
            values = [sum(vectors[p + j] @ net.filters[i][j] for j in range(w)) for p in range(max(1, b - a - toxicity._PAD))] + [np.zeros(toxicity.FILTERS)]
            best += list(np.max(values, axis=0))
        expected.append(best)
    assert np.allclose(net.pooled(buckets, begin), expected, atol=1e-3)
    whole = net.margins(texts)
    monkeypatch.setattr(toxicity, "PIECE", 8 * 64)  # pieces of 64 words: the same largest values
    assert np.allclose(net.margins(texts), whole, atol=1e-4)


def test_learns_words_that_mark_the_label():
    net = fitted()
    other = rows(200, 2)
    margins, y = net.margins([r[1] for r in other]), np.array([r[3] for r in other])
    assert ((margins > toxicity.best_cut(margins, y, np.ones(len(y)))) == y).mean() > 0.97


def test_query_on_rows_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op12_toxicity"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.75 * sum(y for _, y in held) and hits >= 0.75 * sum(p for p, _ in held)


def test_labels_of_held_out_rows_and_columns_do_not_matter(spark, tmp_path):
    docs = spark.createDataFrame([r[:3] for r in rows(400, 5)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows(400, 5)], "doc_id long, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    one = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels, held).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.classify(other.repartition(3), turned, held).collect()}
    assert two == pytest.approx(one, abs=1e-5)


def test_texts_of_every_length_are_learned_from(spark):
    known = rows(60, 7, long=8000)
    docs = spark.createDataFrame([r[:3] for r in known], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in known], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels, F.lit(False)).collect()}
    assert np.mean([got[r[0]] == r[3] for r in known]) > 0.9


@pytest.mark.parametrize("marks,expected", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, None), (9, 1)], 0.0)])
def test_one_label_or_none(spark, marks, expected):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c", None), (3, None, "en"), (None, "d", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.lit("x") for c in ("score", "predicted", "body", "label", "slot", "marked", "toxic")})
    labels = spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("text", F.lit("y"))
    got = toxicity.classify(docs, labels, F.lit(False)).collect()
    assert [r["score"] for r in got] == [expected] * 5
    assert toxicity.classify(docs.limit(0), labels, F.lit(False)).count() == 0


def test_every_labelled_row_and_whole_text_is_learned_from(spark):
    """Words of two rows each, and marks anywhere in long texts: a sample of rows or of their parts would miss many."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    marks = [word() for _ in range(1500)]
    known = [(2 * i, f"{word()} {marks[i // 2]} {word()}", "en", 1) for i in range(3000)]
    known += [(2 * i + 1, f"{word()} {word()} {word()}", "en", 0) for i in range(3000)]
    docs = spark.createDataFrame([r[:3] for r in known], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in known], "doc_id long, toxic int")
    rows_ = toxicity.learned_rows(docs, labels, "doc_id", "text", "toxic")
    assert toxicity.counts_of(rows_)[:, :, 0].sum(0).tolist() == [3000, 3000]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels, F.lit(False)).collect()}
    assert np.mean([got[r[0]] for r in known if r[3]]) > 0.9
    long = spark.createDataFrame([(1, "ab " * 40_000 + "vilewort"), (2, "ab " * 10)], "doc_id long, text string")
    kept = toxicity.learned_rows(long, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert sorted(r["n"] for r in kept.select(F.length("text").alias("n")).collect()) == [30, 120_008]


def test_shards_are_averaged_and_dealing_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 100)
    known = rows(350, 21)
    docs = spark.createDataFrame([r[:3] for r in known], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in known], "doc_id long, toxic int")
    one = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.classify(docs, labels, F.lit(False)).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.classify(docs.repartition(5), labels.repartition(3), F.lit(False)).collect()}
    assert two == pytest.approx({k: s for k, (s, _) in one.items()}, abs=1e-5)
    assert np.mean([one[r[0]][1] == r[3] for r in known]) > 0.9


def test_texts_without_a_label_do_not_move(spark, monkeypatch):
    """The join is the same at every size, and what it gets are the texts that have a label, but for a few."""
    plans, write = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: plans.append(df) or write(df, name))
    docs = spark.range(4000).select(F.when(F.col("id") % 9 > 0, F.col("id") * 7919).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").cast("int").alias("doc_id"), (F.col("doc_id") % 3 % 2).cast("int").alias("toxic"))
    labels = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (-1, 0), (7919, None)], "doc_id int, toxic int"))
    got = toxicity.learned_rows(docs, labels, "doc_id", "text", "toxic").select("label", "text").collect()
    plain = docs.join(labels.filter(F.col("toxic").isin(0, 1)), "doc_id").select(F.col("toxic").alias("label"), "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) > 350
    plan = plans[0]._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    marks = toxicity._sieve(labels.select(F.xxhash64(F.col("doc_id").cast("string")).alias("hash")))
    held = np.unpackbits(marks).mean()
    assert 0 < held < 0.15
