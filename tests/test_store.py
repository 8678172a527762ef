"""The collection's commits, buckets and posting lists; cells of vectors; percentiles by selection."""

import math
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.operators import quantiles, search
from rillmark.sources import cells, postings, store
from rillmark.streaming.ingest import ingest_stream

POINT = "id string, doc_id string, chunk_id int, source string, content string"


def points(spark, rows):
    return spark.createDataFrame([(f"{source}-{i}", source, i, source, text) for source, i, text in rows], POINT)


def bytes_of(folder, *kinds):
    return sum(os.path.getsize(os.path.join(d, f)) for kind in kinds for d, _, files in os.walk(folder) if kind in d for f in files)


def test_buckets_split_and_tile(spark, tmp_path):
    collection = store.Collection(spark, f"file://{tmp_path}/c", bucket_rows=20)
    rows = [(f"s{i % 40}", i, f"text {i}") for i in range(200)] + [("huge", i, "one source") for i in range(60)]
    assert collection.upsert(points(spark, rows)) == 260
    meta = collection._meta()
    spans = sorted((int(b.split("-")[0]), int(b.split("-")[1])) for b in meta["buckets"])
    assert sum(2.0**-d for d, _ in spans) == 1 and len({(d, x) for d, x in spans}) == len(spans)  # every hash has one bucket
    assert sum(bool(w) for w in meta["buckets"].values()) > 5
    assert {r["id"] for r in collection.read().collect()} == {f"{s}-{i}" for s, i, _ in rows}
    before = meta["buckets"]
    assert collection.upsert(points(spark, [("s3", 1000, "new"), ("fresh", 1, "new")])) == 2
    after = collection._meta()["buckets"]
    assert sum(after.get(b) != w for b, w in before.items()) <= 2
    left = {r["id"] for r in collection.read().collect()}
    assert left == {f"{s}-{i}" for s, i, _ in rows if s != "s3"} | {"s3-1000", "fresh-1"}


def test_an_upsert_writes_a_bounded_number_of_bytes(spark, tmp_path):
    written = []
    for n in (400, 1600):
        where = f"{tmp_path}/c{n}"
        collection = store.Collection(spark, f"file://{where}", bucket_rows=100)
        collection.upsert(points(spark, [(f"s{i // 4}", i, f"some text of point {i}") for i in range(n)]))
        before = bytes_of(where, "points-", "index-")
        collection.upsert(points(spark, [("s3", 12, "changed")]))
        written.append(bytes_of(where, "points-", "index-") - before)
    assert written[1] < 2 * written[0]  # four times the collection


def test_two_writers_both_survive(spark, tmp_path):
    where = f"file://{tmp_path}/c"
    store.Collection(spark, where).upsert(points(spark, [("a", 0, "old"), ("b", 0, "old")]))
    one, two = store.Collection(spark, where), store.Collection(spark, where)
    barrier = threading.Barrier(2)
    plain = store.Collection._commit

    def at_once(self, meta):
        if not hasattr(self, "waited"):
            self.waited = True
            barrier.wait(120)  # both have merged onto the same state
        return plain(self, meta)

    one._commit, two._commit = at_once.__get__(one), at_once.__get__(two)
    jobs = [threading.Thread(target=c.upsert, args=(points(spark, [(s, 1, "new")]),)) for c, s in ((one, "a"), (two, "c"))]
    for job in jobs:
        job.start()
    for job in jobs:
        job.join()
    assert sorted(r["id"] for r in one.read().collect()) == ["a-1", "b-0", "c-1"]
    assert one._meta()["number"] == 2
    one.vacuum()
    assert len(one._commits()) == 1 and one.read().count() == 3


def test_a_batch_is_committed_once(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("".join('{"text": "part %d", "metadata": {"doc_id": "one_2019"}}\n' % j for j in range(3)))
    collection = store.Collection(spark, f"file://{tmp_path}/c")
    embedded = lambda df: df.withColumn("vector", F.array(F.lit(1.0), F.rand()))
    run = lambda: ingest_stream(spark, str(folder), collection, embedded, str(tmp_path / "state")).awaitTermination()
    plain = store.Collection._commit

    def dies_before(self, meta):
        raise RuntimeError("killed before the commit")

    def dies_after(self, meta):
        plain(self, meta)
        raise RuntimeError("killed after the commit")

    for broken, n in ((dies_before, None), (dies_after, 3)):
        monkeypatch.setattr(store.Collection, "_commit", broken)
        with pytest.raises(Exception, match="killed"):
            run()
        assert (collection.read().count() if collection.read() is not None else None) == n
    monkeypatch.setattr(store.Collection, "_commit", plain)
    state = collection.read().collect()
    run()
    assert sorted(collection.read().collect()) == sorted(state) and collection._meta()["number"] == 0
    collection.vacuum()
    assert collection.read().count() == 3


def test_posting_lists_of_a_collection(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    rnd = random.Random(2)
    words = ["common", *(f"w{i}" for i in range(30))]
    rows = [(f"s{i % 9}", i, " ".join(["common"] + rnd.sample(words, 6)) if i % 10 else ["", None, "É x"][i // 10 % 3]) for i in range(300)]
    collection = store.Collection(spark, f"file://{tmp_path}/c", bucket_rows=60)
    collection.upsert(points(spark, rows))
    rows = [r for r in rows if r[0] != "s4"] + [("s4", 1, "common w1 w2"), ("s4", 2, "w1")]
    collection.upsert(points(spark, [r for r in rows if r[0] == "s4"]))
    asked = spark.createDataFrame([(0, "w1 common"), (1, "w3 W4"), (2, "missing w1"), (3, "common"), (4, ""), (5, "a b"), (6, None), (7, "é")], "query_id int, query string")
    asked = asked.withColumn("wanted", F.when(F.col("query_id") == 0, F.array(F.lit("s4"))).otherwise(F.array().cast("array<string>")))
    got = {(r["query_id"], r["id"], r["pos"]) for r in collection.text_match(asked, 5).collect()}
    plain = {(r["query_id"], r["id"], r["pos"]) for r in search.text_match(collection.read().drop("tokens"), asked, 5).collect()}
    expected = set()
    for q, need, source in ((0, {"w1", "common"}, "s4"), (1, {"w3", "w4"}, None), (3, {"common"}, None)):
        hits = sorted(f"{s}-{i}" for s, i, t in rows if need <= set((t or "").lower().split()) and source in (None, s))
        expected |= {(q, i, p) for p, i in enumerate(hits[:5], 1)}
    assert got == plain == expected
    lists = collection.index()
    assert lists.filter("n <> size(offsets) OR n > 16").count() == 0
    first, others = postings.rarest_first(lists, asked)
    counts = {r["token"]: r["n"] for r in lists.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    assert {r["query_id"]: r["token"] for r in first.collect()}[0] == "w1" and counts["common"] > counts["w1"]


@pytest.mark.parametrize("exact", [True, False])
def test_cells(spark, tmp_path, exact):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    vectors = [(i, (centres[i % 12] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(600)]
    vectors += [(1000, None), (1001, [0.0] * 8), (1002, vectors[0][1]), (1003, vectors[0][1])]
    table = spark.createDataFrame(vectors, "id long, vector array<float>").repartition(5)
    queries = table.filter("id % 20 = 0 and vector is not null").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vec")).union(spark.createDataFrame([(-1, [0.0] * 8), (-2, None)], "query_id long, query_vec array<float>"))
    built = cells.CellIndex.build(table, f"file://{tmp_path}/cells", 16)
    index = cells.CellIndex.open(spark, built.path)
    assert spark.read.parquet(f"{built.path}/points").count() == 602
    true = search.dense_topk(table, queries, 10)
    got = index.topk(queries, 10, probes=2, exact=exact)
    if exact:
        assert sorted(got.collect()) == sorted(true.collect())
    else:
        r = cells.recall(got, true.filter("query_id >= 0")).agg(F.sum("hits") / F.sum("k")).first()[0]
        assert r >= 0.9
        for target in (0.5, 0.97, 1.0):
            n = index.probes_for(queries, 10, target)
            tuned = cells.recall(index.topk(queries, 10, probes=n), true).agg(F.sum("hits") / F.sum("k")).first()[0]
            assert tuned >= target - 0.01 and n <= 16
    assert cells.CellIndex.build(table.limit(0), f"file://{tmp_path}/none").topk(queries, 3, exact=exact).count() == 0


@pytest.mark.parametrize("few", [10_000, 4])
def test_percentiles_by_selection(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)  # few: several rounds of brackets
    rnd = random.Random(1)
    rows = [(g, v) for g in ("a", "b", None) for v in [rnd.gauss(0, 1) if rnd.random() < 0.7 else float(rnd.randrange(3)) for _ in range(700)]]
    rows += [("a", None), ("b", math.inf), ("b", -math.inf), ("c", 5.0), ("d", None), ("e", math.inf), ("e", math.inf), ("f", math.nan), ("f", 1.0), ("f", 2.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    got = {(r["g"], r["share"]): r["v"] for r in quantiles.exact_percentiles(frame, "v", shares, ["g"]).collect()}
    assert {k[0] for k in got} == {"a", "b", "c", "e", "f", None}
    for (g, share), v in got.items():
        values = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (math.isnan(x), x))
        rank = share * (len(values) - 1)
        low, high = values[math.floor(rank)], values[math.ceil(rank)]
        expected = low if low == high or rank == math.floor(rank) else low + (high - low) * (rank - math.floor(rank))
        assert v == pytest.approx(expected, nan_ok=True), (g, share)
    whole = {r["share"]: r["v"] for r in quantiles.exact_percentiles(frame.filter("g = 'a'"), "v", shares).collect()}
    assert whole == {s: got["a", s] for s in shares}
    assert quantiles.exact_percentiles(frame.limit(0), "v", shares).count() == 0


def test_a_task_holds_the_best_only(monkeypatch):
    """Of all scores of a task few are held at a time, however many there are."""
    monkeypatch.setattr(search, "MOST_FOUND", 2000)
    scores = np.round(np.random.default_rng(3).normal(size=(60, 20_000)), 2)
    scores[5] = 0.5  # all alike: identifiers decide
    best, ids, most = search.Best(60, 4, -1.0), np.arange(20_000)[::-1], 0
    for begin in range(0, 20_000, 500):
        best.add(np.arange(60), ids[begin : begin + 500], scores[:, begin : begin + 500])
        most = max(most, sum(len(x[0]) for x in best.found))
    (got,) = best.batches()
    expected = [(q, int(i), float(s)) for q in range(60) for i, s in sorted(zip(ids, scores[q], strict=True), key=lambda x: (-x[1], x[0]))[:4]]
    assert list(zip(*(c.to_pylist() for c in got.columns), strict=True)) == expected
    assert most <= 2000


def test_upsert_keeps_one_point_an_identifier(spark, tmp_path):
    """Repeated identifiers in a write, and one that moves to another source, without a window over all points."""
    schema = "id string, doc_id string, chunk_id int, source string, content string"
    first = spark.createDataFrame([("a", "d", 0, "s", "old one"), ("a", "d", 1, "s", "new one"), ("b", "d", 0, "s", "two"), ("c", "d", 0, "t", "three")], schema)
    collection = store.Collection(spark, f"file://{tmp_path}/c")
    collection.upsert(first)
    assert sorted((r["id"], r["content"]) for r in collection.read().collect()) == [("a", "new one"), ("b", "two"), ("c", "three")]
    collection.upsert(spark.createDataFrame([("c", "d", 0, "u", "moved"), ("c", "d", 2, "u", "moved last")], schema))
    assert sorted((r["id"], r["source"], r["content"]) for r in collection.read().collect()) == [("a", "s", "new one"), ("b", "s", "two"), ("c", "u", "moved last")]
    plan = store.replace_points(first, store.latest_points(first.dropDuplicates(["id"])))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # contents are not moved where no identifier is repeated
