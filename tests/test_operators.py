"""Semantics on small frames, against short restatements in plain Python."""

from __future__ import annotations

import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark import adapters, cli, providers
from rillmark.config import RetrievalConfig, normalize_ks
from rillmark.functions import text as tx
from rillmark.functions.vectors import hash_embedding
from rillmark.operators import chunking, enrich, evaluation, postprocess, search
from rillmark.plans import answers, rag
from rillmark.sources import html, readers, store
from rillmark.streaming.ingest import ingest_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# ---- chunking -------------------------------------------------------------------------------


def test_windows_and_chunks_of_all_lengths(spark):
    sizes = [0, 1, 319, 320, 321, 359, 360, 512, 513, 544, 592, 593, 1000]
    docs = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in sizes], "n int, text string")
    sliding, paragraphs = {}, {}
    for r in chunking.sliding_windows(docs).orderBy("n", "offset").collect():
        sliding.setdefault(r["n"], []).append(r["chunk"].split())
    for r in chunking.paragraph_chunks(docs).orderBy("n", "offset").collect():
        paragraphs.setdefault(r["n"], []).append(r["chunk"].split())
    for n in sizes:
        tokens = list(map(str, range(n)))
        assert sliding.get(n, []) == [tokens[i : i + 512] for i in range(0, n, 359)]
        if n <= 320:
            expected = [tokens]
        else:
            expected, before = [], []
            for i in range(0, n, 272):
                before = (before[-48:] + tokens[i : i + 272])[:320]
                expected.append(before)
        assert paragraphs[n] == expected
    with pytest.raises(ValueError):
        chunking.paragraph_chunks(docs, overlap=320)


def test_layout(spark):
    assert one(spark, chunking.normalize_block(F.lit("a  \r\nb\t\n\n\n\nc \n"))) == "a\n\nb\n\nc"
    assert one(spark, chunking.paragraphs(F.lit("a\n \n b \n\n\n\nc\nd"))) == ["a", "b", "c\nd"]
    heads = [("ITEM 7A. Risk", True), ("  signatures", True), ("Management's Discussion and", True), ("Items", False), ("the Item 7", False)]
    for line, expected in heads:
        assert one(spark, chunking.is_heading(F.lit(line))) is expected
    blocks = spark.createDataFrame([("d", 1, float(10 + 300 * (i % 2)), float(60 + 300 * (i % 2)), float(100 - i), i) for i in range(10)], "doc_id string, page int, x0 double, x1 double, y0 double, block_no int")
    columns = chunking.detect_columns(blocks, ["doc_id", "page"], 600.0)
    assert columns.first()["gutter"] == 185.0
    order = [r["block_no"] for r in chunking.reading_order(blocks, columns, ["doc_id", "page"]).orderBy("position").collect()]
    assert order == [8, 6, 4, 2, 0, 9, 7, 5, 3, 1]
    assert chunking.detect_columns(blocks.limit(7), ["doc_id", "page"], 600.0).first()["gutter"] is None


def test_report_chunks_number_tables_last(spark):
    blocks = spark.createDataFrame([("d", 1, 0, "Item 1. Business\n\n" + "long enough words " * 10), ("d", 2, 0, "more words of it " * 10)], "doc_id string, page int, position int, text string")
    tables = spark.createDataFrame([("d", 1, 0, "t.csv")], "doc_id string, page int, table_no int, file string")
    rows = chunking.report_chunks(blocks, tables).orderBy("order").collect()
    assert [(r["type"], r["section_path"], r["order"]) for r in rows] == [("text", "Item 1. Business", 0), ("text", "Item 1. Business", 1), ("table", "None", 2)]


# ---- metadata -------------------------------------------------------------------------------


def test_names_titles_and_tables(spark):
    cases = {"some-company-inc_2019": ("some company inc", "2019"), "x_201": ("x 201", None), "_2019": (None, "2019"), "plain": ("plain", None)}
    for name, expected in cases.items():
        assert tuple(spark.range(1).select(*tx.company_and_year(F.lit(name))).first()) == expected
    grid = F.array(F.array(F.lit(" a"), F.lit("b")), F.array(F.lit("1 "), F.lit("")), F.array(F.lit(""), F.lit("")))
    assert one(spark, enrich.flatten_table(grid)) == "Table columns:  a, b.\na | b\n1"
    assert one(spark, readers.csv_text(F.lit('h,"x, y"\n1,\n,\n2,"say ""hi"""'))) == 'h | x, y\n1\n2 | say "hi"'
    assert one(spark, enrich.context_header(F.lit(""), F.lit("d"), F.lit(None).cast("string"), F.lit(0), F.lit("text"), F.lit(""))) == "Document: d | Page: 0 | Content type: text"


def test_explicit_null_is_kept_where_keys_are_known(spark):
    rows = spark.createDataFrame([("c_2019", None, ["company"]), ("c_2019", None, [])], "doc_id string, company string, keys array<string>")
    assert [r["company"] for r in enrich.default_metadata(rows, "keys").collect()] == [None, "c"]


def test_html_tables(spark):
    page = "<table><tr><th>a</th><th>Unnamed: 1</th><th>e</th><tr><td>1<td>x</td><td></td></tr><tr><td></td></tr></table><table><tr><td>lonely</td></tr></table>"
    rows = html.html_tables(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(r["page_id"], r["table_no"], r["rows"]) for r in rows] == [(1, 0, [["a"], ["1"]])]


# ---- text -----------------------------------------------------------------------------------


def test_fuzzy_ratio_keeps_its_order_and_bound(spark):
    draw = random.Random(1)
    rows = [("".join(draw.choice("abc ") for _ in range(draw.randrange(30))), "".join(draw.choice("abc ") for _ in range(draw.randrange(30)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", tx.fuzzy_ratio("a", "b").alias("r"), tx.fuzzy_bound(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        assert abs(r["r"] - difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()) < 1e-12 and r["r"] <= r["m"] + 1e-12


def test_json_repair(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'text {"a": [1]} more': '{"a": [1]}', "x [1, 2] y": "[1, 2]", "nothing": None, "": None, None: None, '  "s" ': '"s"'}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", tx.repair_json("x").alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases
    text = json.dumps({"z": "last", "answer": "second", "text": " first ", "n": [1, {"text": "deep"}]})
    assert one(spark, tx.json_text(F.lit(text))) == "first second last 1 deep"


# ---- lists ----------------------------------------------------------------------------------

SCHEMA = "query_id int, pos int, id string, score double, original_score double, doc_id string, source string, company string, type string, section_path string, section_name string, query string, targets array<string>"


def random_lists(seed):
    draw = random.Random(seed)
    rows = []
    for q in range(60):
        targets = draw.choice([[], ["risk"], ["risk", "biz"]])
        query = draw.choice(["alpha and beta", "alpha", "gamma alpha beta", "none"])
        for pos in range(1, draw.randrange(2, 14)):
            score = round(1 - pos * draw.choice([0.01, 0.05]), 6)
            rows.append((q, pos, f"i{draw.randrange(9)}", score, score, draw.choice(["d1", "d2", "d3", ""]), draw.choice(["s1", "", "s2"]), draw.choice(["alpha", "Beta", "gamma", ""]), "text", draw.choice(["risk a", "biz", "other", ""]), draw.choice(["", None, "Risk b"]), query, targets))
    return rows


def by_query(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def listed(frame):
    out = {}
    for r in frame.orderBy("query_id", "pos").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def shown(rows):
    return [(d[2], d[3]) for d in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_section_filter_by_classes(spark, seed):
    """A short list is the first of each identifier by (class, place), in that order."""
    rows, top_k, enough = random_lists(seed), 12, 5

    def expected(docs):
        hits = {d[1] for d in docs if any(t in (d[10] or d[9] or "").lower() for t in d[12])}
        documents = {d[5] or d[6] for d in docs if d[1] in hits} - {""}
        rank = lambda d: (0 if d[1] in hits else 2 - ((d[5] or d[6]) in documents), d[1])
        firsts = {i: min((d for d in docs if d[2] == i), key=rank) for i in {d[2] for d in docs}}
        if not docs[0][12]:
            return docs
        if not hits:
            return [d for d in docs if d[1] <= top_k]
        return [d for d in docs if d[1] in hits] if len(hits) >= enough else sorted(firsts.values(), key=rank)[:enough]

    got = listed(postprocess.filter_sections(spark.createDataFrame(rows, SCHEMA), top_k))
    assert got == {q: shown(expected(docs)) for q, docs in by_query(rows).items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_balance_by_turns(spark, seed):
    """Rows have a turn: their number within a named company, up to the quota.  Rows with a turn come
    by (turn, the company's first place), then those without, by place; of an identifier with a turn
    only its earliest turn counts."""
    rows, top_k = random_lists(seed), 6

    def expected(docs):
        named = {d[1]: c for d in docs if (c := (d[7] or d[6] or d[5]).lower()) and c in d[11].lower()}
        places = {c: [p for p in sorted(named) if named[p] == c] for c in set(named.values())}
        if len(places) < 2:
            return docs
        quota = max(2, top_k // len(places))
        turn = {p: (i, held[0]) for held in places.values() for i, p in enumerate(held) if i < quota}
        earliest = {i: min(turn[d[1]] for d in docs if d[2] == i and d[1] in turn) for i in {d[2] for d in docs if d[1] in turn}}
        first = [d for d in docs if d[1] in turn and turn[d[1]] == earliest[d[2]]]
        return [*sorted(first, key=lambda d: turn[d[1]]), *(d for d in docs if d[2] not in earliest)][:top_k]

    got = listed(postprocess.balance_companies(spark.createDataFrame(rows, SCHEMA), top_k))
    assert got == {q: shown(expected(docs)) for q, docs in by_query(rows).items()}


@pytest.mark.parametrize("settings", [(2, 0, 0.0, 0.0), (2, 1, 0.9, 0.05), (0, 2, 0.95, 0.02), (3, 0, 0.9, 0.0)])
def test_adaptive_by_first_failure(spark, settings):
    """Rows within their document's cap, up to the first that lies too far below the top."""
    least, cap, ratio, drop = settings
    rows = random_lists(5)

    def expected(docs):
        same = lambda d: [x for x in docs if (x[6] or x[5]) == (d[6] or d[5]) and x[1] < d[1]]
        within = [d for d in docs if not cap or not (d[6] or d[5]) or len(same(d)) < cap]
        top = within[0][3]
        far = lambda score: ratio > 0 and top > 0 and score < ratio * top and drop > 0 and top >= score and top - score > drop
        cuts = [n for n, d in enumerate(within) if n >= least and far(d[3])]
        return within[: min(cuts, default=len(within))] or docs[: max(least, 1)]

    got = listed(postprocess.adaptive_filter(spark.createDataFrame(rows, SCHEMA), least, cap, ratio, drop))
    assert got == {q: shown(expected(docs)) for q, docs in by_query(rows).items()}


def test_topup_samples_evenly_and_may_repeat(spark):
    rows = spark.createDataFrame([(1, 1, "x", 0.5, 0.5, "d", "s", "", "text", "", "", "q", []), (1, 2, "t03", 0.4, 0.4, "d", "s", "", "table", "", "", "q", [])], SCHEMA)
    tables = spark.createDataFrame([(f"t{i:02d}", "d", 1, f"T{i}", "table") for i in range(20)], "id string, doc_id string, page int, table_id string, type string")
    got = listed(postprocess.table_topup(rows, tables, 50))[1]
    names = sorted((f"T{i}", f"t{i:02d}") for i in range(20))
    picked = [names[round(i * 19 / 5)][1] for i in range(6)]
    assert got == [(p, round(1.5 - i * 0.01, 6)) for i, p in enumerate(picked)] + [("x", 0.5), ("t03", 0.4)]
    assert len(listed(postprocess.table_topup(rows, tables.filter("id = 't03'"), 50))[1]) == 3
    assert len(listed(postprocess.table_topup(rows, tables.filter("id = 't03'"), 50, dedupe=True))[1]) == 2


# ---- search and metrics ---------------------------------------------------------------------


def test_dense_topk_legs_agree(spark):
    draw = np.random.default_rng(1)
    points = spark.createDataFrame([(i, [float(x) for x in draw.normal(size=8)] if i % 9 else [0.0] * 8) for i in range(200)] + [(999, None)], "id long, vector array<float>")
    asked = points.filter("id > 0 and id < 8 ").select(F.col("id").cast("int").alias("query_id"), F.col("vector").alias("query_vec"))
    order = [F.col("score").desc(), F.col("id")]
    expected = search.top_per_query(search.dense_scores(points, asked.crossJoin(points.select("id"))).filter("score >= 0"), 5, order)
    got = search.dense_topk(points.repartition(7), asked, 5, 0.0)
    key = lambda f: sorted((r["query_id"], r["pos"], r["id"], r["score"]) for r in f.collect())
    assert key(got) == key(expected)
    first = [r for r in key(search.dense_topk(points, asked, 3, 0.0))]
    assert first == [r for r in key(got) if r[1] <= 3]


def test_dense_topk_takes_queries_in_parts(spark, monkeypatch):
    draw = np.random.default_rng(2)
    points = spark.createDataFrame([(i, [float(x) for x in draw.normal(size=6)] if i % 7 else [0.0] * 6) for i in range(120)], "id long, vector array<float>")
    asked = points.filter("id < 30").select(F.col("id").cast("int").alias("query_id"), F.col("vector").alias("query_vec"))
    key = lambda f: sorted((r["query_id"], r["pos"], r["id"], r["score"]) for r in f.collect())
    whole = key(search.dense_topk(points, asked, 4))
    monkeypatch.setattr(search, "MOST_QUERIES", 8)
    assert key(search.dense_topk(points, asked, 4)) == whole and len(whole) == 120
    none = search.dense_topk(points, asked.limit(0), 4)
    assert none.columns == ["query_id", "id", "score", "pos"] and none.count() == 0
    empty = asked.limit(0).withColumn("query", F.lit(""))
    assert search.dense_topk_filtered(points.withColumn("source", F.lit("x")), empty, 4).count() == 0


@pytest.mark.parametrize("mode", ["match", "bm25"])
def test_filters_come_before_the_cut(spark, mode):
    rows = [(i, "oracle cash flow", [1.0, 0.5], "other_2019") for i in range(300)] + [(300, "oracle cash flow", [0.1, 1.0], "oracle-corporation_2019"), (301, "oracle cash flow", [1.0, 0.5], None)]
    chunks = spark.createDataFrame(rows, "id long, content string, vector array<double>, source string")
    asked = search.company_filter(spark.createDataFrame([(0, "oracle cash flow", [1.0, 0.5])], "query_id int, query string, query_vec array<double>"))
    leg = search.text_match if mode == "match" else search.bm25
    assert [r["id"] for r in leg(chunks, asked, 200).collect()] == [300]
    assert [r["id"] for r in search.hybrid_search(chunks, asked, 20, text_mode=mode).collect()] == [300]


def test_company_filter_is_by_substring(spark):
    asked = search.company_filter(spark.createDataFrame([(0, "nothing"), (1, "generosity"), (2, "OSG and Overseas, a10")], "query_id int, query string"))
    assert [sorted(r["wanted"]) for r in asked.orderBy("query_id").collect()] == [[], ["eros-international-plc"], ["a10-networks-inc", "overseas-shipholding-group-inc"]]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, p, c, "s", "d") for p, c in enumerate(["none", "has gold one in", "gold one", "gold two", "x"], 1)] + [(2, 1, "y", "file_a", "d")], "query_id int, pos int, content string, source string, doc_id string")
    entries = spark.createDataFrame([(1, [(None, "Gold  ONE"), ("TEXT", "gold two"), ("text", "absent words")]), (2, [("FILE", "dir\\File_A")])], "query_id int, gold array<struct<type:string,content:string>>")
    gold = readers.explode_gold(entries)
    totals = evaluation.gold_counts(spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), gold)
    matched = evaluation.match_gold(rows, gold)
    assert [r["gold_index"] for r in matched.orderBy("query_id", "pos").collect()] == [None, 0, 0, 1, None, 0]
    at = {(r["query_id"], r["k"]): r for r in evaluation.metrics_at_k(matched, totals, (1, 3, 10)).collect()}
    assert (at[1, 3]["precision"], at[1, 3]["recall"], at[1, 3]["covered"]) == (0.666667, 0.333333, 1)
    assert at[1, 10]["precision"] == 0.6 and at[2, 1]["full_coverage"] == 1.0 and at[3, 10]["hit"] == 0.0
    ranks = {r["query_id"]: r for r in evaluation.rank_metrics(matched, totals).collect()}
    assert ranks[1]["average_precision"] == round((1 / 2 + 2 / 4) / 3, 6) and ranks[1]["reciprocal_rank"] == 0.5 and ranks[3]["hit"] == 0.0
    fuzzy = evaluation.match_gold(rows.withColumn("content", F.lit("gold tw0")), gold, 0.7)
    assert fuzzy.filter("query_id = 1").first()["gold_index"] == 1 or fuzzy.filter("query_id = 1").first()["gold_index"] == 0


def test_k_values():
    assert normalize_ks([5, 0, 3, 5, -1], 2) == ([3, 5], 5)
    with pytest.raises(ValueError):
        normalize_ks([0], 5)


# ---- end to end -----------------------------------------------------------------------------


def chunk_file(path):
    with open(path, "w", encoding="utf-8") as out:
        for i in range(12):
            kind = "table" if i % 4 == 3 else "text"
            out.write(json.dumps({"text": f"alpha words number {i} of {'oracle' if i % 2 else 'other'} liquidity", "metadata": {"doc_id": f"doc{i % 3}-corp_2019", "type": kind, "section_path": "Item 7", "page": i, "table_id": "T0" if kind == "table" else None}}) + "\n\n")


def test_ingest_retrieve_answer_and_reingest(spark, tmp_path, capsys):
    path = tmp_path / "chunks.jsonl"
    chunk_file(path)
    where = f"file://{tmp_path}/collection"
    embedded = lambda df: df.withColumn("vector", hash_embedding(F.col("embedding_content")).cast("array<float>"))
    collection = store.Collection(spark, where, dimension=64)
    points = embedded(readers.load_chunks(spark, str(path))).drop("given_keys")
    for _ in range(2):
        assert collection.upsert(points) == 12
        assert collection.read().select("id").distinct().count() == collection.read().count() == 12
    with pytest.raises(ValueError):
        store.Collection(spark, where, dimension=32)
    with pytest.raises(ValueError):
        readers.load_chunks(spark, "x.pdf")
    assert store.verify(collection.read()).first()["no_content"] == 0
    asked = spark.createDataFrame([(0, "alpha liquidity"), (1, "zzz")], "query_id int, query string").withColumn("query_vec", hash_embedding(F.col("query")).cast("array<float>"))
    config = RetrievalConfig(top_k=4, rerank_top_n=3)
    rows = rag.retrieve(collection.read(), asked, config, reranker=providers.OverlapReranker)
    assert 0 < rows.filter("query_id = 0").count() <= 4
    found = rag.answer(collection.read(), asked, config).orderBy("query_id").collect()
    assert len(found) == 2 and found[0]["usage"]["total_tokens"] > 0 and found[0]["contexts"] and found[1]["contexts"] is not None
    data = answers.dataset(rag.answer(collection.read(), asked, config), spark.createDataFrame([(0, "alpha")], "query_id int, ground_truth string"))
    answers.write_cache(data, str(tmp_path / "cache"))
    back = answers.read_cache(spark, str(tmp_path / "cache"))
    assert sorted(map(str, back.collect())) == sorted(map(str, data.collect()))
    judged = providers.lexical_judge(back).collect()
    assert any(r["truth_in_contexts"] == 1.0 for r in judged)
    for command in (["retrieve", "alpha", "--top-k", "2"], ["query", "alpha"], ["evaluate", "--question", "alpha?"]):
        assert cli.main([*command[:1], "--collection", where, *command[1:]]) == 0
    assert cli.main([]) == 1 and cli.main(["evaluate", "--collection", where]) == 1 and cli.main(["ingest", "x.pdf"]) == 1
    capsys.readouterr()


def test_provider_vectors_equal_expression(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,), ("C c",)], "text string")
    got = providers.embed(rows, providers.HashEmbedding, "text").withColumn("x", hash_embedding(F.col("text")).cast("array<float>")).collect()
    assert all(r["vector"] == r["x"] for r in got)


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    chunk_file(folder / "a.jsonl")
    collection = store.Collection(spark, f"file://{tmp_path}/c")
    embedded = lambda df: df.withColumn("vector", hash_embedding(F.col("embedding_content")).cast("array<float>"))
    for name in ("one", "two"):
        ingest_stream(spark, str(folder), collection, embedded, str(tmp_path / name)).awaitTermination()
        assert collection.read().count() == 12


def test_streaming_ingest_of_a_source_in_several_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    collection = store.Collection(spark, f"file://{tmp_path}/c")
    embedded = lambda df: df.withColumn("vector", hash_embedding(F.col("embedding_content")).cast("array<float>"))
    for i, name in enumerate(("a", "b", "c")):  # each file is a batch of its own
        (folder / f"{name}.jsonl").write_text("".join(json.dumps({"text": f"part {i} {j}", "metadata": {"doc_id": "one_2019"}}) + "\n" for j in range(i + 1)))
        ingest_stream(spark, str(folder), collection, embedded, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["text"] for r in collection.read().collect()) == sorted(f"part {i} {j}" for i in range(3) for j in range(i + 1))
    assert collection.read().select("id").distinct().count() == 6


def test_upsert_touches_only_its_sources(spark, tmp_path):
    collection = store.Collection(spark, f"file://{tmp_path}/c")
    made = lambda ids, source, text, n=2: spark.createDataFrame([(f"{source}{i}", source, 0, source, text, [1.0] * n) for i in ids], "id string, doc_id string, chunk_id int, source string, content string, vector array<float>")
    assert collection.upsert(made(range(3), "a", "old").union(made(range(2), "b", "kept"))) == 5 and collection.dimension == 2
    before = collection._meta()["buckets"]
    assert collection.upsert(made([1, 7], "a", "new").withColumn("more", F.lit("x"))) == 2
    after = collection._meta()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r["id"]: (r["content"], r["more"], r["tokens"]) for r in collection.read().collect()}
    assert got == {"a1": ("new", "x", ["new"]), "a7": ("new", "x", ["new"]), "b0": ("kept", None, ["kept"]), "b1": ("kept", None, ["kept"])}
    assert collection.upsert(made([2], "a", "added"), overwrite=False) == 1 and collection.read().count() == 5
    for other in (made([0], "a", "x", 3), made([0], "c", "x", 2).union(made([1], "c", "x", 5))):
        with pytest.raises(ValueError):
            collection.upsert(other)
    assert collection.read().count() == 5 and store.Collection(spark, f"file://{tmp_path}/c").dimension == 2
    assert collection.vacuum() > 0 and collection.vacuum() == 0 and collection.read().count() == 5
    collection.write(made([9], "z", "only"))
    assert [r["id"] for r in collection.read().collect()] == ["z9"]


def test_files_and_chunk_sink(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_text("x")
    excluded = spark.createDataFrame([(" b.pdf ",), ("",)], "name string")
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path), "*.pdf").collect()] == ["a.pdf", "b.pdf"]
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path), "*.pdf", excluded).collect()] == ["a.pdf"]
    (tmp_path / "k.json").write_text('["Net Income", " ", "EBITDA"]')
    assert readers.read_keywords(spark, str(tmp_path / "k.json")) == ["net income", "ebitda"]
    (tmp_path / "bad.json").write_text("{")
    assert readers.read_keywords(spark, str(tmp_path / "bad.json")) == readers.read_keywords(spark, str(tmp_path / "none.json")) != []
    rows = [(f"d{i % 2}_2020", "Item 7", i, i // 2, f"text\n{i}") for i in range(8)]
    chunks = spark.createDataFrame(rows, "doc_id string, section_path string, page int, order int, text string").repartition(3)
    readers.write_chunks(chunks, str(tmp_path / "out"))
    back = readers.read_chunks(spark, str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["section_path"], r["page"], r["order"], r["text"]) for r in back.collect()) == sorted(rows)
    numbers = [json.loads(line)["metadata"]["order"] for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert numbers == [0, 1, 2, 3] * 2


def test_tables_are_found_by_relative_path(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "t.csv").write_text('h,"x, y"\n1,"two\nlines"\n')
    (tmp_path / "c.jsonl").write_text(json.dumps({"text": "/app/data/t.csv", "metadata": {"doc_id": "d_2019", "type": "table"}}) + "\n")
    tables = readers.read_table_files(spark, str(tmp_path / "data"), str(tmp_path))
    assert [r["path"] for r in tables.collect()] == ["data/t.csv"]
    row = readers.load_chunks(spark, str(tmp_path / "c.jsonl"), tables).first()
    assert "Table columns: h, x, y" in row["content"] and "1 | two\nlines" in row["content"]


def test_record_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("".join(json.dumps({"query": str(i), "text": "t" * 300}) + "\n" * (1 + i % 3) for i in range(1, 2000)))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "40000")
    try:
        got = [(r["line_no"], int(r["query"])) for r in readers.read_records(spark, str(tmp_path / "r.jsonl")).collect()]
    finally:
        spark.conf.set(key, old)
    assert len(got) == 1999 and all(a == b for a, b in got)


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,ground_truth\n"a, b",t\nc,\n')
    assert sorted(map(tuple, readers.read_questions(spark, str(tmp_path / "q.csv")).collect())) == [("a, b", "t"), ("c", "")]
    (tmp_path / "q.json").write_text(json.dumps([{"question": "x"}]))
    assert [tuple(r) for r in readers.read_questions(spark, str(tmp_path / "q.json")).collect()] == [("x", None)]
    with pytest.raises(KeyError):
        readers.read_questions(spark, str(tmp_path / "q.json"), "other")
    (tmp_path / "g.json").write_text(json.dumps([{"query": "", "gold": []}, {"query": "q", "gold": [{"content": "A  b"}, {"type": "file", "content": "x/Y.pdf"}]}]))
    asked, gold = readers.read_gold(spark, str(tmp_path / "g.json"))
    assert asked.count() == 1 and [(r["normalized_text"], r["file_name"]) for r in gold.orderBy("gold_index").collect()] == [("a b", None), ("", "y.pdf")]


def test_references(spark):
    gold = spark.createDataFrame([(1, 0, "FILE", "/app/data/set/a.csv"), (1, 1, "FILE", "b.txt"), (1, 2, "TEXT", "b.txt"), (1, 3, "FILE", "none")], "query_id int, gold_index int, gold_type string, content string")
    files = spark.createDataFrame([("set/a.csv", "x,y\n1,2"), ("data/b.txt", "second"), ("a.csv", "worse")], "path string, text string")
    assert [r["reference"] for r in readers.resolve_references(gold, files).orderBy("gold_index").collect()] == ["x | y\n1 | 2", "second", None, None]


# ---- adapters, command line, expressions ----------------------------------------------------


def test_generators_over_transports():
    lines = ['{"message": {"content": "a "}}', "", '{"message": {"content": "b"}, "model": "m1", "prompt_eval_count": 3, "eval_count": 2}']
    asked = [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]
    got = adapters.make("generator", "lines", send=lambda r: lines, model="m")().generate(asked)
    assert got == {"content": "a b", "model": "m1", "prompt_tokens": 3, "completion_tokens": 2}
    with pytest.raises(RuntimeError):
        adapters.LineStreamGenerator(lambda r: ['{"error": "x"}'], "m").generate(asked)
    calls, waits = [], []

    def busy(request):
        calls.append(request)
        if len(calls) < 3:
            raise adapters.Throttled
        return {"output": {"message": {"content": [{"text": "x"}, {"text": "y"}]}}, "usage": {"inputTokens": 1, "outputTokens": 2, "totalTokens": 3}}

    got = adapters.ConverseGenerator(busy, "m", sleep=waits.append).generate(asked)
    assert got["content"] == "xy" and got["total_tokens"] == 3 and waits == [1.0, 2.0]
    assert calls[0]["system"] == [{"text": "s"}] and calls[0]["messages"] == [{"role": "user", "content": [{"text": "q"}]}]
    calls.clear()
    with pytest.raises(adapters.Throttled):
        adapters.with_retries(busy, {}, attempts=2, sleep=waits.append)
    with pytest.raises(ValueError):
        adapters.make("generator", "none")


def test_candidates_are_limited_and_repaired():
    answers_, asked, naps, now = ["no", 'Sure: {"a": 1} ok'], [], [], [0.0]

    def send(request):
        asked.append(request)
        return {"candidates": [{"parts": []}, {"parts": [{"text": answers_[min(len(asked), 2) - 1]}]}], "usage": {"total_tokens": 5}}

    own = adapters.CandidateGenerator(send, "m", per_minute=30, clock=lambda: now[0], sleep=naps.append)
    got = own.generate([{"role": "system", "content": " s "}, {"role": "user", "content": "Return JSON please"}])
    assert got["content"] == '{"a": 1}' and got["total_tokens"] == 5 and naps == [2.0]
    assert asked[0]["system_instruction"] == "s" and [t["role"] for t in asked[1]["contents"]] == ["user", "model", "user"]
    asked.clear()
    assert own.generate([{"role": "user", "content": "plain"}])["content"] == "no" and len(asked) == 1
    assert adapters.ChatAdapter(providers.EchoGenerator())([{"role": "human", "content": ["a ", {"text": "b"}, {"image": 1}]}]) == "a b"


def test_rerank_smoke(spark):
    """One question, four documents, top 3; a score of zero stays, a missing one goes last."""
    rows = spark.createDataFrame([(0, i + 1, str(i), "what is risk", t, 0.5) for i, t in enumerate(["risk is", "no", "what risk is", "none"])], "query_id int, pos int, id string, query string, content string, score double")

    def send(request):
        return {"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "score": 0.0}, {"index": 9, "score": 1.0}]}

    make = adapters.make("reranker", "service", send=send, model="m")
    assert make().scores("q", ["a", "b", "c"]) == [0.0, None, 0.9]
    got = postprocess.rerank(rows, providers.rerank_scores(rows, make, 4), 4)
    assert [r["id"] for r in got.filter("pos <= 3").orderBy("pos").collect()] == ["2", "0", "1"]
    failing = adapters.make("reranker", "service", send=lambda r: 1 / 0, model="m")
    assert [r["id"] for r in postprocess.rerank(rows, providers.rerank_scores(rows, failing, 4), 4).orderBy("pos").collect()] == ["0", "1", "2", "3"]
    vectors = adapters.ServiceEmbedding(lambda r: {"embeddings": [[1.0, 2.0, 3.0]] * len(r["input"])}, "m")
    assert vectors.dimension() == 3


def test_pipeline_command(spark, tmp_path, capsys):
    with open(tmp_path / "r.jsonl", "w") as out:
        for i in range(4):
            out.write(json.dumps({"example_id": i, "source": f"src{i}_2020", "query": "q", "text": f"liquid assets of number {i} rose"}) + "\n")
    (tmp_path / "g.json").write_text(json.dumps([{"query": "liquid assets", "gold": [{"content": "liquid assets of number 2 rose"}]}]))
    where = f"file://{tmp_path}/c"
    assert cli.main(["pipeline", str(tmp_path / "r.jsonl"), "--chunks", str(tmp_path / "chunks"), "--collection", where, "--golden-path", str(tmp_path / "g.json"), "--k-values", "4", "--details", str(tmp_path / "details")]) == 0
    assert json.loads(capsys.readouterr().out.split("chunks\n", 1)[1])[0]["evidence_recall"] == 1.0
    details = spark.read.json(str(tmp_path / "details")).first()
    assert details["total_gold"] == 1 and sorted(r["gold_index"] is None for r in details["retrieved"]) == [False, True, True, True]
    assert evaluation.throughput(50, 200, 10.0) == "50/200 chunks, 5.0 chunks/s, 30 s left"


def test_dense_alone_and_named_vectors(spark):
    points = spark.createDataFrame([("a", "s", "text", [1.0, 0.0], [0.0, 1.0]), ("b", "s", "text", [0.0, 1.0], [1.0, 0.0])], "id string, source string, type string, vector array<double>, other array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, query_vec array<double>")
    assert search.named_vector(points, "none") is points
    for name, first in (("vector", "a"), ("other", "b"), ("none", "a")):
        assert [r["id"] for r in search.dense_topk(search.named_vector(points, name), asked, 1).collect()] == [first]


def test_small_expressions(spark):
    assert one(spark, tx.flatten_parts(F.array(F.struct(F.lit("a").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.lit("b").alias("text"))))) == "ab"
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x0", 1.0), ("y0", 2.25), ("x1", 3.0), ("y1", 4.0))])
    assert one(spark, tx.format_bbox(box)).startswith("(1.0, 2.") and "→ (3.0, 4.0)" in one(spark, tx.format_bbox(box))
    assert one(spark, tx.clean_local_path(F.lit("/app/data//x/y.csv"))) == "data/x/y.csv"
    assert one(spark, postprocess.table_path(F.lit("table"), F.lit(None).cast("string"), F.lit("T"))) == "data/csvs/T.csv"
    assert one(spark, postprocess.table_path(F.lit("text"), F.lit(None).cast("string"), F.lit("T"))) is None


def test_chunks_of_byte_pair_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    split = tx.bpe_tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    docs = spark.createDataFrame([(1, "Some words, é and more of them. " * 40), (2, None)], "doc_id long, text string")
    got = chunking.sliding_windows(docs, size=50, overlap=10, split=split, joint="").orderBy("offset").collect()
    assert got[0]["n_tokens"] == 50 and {r["doc_id"] for r in got} == {1} and got[0]["chunk"].startswith("Some words, é and")
    whole = chunking.paragraph_chunks(docs, size=10_000, overlap=0, split=split, joint="").filter("doc_id = 1").first()
    assert whole["chunk"] == docs.first()["text"]


def test_text_match_tests_a_chunk_in_its_own_row(spark, monkeypatch):
    """Queries of the same tokens are one, in parts too, and no join moves the chunks' sets."""
    chunks = spark.createDataFrame([(i, "alpha beta " + ("gamma" if i % 2 else "delta"), "oracle-corporation" if i % 3 == 0 else "x") for i in range(12)], "id long, content string, source string")
    asked = spark.createDataFrame([(1, "gamma beta", ["oracle-corporation"]), (2, "Beta gamma", []), (3, "gamma, beta", None), (4, "nothing", []), (5, "delta", ["oracle-corporation"])], "query_id int, query string, wanted array<string>")
    expected = {(1, 3, 1), (1, 9, 2), *((q, i, p) for q in (2, 3) for p, i in enumerate((1, 3, 5, 7), 1)), (5, 0, 1), (5, 6, 2)}
    found = search.text_match(chunks, asked, 4)
    assert {tuple(r) for r in found.collect()} == expected
    assert "array_except(asked" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(search, "MOST_QUERIES", 1)
    monkeypatch.setattr(search, "MOST_NAMED", 0)
    assert {tuple(r) for r in search.text_match(chunks, asked, 4).collect()} == expected
