"""Judged metrics, the rate budget of a job, progress, and the fall back to dense search."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rillmark import adapters, providers
from rillmark.config import RetrievalConfig
from rillmark.functions.vectors import hash_embedding
from rillmark.plans import judge, rag
from rillmark.progress import Progress


class Script:
    """Answers by the task and the texts that a prompt holds; raises or talks where a text says so."""

    def generate(self, messages):
        text = messages[-1]["content"]
        if "RAISE" in text:
            raise RuntimeError("no service")
        if "PROSE" in text:
            return {"content": "I cannot say.", "completion_tokens": 3}
        task = text.split("\n\n")[0]
        if task == judge.STATEMENTS:
            told = {"statements": text.split("Text:\n")[1].split(". ")}
        elif task == judge.SUPPORTED:
            contexts, statements = text.split("Contexts:\n")[1].split("\n\nStatements:\n")
            told = {"verdicts": [int(s.split(". ", 1)[1] in contexts) for s in statements.split("\n")]}
            if "SHORT" in statements:
                told["verdicts"].pop()
        elif task == judge.USEFUL:
            told = {"verdict": int("useful" in text.split("Context:\n")[1])}
        else:
            answer = text.split("Answer:\n")[1]
            told = {"questions": [answer.split(". ")[0], "something else"], "evasive": int("evasive" in answer)}
        return {"content": f"```json\n{json.dumps(told)}\n```", "completion_tokens": 1}


def test_judged_metrics(spark):
    rows = [
        (0, "cats purr", "cats purr. dogs bark", ["cats purr", "useful", "none", "useful too"], "cats purr. fish swim. useful"),
        (1, "q", "evasive", ["none", "nothing"], None),
        (2, "q", "RAISE. x", ["useful"], "PROSE"),
        (3, "q", "", [], ""),
        (4, "q", None, None, None),
        (5, "q", "SHORT. a", ["a", "RAISE"], "a"),
    ]
    data = spark.createDataFrame(rows, "id long, question string, answer string, contexts array<string>, ground_truth string")
    got = {r["id"]: r for r in judge.judge(data, Script, lambda c: hash_embedding(c), callers=3).collect()}
    names = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
    assert {i: tuple(r[n] for n in names) for i, r in got.items()} == {
        0: (0.5, pytest.approx(0.5, abs=0.3), pytest.approx((1 / 2 + 2 / 4) / 2), pytest.approx(2 / 3, abs=1e-6)),
        1: (0.0, 0.0, 0.0, None),
        2: (None, None, None, None),
        3: (None, None, None, None),
        4: (None, None, None, None),
        5: (None, pytest.approx(0.0, abs=0.5), None, None),  # a context that raises is in both prompts
    }
    assert judge.judge(data.limit(0), Script, lambda c: hash_embedding(c)).count() == 0


class Recorded:
    """A clock of its own for each task: waiting moves it; calls leave their times in a folder."""

    def __init__(self, folder, per_minute):
        self.now, self.folder = 0.0, folder
        self.inner = adapters.CandidateGenerator(self._send, "m", per_minute, clock=lambda: self.now, sleep=self._sleep)

    def _sleep(self, seconds):
        self.now += seconds

    def _send(self, request):
        with open(f"{self.folder}/{os.getpid()}-{id(self)}", "a", encoding="utf-8") as out:
            out.write(f"{self.now}\n")
        return {"candidates": [{"parts": [{"text": "ok"}]}]}

    def share(self, callers):
        self.inner.share(callers)

    def generate(self, messages):
        return self.inner.generate(messages)


@pytest.mark.parametrize("callers", [1, 4])
def test_tasks_keep_to_one_budget_together(spark, tmp_path, callers):
    folder = str(tmp_path)
    rows = spark.range(40).repartition(8).select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    assert providers.generate(rows, lambda: Recorded(folder, 60.0), callers=callers).filter("answer = 'ok'").count() == 40
    calls = sorted(float(x) for name in os.listdir(folder) for x in open(f"{folder}/{name}", encoding="utf-8"))
    assert len(calls) == 40
    for begin in calls:  # 60 a minute: in no ten seconds more than ten calls, and one begun by each caller
        assert sum(begin <= c < begin + 10 for c in calls) <= 10 + callers


def test_progress_counts_rows_once(spark):
    lines = []
    rows = spark.range(0, 1000, 1, 4)
    with Progress(spark, 2000, every=0.05, show=lines.append) as progress:
        counted = progress.counted(rows)
        assert counted.agg(F.sum("id")).first()[0] == 499500
        first = progress.rows()
        counted.count()  # the same partitions again
    assert first == progress.rows() == 1000
    assert lines[-1].startswith("1000/2000 chunks")


def test_a_failing_text_leg_leaves_dense_search(spark):
    texts = ["alpha words", "beta words", "gamma things", "alpha beta"]
    points = spark.createDataFrame([(str(i), t, f"d{i}", f"d{i}", "text") for i, t in enumerate(texts)], "id string, content string, source string, doc_id string, type string").withColumn("vector", hash_embedding(F.col("content")).cast("array<float>"))
    points = points.withColumns({"page": F.lit(1), "chunk_id": F.lit(0)}).withColumns({c: F.lit(None).cast("string") for c in ("company", "fiscal_year", "section_name", "section_path", "table_id", "table_title", "row_label", "column_label")}).withColumns({c: F.lit(None).cast("array<string>") for c in ("keywords_hit", "tags")})
    asked = spark.createDataFrame([(0, "alpha words")], "query_id int, query string").withColumn("query_vec", hash_embedding(F.col("query")).cast("array<float>"))

    def at_plan(queries, k):
        raise RuntimeError("no index")

    def at_run(queries, k):
        return queries.select("query_id", F.raise_error(F.lit("service gone")).cast("string").alias("id"), F.lit(1).alias("pos"))

    only_last = lambda queries, k: queries.select("query_id", F.lit("2").alias("id"), F.lit(1).alias("pos"))
    ids = lambda **more: {r["id"] for r in rag.retrieve(points, asked, RetrievalConfig(top_k=4), **more).collect()}
    dense = {r["id"] for r in rag.retrieve(points, asked, RetrievalConfig(top_k=4, hybrid_search=False)).collect()}
    assert ids(text_leg=at_plan) == ids(text_leg=at_run) == dense and "2" not in dense
    assert "2" in ids(text_leg=only_last)
