"""Queries of vector cells, percentiles by group and judged answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions.vectors import hash_embedding
from rillmark.operators import quantiles, search
from rillmark.plans import judge
from rillmark.queries import _DENSE, _docs, _points, _query, _questions, _ranked, _scratch, _table
from rillmark.sources import cells


@_query("ann_exact", _ranked(_DENSE, 10))
def ann_exact(spark, sf_dir):
    """Exact search over k-means cells, whose bounds leave out what cannot be among the first ten."""
    points = _points(spark, sf_dir)
    index = cells.CellIndex.build(points, _scratch(spark, "cells"))
    return index.topk(_questions(points), 10, exact=True)


@_query("ann_recall")
def ann_recall(spark, sf_dir):
    """How many of each question's ten nearest points the nearest cells hold, as many cells as a sample needs."""
    points = _points(spark, sf_dir)
    index = cells.CellIndex.build(points, _scratch(spark, "cells"))
    asked = _questions(points)
    return cells.recall(index.topk(asked, 10, probes=index.probes_for(asked, 10)), search.dense_topk(points, asked, 10))


@_query("percentiles_by_group", " UNION ALL ".join(f"SELECT event_type, {s}::DOUBLE AS share, round(quantile_cont(value, {s}), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1" for s in (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)))
def percentiles_by_group(spark, sf_dir):
    """Exact percentiles of each group, by selection."""
    found = quantiles.exact_percentiles(_table(spark, sf_dir, "events").select("event_type", "value"), "value", [0.0, 0.25, 0.5, 0.9, 0.99, 1.0], ["event_type"])
    return found.withColumn("value", F.round("value", 6))


class ScriptedJudge:
    """Answers the judge's prompts by rule: lines are statements, a statement holds if a context has it, a
    context is useful if it has the answer's first word, the answer's first line is the question it answers."""

    def generate(self, messages):
        import json

        text = messages[-1]["content"]
        task, _, rest = text.partition("\n\n")
        part = lambda name: rest.split(f"{name}:\n", 1)[1].split("\n\n")[0]
        if task == judge.STATEMENTS:
            told = {"statements": [x for x in part("Text").split("\n") if x]}
        elif task == judge.SUPPORTED:
            known = {c.partition(". ")[2] for c in part("Contexts").split("\n")}
            told = {"verdicts": [int(s.partition(". ")[2] in known) for s in part("Statements").split("\n")]}
        elif task == judge.USEFUL:
            told = {"verdict": int(part("Answer").split(" ")[0] in part("Context").split(" "))}
        else:
            told = {"questions": [part("Answer").split("\n")[0]], "evasive": 0}
        content = json.dumps(told)
        return {"content": f"Here it is: {content}", "model": "scripted", "prompt_tokens": 1, "completion_tokens": 1}


@_query("judge_metrics", """
WITH d AS (SELECT doc_id AS id, lang || ' ' || source AS question, CASE WHEN doc_id % 7 <> 0 THEN source || chr(10) || lang || chr(10) || 'part' || (doc_id % 3) ELSE '' END AS answer,
  [lang, 'part' || (doc_id % 2), source || ' ' || lang, coalesce(source, '')] AS contexts, CASE WHEN doc_id % 5 <> 0 THEN lang || chr(10) || 'part1' END AS truth FROM documents),
s AS (SELECT *, list_filter(string_split(answer, chr(10)), lambda x: x <> '') AS said, list_filter(string_split(coalesce(truth, ''), chr(10)), lambda x: x <> '') AS true_said,
  string_split(CASE WHEN truth IS NOT NULL THEN truth ELSE answer END, chr(10))[1] AS target FROM d),
v AS (SELECT *, list_transform(contexts, lambda c: list_contains(string_split(c, ' '), string_split(CASE WHEN truth IS NOT NULL THEN truth ELSE answer END, ' ')[1])::INT) AS v FROM s)
SELECT id, CASE WHEN len(said) > 0 THEN round(len(list_filter(said, lambda x: list_contains(contexts, x)))::DOUBLE / len(said), 6) END AS faithfulness,
  CASE WHEN len(true_said) > 0 THEN round(len(list_filter(true_said, lambda x: list_contains(contexts, x)))::DOUBLE / len(true_said), 6) END AS context_recall,
  CASE WHEN list_sum(v) > 0 THEN round(list_sum(list_transform(range(1, 5), lambda i: CASE WHEN v[i] = 1 THEN list_sum(v[1:i])::DOUBLE / i ELSE 0 END)) / list_sum(v), 6) ELSE 0.0 END AS context_precision
FROM v
""")
def judge_metrics(spark, sf_dir):
    """Judged metrics of answers made from all documents, by a scripted generator."""
    k = F.col("doc_id")
    lines = lambda *c: F.concat_ws("\n", *c)
    part = lambda n: F.concat(F.lit("part"), (k % n).cast("string"))
    data = _docs(spark, sf_dir).select(
        k.alias("id"),
        F.concat_ws(" ", "lang", "source").alias("question"),
        F.when(k % 7 != 0, lines("source", "lang", part(3))).otherwise("").alias("answer"),
        F.array(F.col("lang"), part(2), F.concat_ws(" ", "source", "lang"), F.coalesce("source", F.lit(""))).alias("contexts"),
        F.when(k % 5 != 0, lines("lang", F.lit("part1"))).alias("ground_truth"),
    )
    found = judge.judge(data, ScriptedJudge, lambda c: hash_embedding(c), callers=4)
    return found.select("id", "faithfulness", "context_recall", "context_precision")
