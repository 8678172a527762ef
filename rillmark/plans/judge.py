"""Answers judged by a generator: statements, verdicts on each, and their shares.

A step writes one message for each row, a generator answers with JSON, and the verdicts are aggregated;
so a step is one pass over independent calls, however many questions there are.  An answer that is no JSON of
the wanted form makes that question's metric null and no other.

* faithfulness: share of the answer's statements that the contexts support;
* answer_relevancy: mean cosine of the question with questions that the answer answers; 0 for an evasive answer;
* context_precision: mean precision at the ranks of the contexts that were useful for the truth (without
  a truth: for the answer);
* context_recall: share of the truth's statements that the contexts hold; null without a truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark import providers
from rillmark.functions.text import repair_json
from rillmark.functions.vectors import cosine

DIGITS = 6
STATEMENTS = "Break the text into short statements that each can be understood alone. Return JSON: {\"statements\": [\"...\"]}."
SUPPORTED = "Decide for each statement whether it follows from the contexts alone. Return JSON: {\"verdicts\": [0 or 1 for each statement, in order]}."
USEFUL = "Decide whether the context was useful to arrive at the answer. Return JSON: {\"verdict\": 0 or 1}."
QUESTIONS = "Write {n} questions that the answer answers, and say whether it is evasive. Return JSON: {\"questions\": [\"...\"], \"evasive\": 0 or 1}."


def _message(task: str, **parts: Column) -> Column:
    text = [F.lit(task)]
    for name, value in parts.items():
        text += [F.lit(f"\n\n{name}:\n"), F.coalesce(value, F.lit(""))]
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(*text).alias("content")))


def ask(rows: DataFrame, message: Column, schema: str, make: Callable[[], providers.Generator], callers: int | None = None, name: str = "told") -> DataFrame:
    """``rows`` with a struct ``name``: the generator's JSON answer to the message, null if it is none."""
    asked = providers.generate(rows.withColumn("messages", message), make, callers=callers, failures=True)
    return asked.withColumn(name, F.from_json(repair_json(F.col("answer")), schema, {"mode": "PERMISSIVE"})).drop("messages", "answer", "model", "usage")


def _numbered(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def _statement_share(rows: DataFrame, text: Column, make, callers, name: str) -> DataFrame:
    """(id, name): the share of a text's statements that the contexts support."""
    first = ask(rows.filter(F.coalesce(F.trim(text), F.lit("")) != "").select("id", "contexts", "question", text.alias("body")), _message(STATEMENTS, Question=F.col("question"), Text=F.col("body")), "statements array<string>", make, callers)
    stated = first.select("id", "contexts", F.filter("told.statements", lambda s: F.coalesce(F.trim(s), F.lit("")) != "").alias("statements")).filter(F.size("statements") > 0)
    second = ask(stated, _message(SUPPORTED, Contexts=_numbered(F.col("contexts")), Statements=_numbered(F.col("statements"))), "verdicts array<int>", make, callers)
    good = (F.size("told.verdicts") == F.size("statements")) & F.forall("told.verdicts", lambda v: v.isin(0, 1))
    share = F.aggregate("told.verdicts", F.lit(0), lambda s, v: s + v) / F.size("statements")
    return second.select("id", F.when(good, F.round(share, DIGITS)).alias(name))


def faithfulness(rows: DataFrame, make, callers: int | None = None) -> DataFrame:
    return _statement_share(rows, F.col("answer_text"), make, callers, "faithfulness")


def context_recall(rows: DataFrame, make, callers: int | None = None) -> DataFrame:
    return _statement_share(rows, F.col("ground_truth"), make, callers, "context_recall")


def context_precision(rows: DataFrame, make, callers: int | None = None) -> DataFrame:
    target = F.coalesce(F.nullif(F.trim("ground_truth"), F.lit("")), F.col("answer_text"))
    each = rows.select("id", "question", target.alias("target"), F.posexplode("contexts").alias("at", "context"))
    told = ask(each, _message(USEFUL, Question=F.col("question"), Answer=F.col("target"), Context=F.col("context")), "verdict int", make, callers)
    verdict = F.when(F.col("told.verdict").isin(0, 1), F.col("told.verdict"))
    lists = told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(verdict, F.lit(-1)).alias("v")))), lambda x: x["v"]).alias("v"))  # a question's contexts
    found = lambda i: F.aggregate(F.slice("v", 1, i + 1), F.lit(0), lambda s, x: s + x)
    at_useful = F.transform("v", lambda x, i: F.when(x == 1, found(i) / (i + 1)).otherwise(0.0))
    useful = F.size(F.filter("v", lambda x: x == 1))
    mean = F.when(useful > 0, F.round(F.aggregate(at_useful, F.lit(0.0), lambda s, x: s + x) / useful, DIGITS)).otherwise(0.0)
    return lists.select("id", F.when(~F.array_contains("v", -1), mean).alias("context_precision"))


def answer_relevancy(rows: DataFrame, make, embed: Callable[[Column], Column], n: int = 3, callers: int | None = None) -> DataFrame:
    own = rows.filter(F.coalesce(F.trim("answer_text"), F.lit("")) != "").select("id", "question", "answer_text")
    told = ask(own, _message(QUESTIONS.replace("{n}", str(n)), Answer=F.col("answer_text")), "questions array<string>, evasive int", make, callers)
    good = told.filter((F.size("told.questions") > 0) & F.col("told.evasive").isin(0, 1))
    each = good.select("id", "question", F.col("told.evasive").alias("evasive"), F.explode("told.questions").alias("other"))
    alike = F.coalesce(cosine(embed(F.col("question")), embed(F.col("other"))), F.lit(0.0))
    means = each.withColumn("alike", F.round(alike, 9)).groupBy("id").agg(F.avg("alike").alias("mean"), F.max("evasive").alias("evasive"))
    return means.select("id", F.when(F.col("evasive") == 1, 0.0).otherwise(F.round("mean", DIGITS)).alias("answer_relevancy"))


def judge(data: DataFrame, make: Callable[[], providers.Generator], embed: Callable[[Column], Column], callers: int | None = None) -> DataFrame:
    """``data`` (id, question, answer, contexts, ground_truth) with the four metrics."""
    rows = data.select("id", "question", F.col("answer").alias("answer_text"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), "ground_truth")
    out = data
    for found in (faithfulness(rows, make, callers), answer_relevancy(rows, make, embed, callers=callers), context_precision(rows, make, callers), context_recall(rows, make, callers)):
        out = out.join(found, "id", "left")
    return out
