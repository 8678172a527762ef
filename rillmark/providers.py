"""Models as plug-ins: embedding, reranking, generation, judging.

A provider is a class with the methods of its protocol; a task makes one and keeps it.  The ones
here need no model and always give the same output, so that plans can be tested offline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmbeddingProvider(Protocol):
    def dimension(self) -> int: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float | None]: ...


class Generator(Protocol):
    def generate(self, messages: list[dict[str, str]]) -> dict: ...


class HashEmbedding:
    """Counts of tokens by hashed bucket, as functions.vectors.hash_embedding."""

    def __init__(self, size: int = 64):
        self.size = size

    def dimension(self) -> int:
        return self.size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in enumerate(texts):
            for token in text.lower().split():
                out[row, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.size] += 1
        return out


class OverlapReranker:
    """Share of the question's words that a text holds."""

    def scores(self, query: str, texts: list[str]) -> list[float | None]:
        asked = set(query.lower().split())
        return [len(asked & set(t.lower().split())) / len(asked) if asked else None for t in texts]


class EchoGenerator:
    """Answers with the first line of the last message; counts words as tokens."""

    def generate(self, messages: list[dict[str, str]]) -> dict:
        words = sum(len((m["content"] or "").split()) for m in messages)
        answer = (messages[-1]["content"] or "").strip().split("\n")[0] if messages else ""
        return {"content": answer, "model": "echo", "prompt_tokens": words, "completion_tokens": len(answer.split())}


def embed(rows: DataFrame, make: Callable[[], EmbeddingProvider], text_col: str, vector_col: str = "vector", batch: int = 128, normalize: bool = False) -> DataFrame:
    """``rows`` with vectors; texts of like length share a batch, the order of rows stays."""
    schema = T.StructType([*rows.schema.fields, T.StructField(vector_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for part in batches:
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            out = np.zeros((len(texts), provider.dimension()), np.float32)
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                out[own] = provider.embed([texts[j] for j in own])
            if normalize:
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(out), pa.list_(pa.float32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def rerank_scores(rows: DataFrame, make: Callable[[], Reranker], top_n: int) -> DataFrame:
    """(query_id, pos, rerank_score) of the first ``top_n`` rows; a reranker that fails scores none."""
    held = rows.filter(F.col("pos") <= top_n).groupBy("query_id").agg(F.max("query").alias("query"), F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("docs"))  # top_n rows a query

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for part in batches:
            out = []
            for row in part.to_pylist():
                try:
                    scores = provider.scores(row["query"], [d["content"] for d in row["docs"]])
                except Exception:  # whatever a remote reranker raises, the list keeps its order
                    continue
                out += [(row["query_id"], d["pos"], s) for d, s in zip(row["docs"], scores, strict=True)]
            if out:
                q, p, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, part.schema.field("query_id").type), pa.array(p, pa.int32()), pa.array(s, pa.float64())], names=["query_id", "pos", "rerank_score"])

    kind = rows.schema["query_id"].dataType.simpleString()
    return held.mapInArrow(run, f"query_id {kind}, pos int, rerank_score double")


RESPONSE = T.StructType([T.StructField("answer", T.StringType()), T.StructField("model", T.StringType()), T.StructField("usage", T.StructType([T.StructField(n, T.IntegerType()) for n in ("prompt_tokens", "completion_tokens", "total_tokens")]))])


def generate(rows: DataFrame, make: Callable[[], Generator], attempts: int = 3, callers: int | None = None, failures: bool = False) -> DataFrame:
    """``rows`` (with messages) and answer, model, usage; an empty answer without tokens is asked again.

    With ``callers`` the rows are dealt to so many tasks, and a provider that has a rate limit gets that part
    of it (``share``), so all tasks together keep to it whatever runs at once.  With ``failures`` a
    provider that raises gives an empty answer instead of ending the job."""
    if callers is not None:
        rows = rows.repartition(callers)
    schema = T.StructType([*rows.schema.fields, *RESPONSE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        if callers is not None and hasattr(provider, "share"):
            provider.share(callers)
        for part in batches:
            answers = []
            for messages in part.column("messages").to_pylist():
                for _ in range(attempts):
                    try:
                        found = provider.generate(messages)
                    except Exception:
                        if not failures:
                            raise
                        found = {}
                    prompt, completion = found.get("prompt_tokens") or 0, found.get("completion_tokens") or 0
                    total = found.get("total_tokens") or prompt + completion
                    if found.get("content") or total:
                        break
                answers.append((found.get("content") or "", found.get("model"), {"prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": total}))
            answer, model, usage = zip(*answers, strict=True) if answers else ((), (), ())
            kind = pa.struct([(n, pa.int32()) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answer, pa.string()), pa.array(model, pa.string()), pa.array(usage, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def lexical_judge(answers: DataFrame) -> DataFrame:
    """Offline stand-ins for a judge's scores: shares of words, named for what they are.

    answer_in_contexts, question_in_answer, truth_in_contexts (null without a truth)."""

    def words(c):
        return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))

    def share(a, b):
        return F.round(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), 6)

    context = words(F.array_join("contexts", " "))
    truth = F.nullif(F.col("ground_truth"), F.lit(""))
    return answers.withColumns({"answer_in_contexts": share(words(F.col("answer")), context), "question_in_answer": share(words(F.col("question")), words(F.col("answer"))), "truth_in_contexts": F.when(truth.isNotNull(), share(words(truth), context))})
