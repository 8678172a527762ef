"""Prompts, messages and citations as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.text import basename

#: The texts around contexts and question.
SYSTEM = "You are a helpful assistant that answers questions based on provided contexts."
OPENING = "You are a helpful assistant. Answer the user's question based on the provided contexts."
CLOSING = "Answer: Provide a detailed and accurate answer based on the contexts above. If the contexts don't contain enough information to answer the question, say so."
#: Phrases of a user's message that ask for JSON.
STRUCTURED_PHRASES = [
    "json schema",
    "json format",
    "output json",
    "return json",
    "strict json",
    "please return the output in a json",
    "comply with the following schema",
    "application/json",
]


def prompt(query: Column, contexts: Column) -> Column:
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("Context "), (i + 1).cast("string"), F.lit(":\n"), c))
    return F.concat(F.lit(OPENING + "\n\n"), F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), query, F.lit("\n\n" + CLOSING))


def messages(query: Column, contexts: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), prompt(query, contexts).alias("content")))


def collect_contexts(rows: DataFrame, limit: int = 5, content_col: str = "content") -> DataFrame:
    """query_id, contexts: the contents of each list's first rows, in order."""
    kept = rows.filter(F.col("pos") <= limit) if limit > 0 else rows
    held = F.array_sort(F.collect_list(F.struct("pos", F.col(content_col).alias("content"))))
    return kept.groupBy("query_id").agg(F.transform(held, lambda x: x["content"]).alias("contexts"))


def citations(rows: DataFrame) -> DataFrame:
    """query_id, citations: numbered sources and pages of each list."""
    line = F.concat(basename(F.col("source")), F.lit(" (Page "), F.coalesce(F.col("page").cast("string"), F.lit("N/A")), F.lit(")"))
    held = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    lines = F.transform(held, lambda x, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), x["line"]))
    return rows.groupBy("query_id").agg(F.concat(F.lit("\n\n---\n**Sources:**\n"), F.array_join(lines, "")).alias("citations"))


def chat_role(role: Column) -> Column:
    return F.when(role.isin("ai", "assistant"), "assistant").when(role == "system", "system").otherwise("user")


def split_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, system_instruction (system texts by lines, null if none), contents (role user or model,
    text) of a chat; blank messages are left out."""
    content = F.trim(F.coalesce("text", F.lit("")))
    kept = turns.withColumn("content", content).filter("content <> ''")
    held = F.array_sort(F.collect_list(F.struct(order, "role", "content")))
    both = kept.groupBy(key).agg(held.alias("held"))
    system = F.transform(F.filter("held", lambda x: x["role"] == "system"), lambda x: x["content"])
    rest = F.transform(F.filter("held", lambda x: x["role"] != "system"), lambda x: F.struct(F.when(x["role"] == "assistant", "model").otherwise("user").alias("role"), x["content"].alias("text")))
    return both.select(key, F.when(F.size(system) > 0, F.array_join(system, "\n")).alias("system_instruction"), rest.alias("contents"))


def expects_structure(all_messages: Column) -> Column:
    """Whether a user's message asks for JSON."""
    phrases = F.array(*[F.lit(p) for p in STRUCTURED_PHRASES])
    return F.exists(all_messages, lambda m: (m["role"] == "user") & F.exists(phrases, lambda p: F.contains(F.lower(F.coalesce(m["content"], F.lit(""))), p)))
