"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are runs of digits, a-z and non-ASCII characters after A-Z became lower case.  Of
all hashes of k consecutive words, winnowing keeps the smallest in every window of w neighbours, so
two texts that share w + k - 1 consecutive words share a kept hash.  Training and test fingerprints
are joined; a document's windows around a hit are then compared word by word with the test
windows, which extends each hit to all of its shared words.  A test item of fewer words than a
window is one window of its own length, found in the same way.

Arrays are exploded with ``explode_outer`` and never filtered by their size: such a filter would be
pushed below the projection that computes the array, with the whole computation copied into the
lambda that reads it.

Test windows are broadcast only below a checked size; beyond it the same joins shuffle.

Defined cases: a null text has no words; an item without words matches nothing; equal items all
count; rows that repeat an identifier each get their own result; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.shared import fresh_names, materialize, settle, small

WINDOW = 10
GRAM = 5
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words with each byte from 0x80 on as one Latin-1 character.

    Lower-casing that form touches A-Z and, injectively, the lead bytes of longer characters, so
    equality of words is that of the original with A-Z lower-cased.
    """
    latin = F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")
    return F.array_remove(F.split(F.lower(latin), _BREAK), "")


def _gram_hashes(words: str, k: int) -> Column:
    """Hashes of k consecutive words of the array column named ``words``."""
    hashed = F.col(words)
    grams = F.transform(F.sequence(F.lit(1), F.size(hashed) - (k - 1)), lambda i: F.xxhash64(*[F.get(hashed, i + (j - 1)) for j in range(k)]))
    return F.when(F.size(hashed) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def _with_grams(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (words, ...) with hashes of the words, and of k consecutive ones for each k that is needed."""
    rows = rows.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    return rows.withColumns({f"grams_{k}": _gram_hashes("hashes", k) for k in sorted({min(GRAM, length) for length in lengths})})


def _fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (key..., words) -> (key..., length, print): distinct winnowed hashes of each row, for
    windows of each length; texts are read and hashed once for all of them."""

    def winnowed(length: int) -> Column:
        k = min(GRAM, length)
        w, grams = length - k + 1, F.col(f"grams_{k}")
        least = F.transform(F.sequence(F.lit(1), F.size(grams) - (w - 1)), lambda i: F.array_min(F.slice(grams, i, w)))
        prints = F.when(F.size(grams) >= w, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(prints, lambda p: F.struct(F.lit(length).alias("length"), p.alias("print")))

    keys = [c for c in rows.columns if c != "words"]
    each = F.flatten(F.array(*[winnowed(length) for length in lengths]))
    return _with_grams(rows, lengths).select(*keys, F.explode_outer(each).alias("x")).filter(F.col("x").isNotNull()).select(*keys, "x.length", "x.print")


def _small(texts: DataFrame) -> bool:
    """Whether test windows (window) are few and short enough for a broadcast."""
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window").cast("long")), F.lit(0).cast("long"))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, length, window): the distinct windows of each item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), word_list(F.col(text_col)).alias("words"))
    length = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    texts = F.transform(starts, lambda i: F.array_join(F.slice(F.col("words"), i, F.least(F.lit(window), F.size("words"))), " "))
    texts = F.when(F.size("words") > 0, F.array_distinct(texts))
    return items.select("item_id", length.alias("length"), F.explode_outer(texts).alias("window")).filter(F.col("window").isNotNull())


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: row_id, n_words, n_hit, items (sorted strings)."""
    source = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    found = _shared_windows(source, benchmark, item_col, item_text_col, window)
    if found is None:
        return source.select("row_id", F.size(word_list(F.col("body"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    shared, windows = found

    positions = F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
    covered = shared.groupBy("row_id", "body_hash").agg(positions.alias("positions"))
    covered = covered.select("row_id", "body_hash", F.size(F.array_distinct("positions")).cast("long").alias("n_hit"))
    owners = windows.select("window", "item_id")
    items = shared.select("row_id", "body_hash", "window").distinct().join(_sized(owners, _small(owners)), "window").groupBy("row_id", "body_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = covered.join(items, (covered.row_id.eqNullSafe(items.row_id)) & (covered.body_hash == items.body_hash)).select(covered.row_id.alias("hit_id"), covered.body_hash.alias("hit_hash"), "n_hit", "items")

    each = source.select("row_id", _text_hash(F.col("body")).alias("body_hash"), F.size(word_list(F.col("body"))).cast("long").alias("n_words"))
    return each.join(hits, each.row_id.eqNullSafe(hits.hit_id) & (each.body_hash == hits.hit_hash), "left").select("row_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _text_hash(body: Column) -> Column:
    return F.xxhash64(F.coalesce(body, F.lit("")))


def _shared_windows(source: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> tuple[DataFrame, DataFrame] | None:
    """(row_id, body_hash, start, length, window) of the windows that rows (row_id, body) share with
    items, and the items' windows; None if no item has a word."""
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``window`` values
    if not lengths:
        return None
    texts = windows.select("length", "window").distinct()
    few = _small(texts)

    def found() -> DataFrame:
        prints = None
        for length in lengths:
            own = _fingerprints(texts.filter(F.col("length") == length).select(F.split("window", " ").alias("words")), [length]).distinct()
            prints = own if prints is None else prints.unionByName(own)
        rows = source.select("row_id", word_list(F.col("body")).alias("words"))
        hits = _fingerprints(rows, lengths).join(_sized(prints, few), ["length", "print"])
        hits = materialize(hits.groupBy("row_id", "length").agg(F.collect_set("print").alias("prints")), "fingerprint-hits")
        hit = small(hits.select(F.col("row_id").alias("hit_id")).distinct(), hits)
        near = materialize(source.join(hit, source.row_id.eqNullSafe(hit.hit_id), "left_semi"), "hit-texts")
        shared = None
        for length in lengths:
            part = _extend(near, hits.filter(F.col("length") == length).drop("length"), _sized(texts.filter(F.col("length") == length).select("window"), few), length)
            shared = part if shared is None else shared.unionByName(part)
        return shared

    return settle(found, "benchmark-hits"), windows


def _extend(source: DataFrame, hit: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """Windows of documents around shared fingerprints that equal a test window in every word."""
    k = min(GRAM, length)
    w = length - k + 1
    hit = hit.withColumnRenamed("row_id", "hit_id")
    rows = source.join(hit, source.row_id.eqNullSafe(hit.hit_id)).select("row_id", _text_hash(F.col("body")).alias("body_hash"), "prints", word_list(F.col("body")).alias("words"))
    grams, words = F.col(f"grams_{k}"), F.col("words")
    at = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda p: F.array_contains(F.col("prints"), F.get(grams, p - 1)))
    rows = _with_grams(rows, [length]).withColumn("at", F.when(F.size(grams) >= w, at).otherwise(F.array().cast("array<int>")))
    around = F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.lit(1), p - (w - 1)), p)))
    rows = rows.withColumn("starts", F.array_distinct(around))
    cut = F.transform(F.filter("starts", lambda s: s + (length - 1) <= F.size(words)), lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s, length), " ").alias("window")))
    each = rows.select("row_id", "body_hash", F.explode_outer(cut).alias("cut")).filter(F.col("cut").isNotNull()).select("row_id", "body_hash", "cut.start", F.lit(length).alias("length"), "cut.window")
    return each.join(windows, "window").select("row_id", "body_hash", "start", "length", "window")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with a benchmark item, with their columns."""
    source = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body"))
    found = _shared_windows(source, benchmark, "item_id", "text", WINDOW)
    if found is None:
        return docs
    hit, text_hash = fresh_names(docs, "hit", "text_hash")
    gone = small(found[0].select(F.col("row_id").alias(hit), F.col("body_hash").alias(text_hash)).distinct(), found[0])
    return docs.join(gone, docs[id_col].eqNullSafe(F.col(hit)) & (_text_hash(docs[text_col]) == F.col(text_hash)), "left_anti")
