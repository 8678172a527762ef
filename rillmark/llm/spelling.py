"""Spelling variants: every word's neighbours at one edit, found by generating its whole neighbourhood.

Vocabulary: the words of at least ``least_length`` code points and ``least_count`` occurrences, each
occurrence after the deletion that the contract plants (``planted``).  For each word all distinct
deletions, replacements and insertions over the observed alphabet are generated; what is in the
vocabulary is a near word, and no distance is computed.

Generation is arithmetic: a word's hash is the sum of its code points' values times powers, so the
hash of each candidate follows from sums of the word's parts, and a thousand candidates are a few
vector operations.  Hashes are first asked in a filter of the vocabulary (WORD_BITS bits a word, MOST_BITS at
most: a fixed size, the only thing that is broadcast), the few that pass are spelled out and joined to the
vocabulary as strings, so neither the filter nor a collision of hashes decides anything.  Where the
vocabulary outgrows the filter more candidates are joined, and the result is the same.

No key is hot: occurrences are summed in the tasks before the shuffle, and a candidate has at most as
many sources as a word has neighbours.

Defined cases: null texts have no words; a null identifier plants nothing; rows that repeat count
again; ties of count go to the first word in code-point order; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.shared import discard, lean, materialize, partitions
from rillmark.llm.words import mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
PLANTED = 31
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: Words that a task counts before it hands them on.
HELD = 200_000
WORD_BITS, MOST_BITS = 24, 1 << 27
_VALUE = mix(np.arange(1, 0x101, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def planted(text: str | None, key: str | None) -> Iterator[tuple[str, int]]:
    """Words of a text with their counts, after the contract's deletions."""
    for run, n in Counter(RUN.findall((text or "").translate(_LOWER))).items():
        if key is not None:
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % PLANTED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, over whole texts."""
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))

    def batch(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for rows in batches:
            for key, text in zip(rows.column(0), rows.column(1), strict=True):
                for word, n in planted(text.as_py(), key.as_py()):
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield batch(held)
                    held = {}
        yield batch(held)

    counted = rows.mapInArrow(lean(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _code(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("latin-1"), np.uint8)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word: its code points' values times powers of the base, mixed."""
    sums = np.zeros(len(words), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, places in by_length.items():
        codes = _code("".join(words[i] for i in places)).reshape(len(places), length)
        sums[places] = (_VALUE[codes] * _powers(max(1, length))[:length]).sum(1, dtype=np.uint64)
    return mix(sums)


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All distinct candidates of words of one length (a row each): hash, row, edit and place.

    An edit is -1 for a deletion, a code point for a replacement and 256 more for an insertion.
    Deleting any of a run of equal letters is one candidate, as is inserting a letter anywhere along
    a run of itself; replacing a letter by itself is none."""
    rows, length = codes.shape
    powers = _powers(length + 1)
    term = _VALUE[codes] * powers[:length]
    before = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(term, axis=1, dtype=np.uint64, out=before[:, 1:])
    total = before[:, -1:]
    after = total - before
    down = np.uint64(pow(_BASE, -1, 2**64))
    letters = _VALUE[alphabet]
    place = np.arange(length)
    # deletion: what follows moves down by one place
    deleted = before[:, :-1] + after[:, 1:] * down
    once = np.ones((rows, length), bool)
    once[:, 1:] = codes[:, 1:] != codes[:, :-1]
    # replacement
    replaced = (total - term)[:, :, None] + powers[:length, None] * letters
    other = codes[:, :, None] != alphabet
    # insertion before each place and at the end: what follows moves up
    moved = before + after * np.uint64(_BASE)
    inserted = moved[:, :, None] + powers[:, None] * letters
    fresh = np.ones((rows, length + 1, len(alphabet)), bool)
    fresh[:, 1:] = other
    r, p = np.nonzero(once)
    out = [(deleted[once], r, np.full(len(r), -1), place[p])]
    for values, good, shift in ((replaced, other, 0), (inserted, fresh, 256)):
        r, p, a = np.nonzero(good)
        out.append((values[good], r, alphabet[a].astype(np.int64) + shift, p))
    sums, row, edit, at = (np.concatenate(x) for x in zip(*out, strict=True))
    return mix(sums), row, edit, at


def apply_edit(word: str, edit: int, at: int) -> str:
    if edit < 0:
        return word[:at] + word[at + 1 :]
    return word[:at] + chr(edit & 255) + word[at + (edit < 256) :]


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a filter of a power of two of bits."""
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32) ^ h >> np.uint64(7)) & mask


def word_filter(words: DataFrame, n_words: int) -> np.ndarray:
    """Bits of both places of every word, as 64-bit cells; made in the tasks, merged by ``bit_or``."""
    bits = 1 << 10
    while bits < min(MOST_BITS, WORD_BITS * n_words):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate(_slots(hashes(batch.column(0).to_pylist()), bits))
            own = np.zeros(bits // 64, np.uint64)
            np.bitwise_or.at(own, found >> np.uint64(6), np.uint64(1) << (found & np.uint64(63)))
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(own[used].view(np.int64), pa.int64())], names=["cell", "bits"])

    cells = words.select("word").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits"))
    out = np.zeros(bits // 64, np.uint64)
    for batch in cells.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def candidates(words: DataFrame, n_words: int) -> DataFrame:
    """(source, word): candidates that pass the filter, each once."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint8)  # at most 90 letters
    asked = spark.sparkContext.broadcast(word_filter(words, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = asked.value
        bits = len(cells) * 64

        def known(h: np.ndarray) -> np.ndarray:
            out = np.arange(len(h))
            for slot in (0, 1):
                at = _slots(h[out], bits)[slot]
                out = out[(cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
            return out

        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for word in batch.column(0).to_pylist():
                by_length.setdefault(len(word), []).append(word)
            for length, group in by_length.items():
                step = max(1, (1 << 18) // (2 * (length + 1) * max(1, len(alphabet))))
                for k in range(0, len(group), step):
                    own = group[k : k + step]
                    h, row, edit, at = neighbourhood(_code("".join(own)).reshape(len(own), length), alphabet)
                    good = known(h)
                    sources = [own[i] for i in row[good]]
                    made = [apply_edit(w, e, p) for w, e, p in zip(sources, edit[good].tolist(), at[good].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(made, pa.string())], names=["source", "word"])

    dealt = words.select("word").repartition(partitions(spark), "word")
    return dealt.mapInArrow(lean(run), "source string, word string")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary.

    ``form`` is the near word with the largest count if that is ``factor`` times the word's own or
    more; ``root`` follows forms to the last.  A form's count is ``factor`` times larger at each step, so a
    chain is short, and the places of a chain are doubled until nothing moves."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    n_words = words.count()
    met = candidates(words, n_words).join(words, "word")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))).alias("best")
    near = met.groupBy(F.col("source").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    clear = -F.col("best.less") >= factor * F.col("n")
    told = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(clear, F.col("best.word")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n")), "forms")
    roots = materialize(told.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = moved.select("word", "root")
        roots._rillmark_path = moved._rillmark_path
        if moved.filter("moved").isEmpty():
            break
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
