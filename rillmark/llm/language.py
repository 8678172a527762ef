"""Language identification with blended-spectrum string kernels.

The kernel of two texts counts the byte n-grams of one to four bytes that both contain, normalised
by the geometric mean of each text with itself.  A bounded sample of labelled rows is learned from:
some of them are landmarks, the Nystroem map takes every text to its kernel with the landmarks
times the inverse root of the landmarks' own kernel matrix, and kernel ridge regression, one
language against the rest, is solved there.  n-grams are hashed to FEATURES presence bits, so the
kernel with all landmarks is one matrix product; as the regression is linear in it, the product of
landmarks and weights is taken once and a batch of texts is scored by a single product.  A text
longer than PART characters is scored in parts of that length, whose margins are averaged by length:
presence in one long text would fill all bits, and languages draw together.

The sample: of the labelled rows whose text has a letter, whatever its length, for each language the
row of least hash in each of SAMPLE_SLOTS slots of a hash of the identifier and text.  Of a row longer than
SAMPLE_PART characters it takes a part of that length, cut at a place drawn by the row's hash.  Only fitting is
bounded: every whole text is scored.

Defined cases: null text or one without a letter gives ``und`` with score 0; rows without a label are
not learned from; with no row to learn from every text is ``und`` (and ``drop_untold`` keeps what has a
letter); repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.shared import fresh_names, lean, without
from rillmark.llm.words import LOWER, byte_view, mix

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
FEATURES = 1 << 14
SAMPLE_SLOTS = 192
LANDMARK_SLOTS = 64
SAMPLE_PART = 8000
RIDGE = 0.03
BATCH = 256
PIECE = 1 << 18
PART = 1 << 14


def presence(column: pa.Array) -> np.ndarray:
    """One row of FEATURES booleans for each text: the hashed n-grams it contains, whole texts."""
    data, at = byte_view(column)
    flat = np.zeros(len(column) * FEATURES + 1, bool)  # the last for what would reach into the next text
    lowered = LOWER[data]
    for begin in range(0, len(lowered), PIECE):
        end = min(begin + PIECE, len(lowered))
        own = lowered[begin : min(end + max(ORDERS) - 1, len(lowered))].astype(np.uint64)
        first = max(0, int(np.searchsorted(at, begin, "right")) - 1)
        cuts = at[first : int(np.searchsorted(at, end + max(ORDERS), "left")) + 1]
        base = np.repeat(np.arange(first, first + len(cuts) - 1) * FEATURES, np.diff(np.clip(cuts, begin, end)))
        gram = np.zeros(end - begin, np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = min(len(own) - n + 1, end - begin)
            if m <= 0:
                break
            gram = gram[:m] * np.uint64(256) + own[n - 1 : n - 1 + m]
            if n in ORDERS:
                slot = _SLOTS[n][gram] if n in _SLOTS else _slots(gram, n)
                slot = slot + base[:m]
                across = (cuts[1:, None] - np.arange(1, n) - begin).ravel()
                slot[across[(across >= 0) & (across < m)]] = len(flat) - 1
                flat[slot] = True
    return flat[:-1].reshape(len(column), FEATURES)


def _slots(gram: np.ndarray, n: int) -> np.ndarray:
    slot = mix(gram + np.uint64(n << 40)) >> np.uint64(40) & np.uint64(FEATURES - 1)  # FEATURES is a power of two
    return slot.view(np.int64)


_SLOTS = {n: _slots(np.arange(256**n, dtype=np.uint64), n) for n in (1, 2)}


def fit(texts: list[str], langs: list[str], landmarks: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, the FEATURES x languages weights, and the intercepts."""
    names = sorted(set(langs))
    if not names:
        return None
    x = presence(pa.array(texts, pa.string())).astype(np.float32)
    norms = np.sqrt(x.sum(1))
    z = x[np.array(landmarks)] / norms[np.array(landmarks), None]
    own = (z @ z.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = ((x / norms[:, None]) @ z.T).astype(np.float64) @ root
    mean = mapped.mean(0)
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    each = 1 / np.array([langs.count(lang) for lang in langs])  # every language weighs the same
    centred = mapped - mean
    gram = centred.T @ (centred * each[:, None]) + RIDGE * np.eye(centred.shape[1]) / len(names)
    beta = np.linalg.solve(gram, centred.T @ (y * each[:, None]))
    offset = (y * each[:, None]).sum(0) / each.sum() - mean @ beta
    return names, (z.T @ (root @ beta)).astype(np.float32), offset.astype(np.float32)


def margins(texts: list[str], weights: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The regression's value of each language for each text."""
    parts = [(i, text[k : k + PART]) for i, text in enumerate(texts) for k in range(0, max(1, len(text)), PART)]
    out, size = np.zeros((len(texts), len(offset))), np.zeros(len(texts))
    for k in range(0, len(parts), BATCH):
        owner, own = zip(*parts[k : k + BATCH], strict=True)
        x = presence(pa.array(own, pa.string()))
        found = (x.astype(np.float32) @ weights) / np.sqrt(np.maximum(1, x.sum(1)))[:, None] + offset
        weight = np.array([max(1, len(t)) for t in own], float)
        np.add.at(out, list(owner), found * weight[:, None])
        np.add.at(size, list(owner), weight)
    return out / size[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, slot, text): at most SAMPLE_SLOTS rows a language, of SAMPLE_PART characters at most."""
    length = F.length(text_col)
    rows = labelled.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    begin = F.when(length > SAMPLE_PART, F.pmod(F.xxhash64(key), length - SAMPLE_PART + 1)).otherwise(0).cast("int")
    part = F.substring(F.col(text_col), begin + 1, F.lit(SAMPLE_PART))
    picked = rows.select(F.col(lang_col).alias("lang"), F.pmod(key, F.lit(SAMPLE_SLOTS)).alias("slot"), F.struct(key.alias("key"), part.alias("text")).alias("row"))
    return picked.groupBy("lang", "slot").agg(F.min("row").alias("row")).select("lang", "slot", "row.text")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    rows = sample(labelled, id_col, text_col, lang_col).orderBy("lang", "slot").collect()
    marks = [r["slot"] % SAMPLE_SLOTS < LANDMARK_SLOTS for r in rows]
    if rows and not any(marks):
        marks = [True] * len(rows)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], marks)


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` (the identifier) with lang_pred and score (0 to 1: the share of the best).

    The results take ``names``; a kept column of such a name is left out."""
    keep = without([id_col] if keep is None else keep, *names)
    body, letter = fresh_names(docs, "body", "letter")
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(body), has_letter(F.col(text_col)).alias(letter))
    schema = docs.select(*keep, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # FEATURES x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for whole in batches:
            for batch in (whole.slice(i, BATCH) for i in range(0, whole.num_rows, BATCH)):
                n = batch.num_rows
                letters = batch.column(letter).to_numpy(zero_copy_only=False)
                told, best = np.full(n, UNKNOWN, object), np.zeros(n)
                if known is not None:
                    langs, weights, offset = known
                    margin = margins(batch.column(body).to_pylist(), weights, offset)
                    share = np.exp(4 * (margin - margin.max(1, keepdims=True)))
                    top = margin.argmax(1)
                    told = np.where(letters, np.array(langs, object)[top], UNKNOWN)
                    best = np.where(letters, 1 / share.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(told, pa.string()), pa.array(best, pa.float64())], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` outside ``held_out`` and predict all of them."""
    model = train(docs.filter(~held_out), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col, keep)


def drop_untold(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a letter and a language of that score or more, with their columns.

    Where no row has a label nothing can be told, and only what has no letter goes."""
    names = fresh_names(docs, "lang_pred", "score")
    model = train(docs, id_col, text_col, lang_col)
    if model is None:
        return docs.filter(has_letter(F.col(text_col)))
    told = predict(docs, model, id_col, text_col, docs.columns, tuple(names))
    return told.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*docs.columns)
