"""Toxicity with a convolutional text classifier, trained in numpy.

A word is a run of letters (A-Z count as a-z; bytes from 0x80 on are letters).  Its vector is the sum of
hashed embeddings of the whole word and of its first 4 to 8 bytes, so inflected forms of one stem
share what is learned.  Filters of one, two and three words slide over the whole text, the largest value of each
filter over the text is kept, and a linear layer gives the margin.

Training: all rows with a label and outside ``held_out``, whole texts.  Tasks count the rows that hold a bucket.
The first coordinate of an embedding starts as the log odds of these counts, the others near zero; what
fewer than two rows hold stays zero, so that a word never seen says nothing however long a text is.  All weights
are then fitted by Adam on the cross entropy: rows are dealt to shards by their hash, a task leads a shard's rows
past its networks, a step's rows in memory, and the shards' weights are averaged in tasks after each pass.
Few rows are passed EPOCHS times, SHARD rows and more once.  The driver holds networks, never rows.

Scores: rows are dealt to FOLDS folds, each row gets the margin of a network fitted without its fold, and
the counts of these (in steps of 1 / GRAIN) set, for each language, the margin at which the classes part best;
a language with few rows takes the common one.
The score is a logistic function of the margin that passes THRESHOLD there.  The language is what the
string-kernel classifier reads in the text: label, language, source and identifier of a row never
enter its score.

Whole texts are scored: a text's windows are taken piece by piece and their largest values kept.

Defined cases: null and empty texts get the score of a text without words; rows without a label are not
learned from; labels of one document that differ are separate rows; with one label only, every score is
that label (0 or 1), with none 0; repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm import language
from rillmark.llm.shared import discard, fresh_names, lean, materialize, partitions, tidy, without
from rillmark.llm.words import LOWER, byte_view, mix

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 16
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS, ROWS_A_STEP, RATE, DECAY = 5, 64, 0.01, 1e-4
#: Rows a shard has at most on average, and words after which a step ends.  Where rows are fewer than SHARD there are more passes.
SHARD, STEP_WORDS = 20_480, 1 << 17
#: Parts in which an embedding is added up; margins are counted by steps of 1 / GRAIN up to WIDEST.
CHUNKS, GRAIN, WIDEST = 32, 256, 64
THRESHOLD, SLOPE = 0.7, 1.5
#: Rows of each label that a language must have for a threshold of its own.
LEAST_ROWS = 12
FOLDS = 3
#: Bits for each labelled row in the filter of their identifiers, and bits of it at most (beyond, more rows pass and the result is the same).
SIEVE_BITS, SIEVE_MOST = 8, 1 << 27
#: Bytes of text, and texts, that are scored at once.
PIECE, BATCH = 1 << 20, 256
#: Words that are scored at once.
SCORED = 1 << 14
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUE = np.random.default_rng(20240611).integers(1, 2**64, 256, dtype=np.uint64)
_PAD = max(WIDTHS) - 1


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' places in ``data`` and their embedding buckets (1 .. BUCKETS - 1), a row each."""
    lowered = LOWER[data]
    letters = _LETTER[lowered]
    starts, found, begin = [], [], 0
    while begin < len(data):  # pieces that end between words
        stop = min(begin + PIECE, len(data))
        while stop < len(data) and letters[stop]:
            gap = np.flatnonzero(~letters[stop : stop + PIECE])
            stop = stop + int(gap[0]) if len(gap) else min(stop + PIECE, len(data))
        own, buckets = _piece(lowered[begin:stop], letters[begin:stop])
        starts.append(own + begin)
        found.append(buckets)
        begin = stop
    return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros((0, 1 + len(PREFIXES)), np.int32))


def _piece(lowered: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(lowered) + 2, bool)
    inside[1:-1] = letters
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = np.full((2, len(lowered) + 1), 1, np.uint64)
    up[1:], down[1:] = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(lowered) + 1, np.uint64)
    np.cumsum(_VALUE[lowered] * up[:-1], dtype=np.uint64, out=sums[1:])
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for k, size in enumerate((1 << 40, *PREFIXES)):
        stop = np.minimum(ends, starts + size)
        h = mix((sums[stop] - sums[starts]) * down[starts] + np.uint64(k + 1))
        out[:, k] = 1 + (h >> np.uint64(20)) % np.uint64(BUCKETS - 1)
    return starts, out


def rows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the texts, _PAD empty words after each, and where each text begins."""
    data, at = byte_view(pa.array(texts, pa.large_string()))
    n = len(texts)
    spread = np.zeros(len(data) + n, np.uint8)  # a byte that is no letter after each text
    spread[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    starts, found = features(spread)
    first = np.searchsorted(starts, at[:-1] + np.arange(n))
    count = np.diff(np.append(first, len(starts)))
    begin = np.concatenate([[0], np.cumsum(count + _PAD)])
    out = np.zeros((begin[-1], found.shape[1]), np.int32)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), count) * _PAD] = found
    return out, begin


@dataclass
class Network:
    embed: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: np.ndarray  # all filters
    weights: np.ndarray
    offset: float

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        out = self.embed[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            out += self.embed[buckets[:, k]]
        return out

    def windows(self, vectors: np.ndarray) -> np.ndarray:
        """Values of all filters at each place; what lies beyond the end counts as empty."""
        out = np.zeros((len(vectors), len(WIDTHS) * FILTERS), np.float32)
        for i, own in enumerate(self.filters):
            part = out[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(len(own)):
                part[: len(vectors) - j] += vectors[j:] @ own[j]
        return out

    def pooled(self, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each text."""
        out = np.full((len(self.bias), len(begin) - 1), -np.inf, np.float32)
        step = min(SCORED, PIECE // 8)
        for k in range(0, len(buckets), step):
            own = buckets[k : k + step + _PAD]
            vectors, n = self.vectors(own).T, min(step, len(own))
            values = np.zeros((len(self.bias), n), np.float32)  # as of windows, a filter's values side by side
            for i, filters in enumerate(self.filters):
                part = values[i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(filters)):
                    part[:, : len(own) - j] += filters[j].T @ vectors[:, j : j + n]
            values[:, own[:n, 0] == 0] = 0  # behind a text no window reaches into the next one
            first = int(np.searchsorted(begin, k, "right")) - 1
            last = int(np.searchsorted(begin, k + n, "left"))
            cuts = np.maximum(begin[first:last] - k, 0)
            out[:, first:last] = np.maximum(out[:, first:last], np.maximum.reduceat(values, cuts, axis=1))
        return np.ascontiguousarray(out.T)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        tops = [self.pooled(*rows_of(texts[k : k + BATCH])) for k in range(0, len(texts), BATCH)]
        return np.maximum(np.concatenate(tops) + self.bias, 0) @ self.weights + self.offset


def log_odds(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each bucket the log odds of the labels of the rows that hold it; 0 below two rows."""
    counts = np.zeros((2, BUCKETS))
    for own, label in zip(rows, labels, strict=True):
        _count(counts[int(label)], own)
    return odds_of(counts)


def _count(counts: np.ndarray, buckets: np.ndarray) -> None:
    """Add a row to the counts of its buckets; bucket 0 counts the rows."""
    held = np.unique(buckets)
    counts[held[held > 0]] += 1
    counts[0] += 1


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Log odds of each bucket from its rows of either label."""
    sizes = counts[:, :1]
    odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
    odds[counts.sum(0) < 2] = 0
    odds[0] = 0
    return odds


def start(odds: np.ndarray) -> Network:
    """A network before training, from the log odds of the buckets."""
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    embed[odds == 0] = 0
    embed[:, 0] = odds / (1 + len(PREFIXES))
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for own in filters:
        own[:, 0, : FILTERS // 2] = 1 / len(own)
    return Network(embed, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.02, np.float32), -1.0)


class Trainer:
    """Adam on the cross entropy of a network, a step for some rows at a time; ``sizes`` are the rows of either label.

    A bucket outside ``learned`` stays as it is.  ``touched`` tells which buckets have been moved."""

    def __init__(self, net: Network, learned: np.ndarray, sizes: np.ndarray):
        self.net, self.learned = net, learned
        self.balance = sizes.sum() / (2 * np.maximum(sizes, 1))
        self.state: dict = {}
        self.touched = np.zeros(BUCKETS, bool)
        self.seen = 0

    def _adam(self, name: object, value: np.ndarray, grad: np.ndarray, rate: float, places: np.ndarray | None = None) -> None:
        first, second, t = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        self.state[name][2] = t = t + 1
        at = slice(None) if places is None else places
        first[at] = 0.9 * first[at] + 0.1 * grad
        second[at] = 0.99 * second[at] + 0.01 * grad * grad
        value[at] -= rate * (first[at] / (1 - 0.9**t) / (np.sqrt(second[at] / (1 - 0.99**t)) + 1e-6) + DECAY * value[at])

    def _tops(self, flat: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each text, and where it stands; windows are made piece by piece."""
        n = (len(cuts) - 1, len(self.net.bias))
        top, place = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
        for k in range(0, len(flat), PIECE // 8):
            values = self.net.windows(self.net.vectors(flat[k : k + PIECE // 8 + _PAD]))[: PIECE // 8]
            values[flat[k : k + len(values), 0] == 0] = 0
            for i in range(int(np.searchsorted(cuts, k, "right")) - 1, int(np.searchsorted(cuts, k + len(values), "left"))):
                begin = max(cuts[i] - k, 0)
                own = values[begin : cuts[i + 1] - k]
                at = own.argmax(0)
                best = np.take_along_axis(own, at[None], 0)[0]
                better = best > top[i]
                top[i, better], place[i, better] = best[better], k + begin + at[better]
        return top, place

    def step(self, rows: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        net = self.net
        self.seen += len(rows)
        flat = np.concatenate(rows)
        top, place = self._tops(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
        top = top + net.bias
        hidden = np.maximum(top, 0)
        margin = hidden @ net.weights + net.offset
        error = ((1 / (1 + np.exp(-margin)) - labels) * self.balance[labels] / len(rows)).astype(np.float32)
        back = error[:, None] * net.weights * (top > 0)
        moved = back * (flat[place, 0] != 0)
        words, inverse = np.unique(np.minimum(place[None] + np.arange(max(WIDTHS))[:, None, None], len(flat) - 1), return_inverse=True)
        inverse = inverse.reshape(max(WIDTHS), *place.shape)
        vectors = net.vectors(flat[words])
        change = np.zeros((len(words), DIM), np.float32)
        grads = []
        for i, w in enumerate(WIDTHS):
            span = slice(i * FILTERS, (i + 1) * FILTERS)
            grad = np.zeros_like(net.filters[i])
            for j in range(w):
                there = inverse[j, :, span]
                grad[j] = np.einsum("nf,nfd->df", moved[:, span], vectors[there])
                np.add.at(change, there.ravel(), (moved[:, span, None] * net.filters[i][j].T).reshape(-1, DIM))
            grads.append(grad)
        self._adam("weights", net.weights, hidden.T @ error, rate)
        self._adam("bias", net.bias, back.sum(0), rate)
        offset = np.array([net.offset], np.float32)
        self._adam("offset", offset, error.sum(keepdims=True), rate)
        net.offset = float(offset[0])
        for i, grad in enumerate(grads):
            self._adam(i, net.filters[i], grad, rate)
        some = np.abs(change).sum(1) > 0
        if not some.any():
            return
        places, inverse = np.unique(flat[words[some]], return_inverse=True)
        grad = np.zeros((len(places), DIM), np.float32)
        np.add.at(grad, inverse.reshape(int(some.sum()), -1), change[some][:, None, :])
        good = self.learned[places]
        self._adam("embed", net.embed, grad[good], rate, places[good])
        self.touched[places[good]] = True


def _each(texts: list[str | None]) -> list[np.ndarray]:
    """Buckets of each text."""
    out = []
    for k in range(0, len(texts), BATCH):
        buckets, begin = rows_of(texts[k : k + BATCH])
        out += [buckets[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return out


def fit(texts: list[str], labels: np.ndarray) -> Network:
    """A network for texts at hand, labels 0 and 1 both among them."""
    rows, labels = _each(texts), np.asarray(labels).astype(int)
    odds = log_odds(rows, labels)
    trainer, rng = Trainer(start(odds), odds != 0, np.bincount(labels, minlength=2)), np.random.default_rng(7)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), ROWS_A_STEP):
            own = order[k : k + ROWS_A_STEP]
            trainer.step([rows[i] for i in own], labels[own], RATE * (1 - epoch / EPOCHS))
    return trainer.net


def best_cut(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The margin with the best F1 of label 1, halfway to the next lower margin."""
    order = np.argsort(-margins, kind="stable")
    m, w, y = margins[order], weight[order], labels[order]
    hit, said = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (said + (w * y).sum())
    f1[:-1][m[1:] == m[:-1]] = -1
    i = int(f1.argmax())
    return float((m[i] + m[i + 1]) / 2) if i + 1 < len(m) else float(m[i]) - 1.0


@dataclass
class Model:
    net: Network | None
    only: float  # score of all texts where there is no network
    tongue: tuple | None  # the language classifier
    cuts: dict[str | None, float]

    def languages(self, texts: list[str | None]) -> list[str | None]:
        if self.tongue is None:
            return [None] * len(texts)
        names, weights, offset = self.tongue
        return [names[i] for i in language.margins([t or "" for t in texts], weights, offset).argmax(1)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.only)
        cut = np.array([self.cuts.get(name, self.cuts[None]) for name in self.languages(texts)])
        return 1 / (1 + np.exp(-(SLOPE * (self.net.margins(texts) - cut) + np.log(THRESHOLD / (1 - THRESHOLD)))))


def _sieve(marks: DataFrame) -> np.ndarray:
    """Bits of the hashes of the marked identifiers, SIEVE_BITS each where SIEVE_MOST allows: what is not in it has no mark."""
    with tidy(marks.sparkSession):
        bits = min(SIEVE_MOST, max(1 << 15, 1 << (SIEVE_BITS * marks.count()).bit_length()))
        place = F.pmod("hash", F.lit(bits)) + 1  # Spark's bitmaps count from 1
        found = marks.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in found:  # SIEVE_MOST bits and less
        out[r["bucket"] - 1] = np.frombuffer(r["map"], np.uint8)
    return out.ravel()


def learned_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, fold, key, text) of every row with a label and a text that isn't empty, written once.

    Texts without a label are sifted out where they are read; the rest meet their labels in a sorted join at every
    size, so that no more than the learned texts moves."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("row_id"), F.col(label_col).cast("int").alias("label"))
    own = F.xxhash64(F.col("row_id").cast("string"))
    like = F.xxhash64(F.col("row_id").cast(docs.schema[id_col].dataType).cast("string"))
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(marks.select(like.alias("hash"))))
    known = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0).withColumn("hash", own)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for batch in batches:
            place = batch.column("hash").to_numpy() % (8 * len(bits))
            left = batch.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays(left.columns[:2], names=["row_id", "text"])

    sifted = known.mapInArrow(lean(sift), known.drop("hash").schema)
    out = materialize(sifted.join(marks.hint("merge"), "row_id").select("label", F.pmod(own, F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64(own, "text").alias("key"), "text"), "toxicity")
    sieve.destroy()
    return out


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of float32 arrays (part, shard, body) by part, added up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for k, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
                own = np.frombuffer(body.as_buffer(), np.float32)
                if k != part:
                    if part is not None:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})
                    part, total = k, np.zeros(len(own))
                total += own
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    dealt = parts.repartition(partitions(parts.sparkSession), "part").sortWithinPartitions("part", "shard")
    with tidy(parts.sparkSession):
        return {r["part"]: np.frombuffer(r["body"], np.float32) for r in dealt.mapInArrow(lean(run), "part int, body binary").collect()}  # arrays of fixed size


_PARTS = "part int, shard long, body binary"


def _sent(arrays: Iterator[tuple[int, np.ndarray]], shard: int) -> Iterator[pa.RecordBatch]:
    for part, own in arrays:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int64()), "body": pa.array([own.astype(np.float32).tobytes()], pa.binary())})


def counts_of(rows: DataFrame) -> np.ndarray:
    """FOLDS x 2 x BUCKETS: the rows of each fold and label that hold a bucket; bucket 0 has all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((FOLDS, 2, BUCKETS))
        for batch in batches:
            folds, marks = batch.column("fold").to_pylist(), batch.column("label").to_pylist()
            for own, fold, label in zip(_each(batch.column("text").to_pylist()), folds, marks, strict=True):
                _count(counts[fold, label], own)
        if counts.any():
            yield from _sent(((k, counts.reshape(2 * FOLDS, -1)[k]) for k in range(2 * FOLDS)), 0)

    out = np.zeros((2 * FOLDS, BUCKETS))
    for k, own in _summed(rows.select("label", "fold", "text").mapInArrow(lean(run), _PARTS)).items():
        out[k] = own
    return out.reshape(FOLDS, 2, BUCKETS)


def _packed(net: Network) -> tuple:
    """A network without the vectors that are zero."""
    at = np.flatnonzero(net.embed.any(1)).astype(np.int32)
    return at, net.embed[at], net.filters, net.bias, net.weights, net.offset


def _unpacked(packed: tuple) -> Network:
    at, vectors, *others = packed
    embed = np.zeros((BUCKETS, DIM), np.float32)
    embed[at] = vectors
    return Network(embed, *others)


def _dense(net: Network) -> np.ndarray:
    return np.concatenate([*(f.ravel() for f in net.filters), net.bias, net.weights, [net.offset]])


def _epoch(rows: DataFrame, nets: list[Network], learned: list[np.ndarray], sizes: list[np.ndarray], skipped: list[int | None], shards: int, epoch: float, epochs: int) -> list[Network]:
    """The networks after one more pass over all rows.

    Rows are dealt to shards by their hash.  In a task, a shard's rows go by in the order of a hash, a step's
    rows in memory, and train every network that may see them.  A bucket's vector is then the mean of the shards
    that moved it; filters and weights are means by the rows of the shards."""
    total = sum(int(s.sum()) for s in sizes[-1:])
    packed = [(_packed(net), np.packbits(own), n) for net, own, n in zip(nets, learned, sizes, strict=True)]
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(packed))  # networks of fixed size

    def state_of(trainers: list[Trainer]) -> Iterator[tuple[int, np.ndarray]]:
        for k, trainer in enumerate(trainers):
            if not trainer.seen:
                continue
            for c in range(CHUNKS):
                at = slice(c * BUCKETS // CHUNKS, (c + 1) * BUCKETS // CHUNKS)
                moved = trainer.touched[at, None].astype(np.float32)
                yield k * (CHUNKS + 1) + c, np.concatenate([moved, trainer.net.embed[at] * moved], 1).ravel()
            yield k * (CHUNKS + 1) + CHUNKS, np.append(_dense(trainer.net), 1) * trainer.seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trainers, held, words, passed = None, [], [], 0, 0

        def learn() -> None:
            rate = RATE * max(0.05, 1 - (epoch + passed * shards / total) / epochs)
            for trainer, skip in zip(trainers, skipped, strict=True):
                own = [(r, label) for r, fold, label in held if fold != skip]
                if own:
                    trainer.step([r for r, _ in own], np.array([label for _, label in own]), rate)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "fold", "label")]
            for own, dealt, fold, label in zip(_each(batch.column("text").to_pylist()), *columns, strict=True):
                if dealt != shard:
                    if held:
                        learn()
                    if shard is not None:
                        yield from _sent(state_of(trainers), shard)
                    shard, held, words, passed = dealt, [], 0, 0
                    trainers = [Trainer(_unpacked(net), np.unpackbits(known).astype(bool), n) for net, known, n in pickle.loads(shared.value)]
                held.append((own, fold, label))
                words, passed = words + len(own), passed + 1
                if len(held) == ROWS_A_STEP or words >= STEP_WORDS:
                    learn()
                    held, words = [], 0
        if held:
            learn()
        if shard is not None:
            yield from _sent(state_of(trainers), shard)

    order = F.xxhash64("key", F.lit(int(epoch)))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)), "turn": order})
    dealt = dealt.select("shard", "turn", "label", "fold", "text").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "turn", "label", "fold")
    found = _summed(dealt.mapInArrow(lean(run), _PARTS))
    shared.destroy()
    out = []
    for k, net in enumerate(nets):
        embed = net.embed.copy()
        for c in range(CHUNKS):
            own = found.get(k * (CHUNKS + 1) + c)
            if own is not None:
                own = own.reshape(-1, 1 + DIM)
                at = c * BUCKETS // CHUNKS + np.flatnonzero(own[:, 0])
                embed[at] = own[own[:, 0] > 0, 1:] / own[own[:, 0] > 0, :1]
        dense = found.get(k * (CHUNKS + 1) + CHUNKS)
        if dense is None:
            out.append(net)
            continue
        dense = (dense[:-1] / dense[-1]).astype(np.float32)
        filters, bias, weights, offset = [], None, None, 0.0
        at = 0
        for f in net.filters:
            filters.append(dense[at : at + f.size].reshape(f.shape).copy())
            at += f.size
        bias, weights, offset = dense[at : at + len(net.bias)].copy(), dense[at + len(net.bias) : -1].copy(), float(dense[-1])
        out.append(Network(embed, filters, bias, weights, offset))
    return out


def margin_counts(rows: DataFrame, nets: list[Network], tongue: tuple | None) -> list:
    """(name, margin, label, n): rows by language and the margin of the network that has not seen them, to 1 / GRAIN."""
    model = Model(None, 0.0, tongue, {})
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((model, [_packed(net) for net in nets])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packed = pickle.loads(shared.value)
        networks = [_unpacked(net) for net in packed]
        for whole in batches:
            for batch in (whole.slice(i, BATCH) for i in range(0, whole.num_rows, BATCH)):
                texts, fold = batch.column("text").to_pylist(), batch.column("fold").to_numpy()
                margin = np.zeros(len(texts))
                for k in np.unique(fold):
                    own = np.flatnonzero(fold == k)
                    margin[own] = networks[k].margins([texts[i] for i in own])
                grains = np.round(np.clip(margin, -WIDEST, WIDEST) * GRAIN).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(known.languages(texts), pa.string()), pa.array(grains), batch.column("label")], names=["name", "grain", "label"])

    each = rows.select("label", "fold", "text").mapInArrow(lean(run), "name string, grain int, label int")
    with tidy(rows.sparkSession):
        found = each.groupBy("name", "grain", "label").count().collect()  # grains, labels and languages are few
    shared.destroy()
    return found


def train(docs: DataFrame, labels: DataFrame, tongue: tuple | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from all rows of ``docs`` that have labels; ``tongue`` is a model of ``language.train``."""
    rows = learned_rows(docs, labels, id_col, text_col, label_col)
    counts = counts_of(rows)
    of_label = counts[:, :, 0].sum(0)
    if (of_label == 0).any():
        discard(rows)
        return Model(None, float(of_label[1] > 0), None, {})
    total, nets, learned, sizes, skipped = int(of_label.sum()), [], [], [], []
    for k in [*range(FOLDS), None]:  # a network for each fold's margins, and one of all rows
        without_fold = counts.sum(0) - (0 if k is None else counts[k])
        k, own = (k, without_fold) if (without_fold[:, 0] > 0).all() else (None, counts.sum(0))
        odds = odds_of(own)
        nets.append(start(odds))
        learned.append(odds != 0)
        sizes.append(own[:, 0])
        skipped.append(k)
    epochs = max(1, min(EPOCHS, round(SHARD / total)))
    for epoch in range(epochs):
        nets = _epoch(rows, nets, learned, sizes, skipped, -(-total // SHARD), epoch, epochs)
    model = Model(nets[-1], 0.0, tongue, {})
    found = margin_counts(rows, nets[:-1], tongue)
    discard(rows)
    found.sort(key=lambda r: (r["grain"], r["label"], r["name"] or ""))
    margin, y, n = (np.array([r[c] for r in found], float) for c in ("grain", "label", "count"))
    names = np.array([r["name"] for r in found], object)
    for name in [None, *sorted(set(names.tolist()) - {None})]:
        mine = np.full(len(names), True) if name is None else names == name
        if name is None or all(n[mine & (y == x)].sum() >= LEAST_ROWS for x in (0, 1)):
            model.cuts[name] = best_cut(margin[mine] / GRAIN, y[mine], n[mine])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with score (0 to 1) and predicted (1 if the score is THRESHOLD or more)."""
    names = ("score", "predicted")
    keep = without(["doc_id"] if keep is None else keep, *names)
    (body,) = fresh_names(docs, "body")
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(body))
    schema = docs.select(*keep, F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1])).schema
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS x DIM and less

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for whole in batches:
            begin = 0
            sizes = np.diff(byte_view(whole.column(body))[1])
            while begin < whole.num_rows:
                end = begin + 1
                size = sizes[begin]
                while end < whole.num_rows and end - begin < BATCH and size + sizes[end] <= PIECE:
                    size += sizes[end]
                    end += 1
                batch = whole.slice(begin, end - begin)
                begin = end
                found = np.round(known.scores(batch.column(body).to_pylist()), 6)  # sums differ with the batch in their last bits
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` outside ``held_out`` that have labels, and score all of them."""
    known = docs.filter(~held_out)
    tongue = language.train(known, id_col, text_col, lang_col)
    model = train(known, labels, tongue, id_col, text_col, label_col)
    return score(docs, model, text_col, [id_col] if keep is None else keep)
