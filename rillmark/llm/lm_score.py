"""Language-model scoring with a weighted backoff automaton over words.

Every word of the training texts is a symbol, and so is the end of a text; every n-gram of up to
ORDER symbols that the training texts hold is learned, however rare, at every size of input.  The
automaton's states are contexts of up to ORDER - 1 symbols; an n-gram is an arc with its smoothed
(interpolated Witten-Bell) probability, and what a state has no arc for is looked up along its
failure arc at the state's backoff weight, so every state's probabilities sum to one.  At the root,
add one half, with one event for all unseen words.  One left-to-right traversal of a text carries
the state and accumulates log-probabilities.  Texts are cut into segments that numpy runs in step,
each from the state of the ORDER - 1 symbols before it.

No count has a bound, so none is gathered or broadcast.  Documents are packed into blocks of about
BLOCK_BYTES.  Each block asks for the training counts of the words and n-grams it holds, then for
the occurrences and distinct successors of its contexts; the keys are dealt by their hash to parts,
a part adds up what all blocks hold of a key, and its answers are dealt back to the blocks.  A
block's automaton has the arcs, contexts and backoff weights that its own texts can meet, which is
what the automaton of the whole corpus would use on them.  An n-gram's kind is counted for its
context by the one block that a part names its owner.

Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased, then one end a text.
Words and n-grams are 64-bit hashes.

Defined cases: null or blank text is an end alone; with no training row every count is 0; rows that
repeat are scored and counted alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm.shared import in_groups, lean, partitions, settle
from rillmark.llm.words import Words, mix, words

ORDER = 3
BITS = 17  # of a symbol in packed n-grams
WIDE = 32  # of a symbol in a block
BLOCK_BYTES = 8 << 20
SEGMENT = 512
LANES = 4096
SLICES = 8  # of a part's keys, added up one after the other
_END_HASH = np.uint64(0x7E57E57E57E57E57)
_ROOT = np.uint64(0x5EED5EED5EED5EED)
_UNKNOWN = -1


@dataclass
class Tokens:
    """Word hashes of texts with the end's hash behind each text; ``at`` are the texts' offsets."""

    hashes: np.ndarray
    at: np.ndarray


def tokens(part: Words) -> Tokens:
    at = part.at - part.at[0] + np.arange(len(part.at))
    return Tokens(np.insert(part.hashes, part.at[1:], _END_HASH), at)


class Automaton:
    """States with arcs, failure arcs and backoff weights, in arrays."""

    def __init__(self, arcs: list[tuple[int, np.ndarray, np.ndarray]], contexts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], seen: np.ndarray):
        """arcs: (order, packed n-grams ascending, counts) of orders 2 and up; contexts: (length,
        packed ascending, occurrences, distinct successors); seen: counts of the symbols."""
        self.state_of: list[np.ndarray] = [np.zeros(1, np.int64)]
        sizes = [1]
        for _, packed, _, _ in contexts:
            self.state_of.append(packed)
            sizes.append(len(packed))
        offset = np.cumsum([0, *sizes])
        states = int(offset[-1])
        self.fail = np.zeros(states, np.int64)
        self.backoff = np.zeros(states)

        def find(length: int, packed: np.ndarray) -> np.ndarray:
            """The state of a context of that length, or -1."""
            if length == 0:
                return np.zeros(len(packed), np.int64)
            own = self.state_of[length] if length < len(self.state_of) else np.zeros(0, np.int64)
            place = np.searchsorted(own, packed)
            hit = np.zeros(len(packed), bool)
            inside = place < len(own)
            hit[inside] = own[place[inside]] == packed[inside]
            return np.where(hit, offset[length] + place, _UNKNOWN) if len(own) else np.full(len(packed), _UNKNOWN)

        def longest(length: int, packed: np.ndarray) -> np.ndarray:
            state = np.full(len(packed), _UNKNOWN)
            for n in range(min(length, ORDER - 1), -1, -1):
                open_ = state == _UNKNOWN
                state[open_] = find(n, packed[open_] & ((1 << BITS * n) - 1))
            return state

        every = np.arange(len(seen))
        keys, logs, targets = [every], [], [longest(1, every)]
        alone = (seen + 0.5) / (seen.sum() + 0.5 * len(seen))
        logs.append(np.log10(alone))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {1: (every, alone)}

        def probability(order: int, packed: np.ndarray) -> np.ndarray:
            """Of the last symbol after the ones before it, by the orders built so far."""
            if order == 1:
                return alone[packed]
            own, p = known[order]
            place = np.minimum(np.searchsorted(own, packed), max(0, len(own) - 1))
            hit = own[place] == packed if len(own) else np.zeros(len(packed), bool)
            out = np.empty(len(packed))
            out[hit] = p[place[hit]]
            rest = packed[~hit]
            state = find(order - 1, rest >> BITS)
            weight = np.where(state == _UNKNOWN, 1.0, 10 ** self.backoff[np.maximum(state, 0)])
            out[~hit] = weight * probability(order - 1, rest & ((1 << BITS * (order - 1)) - 1)) if len(rest) else 0
            return out

        for (length, ctx, occurring, kinds), (order, packed, counts) in zip(contexts, arcs, strict=True):
            state = find(length, packed >> BITS)
            row = state - offset[length]
            below = probability(order - 1, packed & ((1 << BITS * (order - 1)) - 1))
            p = (counts + kinds[row] * below) / (occurring[row] + kinds[row])
            taken = np.bincount(row, p, len(ctx))
            left = np.bincount(row, below, len(ctx))
            span = slice(offset[length], offset[length + 1])
            self.backoff[span] = np.log10(np.maximum(1 - taken, 1e-12) / np.maximum(1 - left, 1e-12))
            self.fail[span] = longest(length - 1, ctx & ((1 << BITS * (length - 1)) - 1))
            known[order] = (packed, p)
            keys.append(state << BITS | packed & ((1 << BITS) - 1))
            logs.append(np.log10(p))
            targets.append(longest(order, packed))
        self.shift = BITS
        self._hash(np.concatenate(keys), np.concatenate(logs), np.concatenate(targets))

    @classmethod
    def of_states(cls, fail: np.ndarray, backoff: np.ndarray, keys: np.ndarray, logs: np.ndarray, targets: np.ndarray) -> Automaton:
        """From finished states and arcs; keys: state << WIDE | symbol."""
        own = cls.__new__(cls)
        own.fail, own.backoff, own.shift = fail, backoff, WIDE
        own._hash(keys, logs, targets)
        return own

    def _hash(self, keys: np.ndarray, logs: np.ndarray, targets: np.ndarray) -> None:
        self.bits = max(10, (len(keys) * 3 // 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.logs = np.zeros(1 << self.bits, np.float32)
        self.targets = np.zeros(1 << self.bits, np.int32)
        for begin in range(0, len(keys), 1 << 18):
            todo = np.arange(begin, min(begin + (1 << 18), len(keys)))
            slot = self._slot(keys[todo])
            while len(todo):
                free = self.keys[slot] < 0
                self.keys[slot[free]] = keys[todo[free]]
                placed = free & (self.keys[slot] == keys[todo])
                self.logs[slot[placed]], self.targets[slot[placed]] = logs[todo[placed]], targets[todo[placed]]
                todo, slot = todo[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return mixed.astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each lane's symbol, and its next state."""
        state = state.astype(np.int64)
        log, target = np.zeros(len(state)), np.zeros(len(state), np.int64)
        lanes = np.arange(len(state))
        while len(lanes):
            key = state[lanes] << self.shift | symbol[lanes]
            slot = self._slot(key)
            found = self.keys[slot]
            open_ = np.flatnonzero((found != key) & (found >= 0))
            while len(open_):
                slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
                found[open_] = self.keys[slot[open_]]
                open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
            hit = found == key
            done = lanes[hit]
            log[done] += self.logs[slot[hit]]
            target[done] = self.targets[slot[hit]]
            lanes = lanes[~hit]
            log[lanes] += self.backoff[state[lanes]]
            state[lanes] = self.fail[state[lanes]]
        return log, target

    def traverse(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of every symbol in the spans [first, last) of ``data``; ``before``: the
        state ahead of each place, else found by a run over the ORDER - 1 symbols ahead of it."""
        out = np.zeros(len(data))
        pieces = -(-(last - first) // SEGMENT)
        begin = np.repeat(first, pieces) + SEGMENT * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(np.repeat(last, pieces) - begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), LANES):
            own = order[i : i + LANES]
            start, length = begin[own], size[own]
            state = np.zeros(len(own), np.int64) if before is None else before[start]
            for t in range(1 - ORDER if before is None else 0, int(length[0])):
                live = int(np.searchsorted(-length, -max(t, 0), "left"))
                log, state = self.step(state[:live], data[start[:live] + t])
                if t >= 0:
                    out[start[:live] + t] = log
        return out


@dataclass
class Block:
    """N-grams of a block's texts.  Word, pair and triple are indexes; ``pair`` and ``triple`` are
    of each token, ``ahead`` is the pair ahead of it; ``learn`` tells the training tokens."""

    vocabulary: np.ndarray
    word: np.ndarray
    before: np.ndarray
    first: np.ndarray
    learn: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    ahead: np.ndarray
    triples: np.ndarray
    triple: np.ndarray
    sample: np.ndarray  # a token of each triple

    def _pairs(self) -> np.ndarray:
        return _joined(self.vocabulary[self.pairs >> WIDE], self.vocabulary[self.pairs & 0xFFFFFFFF])

    def keys(self) -> np.ndarray:
        """Hashes of the words, pairs and triples."""
        pairs = self._pairs()
        return np.concatenate([self.vocabulary, pairs, _joined(pairs[self.triples >> WIDE], self.vocabulary[self.triples & 0xFFFFFFFF])])

    def counts(self) -> np.ndarray:
        """Of training tokens, by word, pair and triple."""
        each = ((self.word, self.vocabulary), (self.pair, self.pairs), (self.triple, self.triples))
        return np.concatenate([np.bincount(x[self.learn], minlength=len(all_)) for x, all_ in each])

    def contexts(self) -> np.ndarray:
        """Hashes of the contexts: none, a word, a pair."""
        return np.concatenate([[_ROOT], self.vocabulary, self._pairs()])

    def occurrences(self) -> np.ndarray:
        """Of the contexts ahead of training tokens."""
        each = ((self.before, self.vocabulary), (self.ahead, self.pairs))
        return np.concatenate([[self.learn.sum()], *(np.bincount(x[self.learn], minlength=len(all_)) for x, all_ in each)])

    def kinds(self, owned: np.ndarray) -> np.ndarray:
        """Owned successors of the contexts; ``owned``: of words, pairs and triples, 0 or 1."""
        w, p = len(self.vocabulary), len(self.pairs)
        each = ((self.pairs, owned[w : w + p], w), (self.triples, owned[w + p :], p))
        return np.concatenate([[owned[:w].sum()], *(np.bincount((x >> WIDE)[o > 0], minlength=n) for x, o, n in each)])

    def automaton(self, counts: np.ndarray, occurring: np.ndarray, kinds: np.ndarray) -> tuple[Automaton, np.ndarray]:
        """The automaton by the counts of the whole corpus, and the state ahead of each token."""
        w, p = len(self.vocabulary), len(self.pairs)
        seen, twos, threes = counts[:w], counts[w : w + p], counts[w + p :]
        used = np.flatnonzero(occurring[1:] > 0) + 1
        state = np.zeros(len(occurring), np.int32)
        state[used] = np.arange(1, len(used) + 1)
        last = self.pairs & 0xFFFFFFFF
        one, two = state[1 : w + 1], state[w + 1 :]
        two = np.where(two > 0, two, one[last])
        fail, backoff = np.zeros(len(used) + 1, np.int32), np.zeros(len(used) + 1)
        backoff[1:] = np.log10(kinds[used] / (occurring[used] + kinds[used]))
        fail[state[w + 1 :]] = one[last]
        fail[0] = 0

        def smoothed(n: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
            return (n + kinds[context] * below) / (occurring[context] + kinds[context])

        alone = (seen + 0.5) / (occurring[0] + 0.5 * (kinds[0] + 1))
        hit = np.flatnonzero(twos > 0)
        after = self.pairs[hit] >> WIDE
        paired = np.zeros(p)
        paired[hit] = smoothed(twos[hit], 1 + after, alone[last[hit]])
        found = np.flatnonzero(threes > 0)
        context, ends = self.triples[found] >> WIDE, self.pair[self.sample[found]]
        keys = [np.arange(w), one[after].astype(np.int64) << WIDE | last[hit], two[context].astype(np.int64) << WIDE | last[ends]]
        logs = [np.log10(x).astype(np.float32) for x in (alone, paired[hit], smoothed(threes[found], 1 + w + context, paired[ends]))]
        targets = [x.astype(np.int32) for x in (one, two[hit], two[ends])]
        del found, context, ends, hit, after, paired, last, one, state, used, alone
        arcs = []
        for part in (keys, logs, targets):
            arcs.append(np.concatenate(part))
            part.clear()
        return Automaton.of_states(fail, backoff, *arcs), two[self.ahead]


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(word ^ np.uint64(0xD6E8FEB86659FD93)))


def block_of(vocabulary: np.ndarray, word: np.ndarray, sizes: np.ndarray, held_out: np.ndarray) -> Block:
    """``vocabulary``: ascending hashes; ``word``: of each token; ``sizes``: tokens of each text."""
    end = int(np.searchsorted(vocabulary, _END_HASH))
    first = np.cumsum(sizes) - sizes
    before = np.r_[end, word[:-1]].astype(np.int32)
    before[first] = end
    start = end << WIDE | end
    pairs, pair = np.unique(np.r_[start, before.astype(np.int64) << WIDE | word], return_inverse=True)
    pair = pair.astype(np.int32)
    start, pair = pair[0], pair[1:]
    ahead = np.r_[start, pair[:-1]]
    ahead[first] = start
    triples, triple = np.unique(ahead.astype(np.int64) << WIDE | word, return_inverse=True)
    word, triple = word.astype(np.int32), triple.astype(np.int32)
    sample = np.empty(len(triples), np.int32)
    sample[triple] = np.arange(len(triple), dtype=np.int32)
    return Block(vocabulary, word, before, first, np.repeat(~held_out, sizes), pairs, pair, ahead, triples, triple, sample)


_ZSTD = pa.Codec("zstd", 1)


def _packed(x: np.ndarray) -> bytes:
    """Integers from 0 up, byte by byte of their places: number, width, and of each place's bytes their
    compressed size (0: as they are).  Places are compressed apart, as the lower ones are mostly noise."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    sizes, bodies = [], []
    for plane in planes:
        raw = plane.tobytes()
        body = _ZSTD.compress(raw, asbytes=True)
        sizes.append(len(body) if len(body) < len(raw) else 0)
        bodies.append(body if sizes[-1] else raw)
    return b"".join([len(x).to_bytes(8, "little"), bytes([width]), np.array(sizes, "<u4").tobytes(), *bodies])


def _unpacked(x: bytes) -> np.ndarray:
    n, width = int.from_bytes(x[:8], "little"), x[8]
    out, at = np.zeros((n, 8), np.uint8), 9 + 4 * width
    for k, size in enumerate(np.frombuffer(x, "<u4", width, 9).tolist()):
        body = _ZSTD.decompress(x[at : at + size], n, asbytes=True) if size else x[at : at + n]
        out[:, k] = np.frombuffer(body, np.uint8)
        at += size or n
    return out.view("<i8").ravel().astype(np.int64, copy=False)


def _packed_keys(x: np.ndarray) -> bytes:
    """Ascending hashes as steps from the first."""
    return int(x[0] if len(x) else 0).to_bytes(8, "little") + _packed(np.diff(x, prepend=x[:1]))


def _unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x[8:]).view(np.uint64)) + np.uint64(int.from_bytes(x[:8], "little"))


def _blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """One row a block: its texts' identifiers, fold and sizes, its vocabulary, the word of each token."""
    rows = docs.select(F.col(id_col).alias("row_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kinds = {"block": T.LongType(), "row_ids": T.ArrayType(docs.schema[id_col].dataType), "held_out": T.BinaryType(), "sizes": T.BinaryType(), "vocabulary": T.BinaryType(), "words": T.BinaryType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, found = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> pa.RecordBatch:
            vocabulary = np.unique(np.concatenate([f[2] for f in found]))
            word = np.concatenate([np.searchsorted(vocabulary, f[2])[f[3]] for f in found])
            ids = pa.concat_arrays([f[0] for f in found])
            own = [_packed(np.concatenate([f[1] for f in found])), _packed(np.concatenate([f[4] for f in found])), _packed_keys(vocabulary), _packed(word)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed, *(pa.array([x], pa.binary()) for x in own)], names=list(kinds))

        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
            for part in words(batch.column("body")):
                own, n = tokens(part), len(part.at) - 1
                found.append((batch.column("row_id").slice(part.first, n), held[part.first : part.first + n], *np.unique(own.hashes, return_inverse=True), np.diff(own.at)))
                size += len(part.data)
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, size = number + 1, 0
        if found:
            yield flush()

    return rows.mapInArrow(lean(run), T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def _deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where each part, a range of them, begins and the last ends."""
    order = np.argsort(keys)
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return order, np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]


_ASKED = "block long, part int, keys binary, n binary, more binary"
_TOLD = "block long, part int, n binary, more binary"


def _asked(block: int, keys: np.ndarray, n: np.ndarray, more: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    order, at = _deal(keys, parts)
    keys, n, more = keys[order], n[order], more[order]
    some = np.flatnonzero(np.diff(at))
    for i in range(0, len(some), 256):
        own = some[i : i + 256].tolist()
        columns = [[f(x[at[j] : at[j + 1]]) for j in own] for f, x in ((_packed_keys, keys), (_packed, n), (_packed, more))]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["block", "part", "keys", "n", "more"])


def _told(asked: DataFrame, parts: int, owners: bool, slices: int = SLICES) -> DataFrame:
    """Answers to each block and part, in the order of its keys: the sums of n over all blocks, and
    1 for the one block that owns a key with n > 0, or else the sums of more."""

    def summed(keys: np.ndarray, n: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, n, len(distinct)).astype(np.int64)[inverse]
        if other is not None:
            return total, np.bincount(inverse, other, len(distinct)).astype(np.int64)[inverse]
        having = np.flatnonzero(n)
        more = np.zeros(len(keys), np.int64)
        owner = np.full(len(distinct), -1)
        owner[inverse[having]] = having
        more[owner[owner >= 0]] = 1
        return total, more

    def answer(part: int, rows: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[0])
        lists = [_unpacked_keys(r[1]) for r in rows]
        sides = [[_unpacked(r[k]) for r in rows] for k in ((2,) if owners else (2, 3))]
        # keys ascend in each list, so slices between common borders hold all of a key's entries
        longest = max(lists, key=len)
        borders = np.unique(longest[np.arange(1, slices) * len(longest) // slices]) if len(longest) else longest
        cuts = [np.r_[0, np.searchsorted(x, borders), len(x)] for x in lists]
        told: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []) for _ in rows]
        for i in range(len(borders) + 1):
            own = [slice(c[i], c[i + 1]) for c in cuts]
            answers = summed(*(np.concatenate([x[o] for x, o in zip(side, own, strict=True)]) for side in (lists, *sides)))
            at = np.cumsum([0, *(o.stop - o.start for o in own)])
            for pair, begin, end in zip(told, at[:-1], at[1:], strict=True):
                for out, x in zip(pair, answers, strict=True):
                    out.append(x[begin:end])
        columns = [[_packed(np.concatenate(pair[k])) for pair in told] for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["block", "part", "n", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for block, own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part and rows:
                    yield from answer(part, rows)
                    rows = []
                part = own
                rows.append((block, *row))
        if rows:
            yield from answer(part, rows)

    return asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(run), _TOLD)


def _visited(blocks: DataFrame, number: int, answers: list[DataFrame]) -> DataFrame:
    """Rows of answers (kind 0 and up), then the row of the block, each block in one task."""
    none = F.lit(None)
    rows = blocks.withColumns({"kind": F.lit(len(answers)), "part": none.cast("int"), "n": none.cast("binary"), "more": none.cast("binary")})
    for kind, told in enumerate(answers):
        rows = rows.unionByName(told.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return rows.repartition(number, "block").sortWithinPartitions("block", "kind", "part")


def _opened(batches: Iterator[pa.RecordBatch], answers: int) -> Iterator[tuple[dict, Block, list[tuple[np.ndarray, np.ndarray]]]]:
    """(row, block, answers in the order dealt) of each block that comes from _visited."""
    told: list[list[tuple[bytes, bytes]]] = [[] for _ in range(answers)]
    for batch in batches:
        for i in range(batch.num_rows):
            kind = batch.column("kind")[i].as_py()
            if kind < answers:
                told[kind].append((batch.column("n")[i].as_py(), batch.column("more")[i].as_py()))
                continue
            row = {c: batch.column(c)[i] for c in ("block", "row_ids")} | {c: _unpacked(batch.column(c)[i].as_py()) for c in ("held_out", "sizes")}
            vocabulary, word = _unpacked_keys(batch.column("vocabulary")[i].as_py()), _unpacked(batch.column("words")[i].as_py())
            found = [row, block_of(vocabulary, word, row["sizes"], row["held_out"] > 0)]
            del row, vocabulary, word
            lists = [tuple(np.concatenate([_unpacked(x) for x in column]) for column in zip(*t, strict=True)) for t in told]
            told = [[] for _ in range(answers)]
            found.append(lists)
            del lists
            yield tuple(found.pop(0) for _ in range(3))  # nothing of a block stays here while it is worked on


def _restored(keys: np.ndarray, *dealt: np.ndarray) -> list[np.ndarray]:
    """Answers in the order of the keys."""
    order, out = np.argsort(keys), [np.empty_like(x) for x in dealt]
    for x, own in zip(dealt, out, strict=True):
        own[order] = x
    return out


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: row_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.  Rows where ``held_out`` is true are not learned from."""
    return settle(lambda: _score(docs, held_out, id_col, text_col), "scores")


def _score(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    blocks = in_groups(_blocks(docs, held_out, id_col, text_col), "blocks")
    parts = max(partitions(docs.sparkSession), blocks.count())
    names = ["row_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = docs.select(F.col(id_col).alias("row_id"), held_out.alias("held_out"), *(F.lit(0).cast("long").alias(c) for c in names[2:5]), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema

    def ask_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own, _ in _opened(batches, 0):
            n = own.counts()
            yield from _asked(row["block"].as_py(), own.keys(), n, np.zeros(len(n), np.int64), parts)
            del row, own, n

    def ask_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own, [(_, owned)] in _opened(batches, 1):
            [owned] = _restored(own.keys(), owned)
            yield from _asked(row["block"].as_py(), own.contexts(), own.occurrences(), own.kinds(owned), parts)
            del row, own, owned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own, [(n, _), (occurring, kinds)] in _opened(batches, 2):
            [n] = _restored(own.keys(), n)
            occurring, kinds = _restored(own.contexts(), occurring, kinds)
            machine, before = own.automaton(n, occurring, kinds)
            c = n[: len(own.vocabulary)][own.word]
            base = np.log10((c + 0.5) / (occurring[0] + 0.5 * (kinds[0] + 1)))
            logs = machine.traverse(own.word, own.first, own.first + row["sizes"], before)
            sums = [np.add.reduceat(x, own.first) for x in ((c > 0).astype(np.int64), base, logs)]
            size = row["sizes"]
            yield pa.RecordBatch.from_arrays([row["row_ids"].values, pa.array(row["held_out"] > 0), pa.array(size), pa.array(sums[0]), pa.array(np.full(len(size), occurring[0], np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=names)
            del row, own, n, occurring, kinds, machine, before, c, base, logs, sums

    counts = in_groups(_told(blocks.withColumn("kind", F.lit(0)).mapInArrow(lean(ask_counts), _ASKED), parts, True), "counts")
    nothing = F.lit(bytearray(_packed(np.zeros(0, np.int64))))  # for answers that a visit doesn't use
    contexts = in_groups(_told(_visited(blocks, parts, [counts.withColumn("n", nothing)]).mapInArrow(lean(ask_contexts), _ASKED), parts, False), "contexts")
    return _visited(blocks, parts, [counts.withColumn("more", nothing), contexts]).mapInArrow(lean(run), schema)
