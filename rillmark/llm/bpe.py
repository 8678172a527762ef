"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is the one that merging in rank order yields if and only if each token, and
each pair of neighbours, merges back to itself.  So a piece of text is encoded from left to right
with the longest token that starts at each place (found by an Aho-Corasick automaton over the
bytes, as Latin-1 characters); a token that its left neighbour does not tolerate gives way to its
next shorter prefix, and a place from which no token fits is marked dead and left for good.  The
tolerance of a pair is computed once, from the order in which its two tokens are merged, and then
remembered.  Every place is
entered and given up at most once, so the work is linear in the piece.

Defined cases: null text counts as empty and gives no tokens; text of any length is encoded whole
in bounded pieces; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.shared import fresh_names, kept, lean, without

CACHED_PIECES = 250_000
CACHED_PAIRS = 200_000
LONGEST_CACHED = 48
#: White space before a space: such a run must be split as a whole.
_RUN = re.compile(r"\s ")
PIECES_AT_ONCE = 200_000
#: Under a pattern that begins so, letters behind a space are one piece, and a mark behind them is the next.
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
_MARKS = frozenset(",.;:!?")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairCodec:
    """Encodes and decodes with a table of ranks; one instance serves one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self._letters = pattern.startswith(_LETTERS)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), rank)
        self._automaton.make_automaton()
        self._lengths = {rank: len(token) for token, rank in ranks.items()}
        self._shorter = {rank: next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1) for token, rank in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._left_spine: dict[int, list[tuple[bytes, int]]] = {}
        self._right_spine: dict[int, list[tuple[bytes, int]]] = {}
        self._pieces = _Pieces(self._packed)
        self._spaced = _Pieces(self._behind_space)

    def _packed(self, piece: str) -> bytes:
        return _little(self.encode_piece(piece.encode("utf-8")))

    def _behind_space(self, chunk: str) -> bytes:
        if self._letters:
            if chunk.isalpha():
                return self._packed(" " + chunk)
            if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                return self._spaced[chunk[:-1]] + self._pieces[chunk[-1]]
        parts = self.pattern.findall(" " + chunk)
        if len(parts) == 1:
            return self._packed(parts[0])
        # the first part is known by what stands behind its space, if that is a piece of its own
        first = self._spaced[parts[0][1:]] if len(parts[0]) > 1 and self.pattern.findall(parts[0]) == parts[:1] else self._pieces[parts[0]]
        return first + b"".join(map(self._pieces.__getitem__, parts[1:]))

    def merge(self, piece: bytes, below: int = 1 << 62) -> list[int]:
        """Tokens by merging the neighbours of lowest rank again and again: the definition.

        Only merges of a rank under ``below`` count."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 62))
            if ranks.get(parts[best] + parts[best + 1], 1 << 62) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand at one edge while ``token`` is merged, last first, each with the
        rank of the merge that takes it up."""
        spine = (self._right_spine if right else self._left_spine).get(token)
        if spine is None:
            spine, until, part = [], 1 << 62, self.bytes_of[token]
            while True:
                spine.append((part, until))
                if len(part) == 1:
                    break
                until = self.ranks[part]
                halves = self.merge(part, until)
                part = self.bytes_of[halves[-1 if right else 0]]
            (self._right_spine if right else self._left_spine)[token] = spine
        return spine

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those that make the two tokens.

        Tokens at the border are met in the order in which they vanish, both sides in step.
        """
        ranks = self.ranks
        a, b = self._spine(left, True), self._spine(right, False)
        i, j = len(a) - 1, len(b) - 1
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = ranks.get(x + y)
            if across is not None and across < x_until and across <= y_until:
                return False
            if i == 0 and j == 0:
                return True
            if x_until <= y_until:
                i -= 1
            if y_until <= x_until:
                j -= 1

    def _tolerates(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self._pairs) < CACHED_PAIRS:
                self._pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        pairs, last = self._pairs, -1
        greedy = []
        for _, rank in self._automaton.iter_long(text):
            if last >= 0:
                fits = pairs.get(last << 32 | rank)
                if not (self._tolerates(last, rank) if fits is None else fits):
                    break
            greedy.append(rank)
            last = rank
        else:
            return greedy
        lengths, shorter = self._lengths, self._shorter
        longest = [-1] * (len(piece) + 1)
        for end, rank in self._automaton.iter(text):
            longest[end - lengths[rank] + 1] = rank  # ends ascend, so the longest match of a start comes last
        chosen: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token, last = 0, longest[0], -1
        while at < len(piece):
            if token < 0:  # nothing fits here: back to the token before, and on with its next prefix
                dead[at] = 1
                token = chosen.pop()
                last = chosen[-1] if chosen else -1
                at -= lengths[token]
            else:
                end = at + lengths[token]
                if not dead[end]:
                    fits = last < 0 or pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self._tolerates(last, token)
                    if fits:
                        chosen.append(token)
                        at, last, token = end, token, longest[end]
                        continue
            token = shorter[token]
        return chosen

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers.

        A space between other characters always starts a piece, so texts without longer runs of
        white space around a space are looked up by what stands between their spaces.
        """
        known = self._pieces.__getitem__
        if not _RUN.search(text):
            first, *rest = text.split(" ")
            return b"".join([*map(known, self.pattern.findall(first)), *map(self._spaced.__getitem__, rest)])
        out, pieces = [], (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(pieces, PIECES_AT_ONCE)):
            out.append(b"".join(map(known, part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids in the form of ``encode`` stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _little(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class _Pieces(dict):
    """Encoded pieces; a missing one is encoded, and remembered while there is room."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONGEST_CACHED and len(self) < CACHED_PIECES:
            self[piece] = ids
        return ids


def codec(path: str, pattern: str) -> BytePairCodec:
    """The process's codec for a file of ranks."""
    return kept(("bpe", path, pattern), lambda: BytePairCodec(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` and token_ids binary (little-endian unsigned 32-bit integers).

    With ``decoded`` the ids are decoded again in the same pass, to a column of that name.  A kept
    column with the name of a result is left out.
    """
    keep = without(docs.columns if keep is None else keep, "token_ids", *["decoded"] * decoded)
    [body] = fresh_names(docs, "body")
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(body))
    schema = docs.select(*keep, F.lit(None).cast("binary").alias("token_ids"), *[F.lit(None).cast("binary").alias("decoded")] * decoded).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                ids = [own.encode(text) for text in batch.column(body).to_pylist()]
                columns = [*batch.columns[:-1], pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with the column decoded (binary); null ids decode to no bytes."""
    [held] = fresh_names(tokens, "ids")
    rows = tokens.drop("decoded").withColumn(held, F.coalesce(F.col(ids_col), F.lit(b"")))
    schema = tokens.drop("decoded").withColumn("decoded", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            back = pa.array([own.decode(x) for x in batch.column(held).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], back], names=schema.names)

    return rows.mapInArrow(lean(run), schema)
