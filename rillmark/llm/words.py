"""Words of whole texts as 64-bit hashes, computed by numpy over Arrow buffers.

A word is a longest run of bytes other than space and 0x09-0x0D; A-Z count as a-z.  A word's hash
is a polynomial over random 64-bit values of its bytes, finished by a mixing step, so that one
pass of vector operations handles a megabyte of text without an object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_VALUE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)[LOWER]
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"][:n], _tables["down"]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


@dataclass
class Words:
    """Words of rows ``first .. first + len(at) - 2``; ``at`` are offsets into ``hashes``."""

    first: int
    hashes: np.ndarray
    at: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _hash_words(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), nothing, nothing
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[row_starts[row_starts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = row_starts[(row_starts > 0) & (row_starts <= len(data))] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    up, down = _powers(len(data))
    sums = np.add.reduceat(_VALUE[data] * up, starts) * down[starts]
    return mix(sums ^ (ends - starts).astype(np.uint64)), starts, ends


def words(column: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    """Words of all rows, in pieces of about ``chunk`` bytes of whole rows.

    A longer row is hashed in parts cut at white space and comes alone, whole.
    """
    data, at = byte_view(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(at, at[row] + chunk, "right")) - 1)
        part = data[at[row] : at[last]]
        own = at[row : last + 1] - at[row]
        if len(part) <= chunk:
            hashes, starts, ends = _hash_words(part, own[:-1])
        else:
            found, begin = [], 0
            while begin < len(part):
                stop = min(begin + chunk, len(part))
                while stop < len(part):
                    spaces = np.flatnonzero(_SPACE[part[begin:stop]])
                    if len(spaces):
                        stop = begin + int(spaces[-1]) + 1
                        break
                    stop = min(stop + chunk, len(part))
                h, s, e = _hash_words(part[begin:stop], np.zeros(1, np.int64))
                found.append((h, s + begin, e + begin))
                begin = stop
            hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        yield Words(row, hashes, np.searchsorted(starts, own), part, starts, ends)
        row = last
