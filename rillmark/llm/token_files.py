"""Token ids in compressed binary files, in ascending order of documents.

Documents are dealt by ranges of their identifier and sorted, so that the files of ascending
partitions hold the ids of all documents in order.  A file is a sequence of groups of blocks of BLOCK
ids (the last may be shorter).  Each block is coded from a fresh state with a CRC-32 of its ids; an
index of documents (identifier, number of ids) stands in chunks between the groups, each ahead of
the groups that hold its documents, so that neither writing nor reading holds a file's index.

A block's coder mixes contexts.  An id is coded digit by digit (base 16).  For every digit three
predictions are mixed into one distribution, which drives a range coder with 32-bit state: order 2
(the id that its cell last learned behind the two ids before), order 1 (behind the id before) and
order 0 (adaptive counts of the digit behind the digits so far).  Orders 1 and 2 give their digit a
weight as long as the digits so far agree with their id; the weights are adaptive probabilities that
such a guess holds, kept for each digit and for how often the cell has been right.  Blocks being
independent, numpy codes up to LANES of them in step, a digit of every block at a time.

Defined cases: null text counts as empty and still gets its end id; null identifiers come first;
rows that repeat an identifier stand side by side; an empty table writes no file; further columns
are ignored; strings that look like special tokens get what the library gives them.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.shared import lean, materialize, new_path, partitions

BLOCK = 2048
LANES = 1536
MAGIC = b"RTOK\x02\x00\x00\x00"
_INDEX, _GROUP, _END = 1, 2, 0  # kinds of a file's sections
_RUN = re.compile(r"\s ")
CACHED_CHUNKS = 500_000
INDEX_DOCUMENTS = 20_000
FILE_TOKENS = 1 << 24  # a partition's next file begins at the next document

_TOP = 1 << 16  # the coder's range never falls below
_SCALE = 1 << 15  # the frequencies of a digit add up to this
_CELLS = 1 << 11  # of each of orders 1 and 2
_NODES, _HASHED = 1 + 16 + 256, 1 << 10  # order 0: nodes by the first two digits; by hash for longer prefixes
_STEP, _MOST = 20, 1 << 11  # a count's growth, and the sum at which a node's counts are halved
_SURE = 16  # levels of how often a cell was right
_KEPT = 4  # a cell this sure survives one miss
_RIGHT, _WRONG, _RATE = _SCALE - 2048, 512, 4  # bounds of a weight, and its speed


_UP = np.arange(1, 17, dtype=np.uint32)
_FROM = np.tri(16, dtype=np.uint32).T.copy()  # row d: 1 from d on
_SUMS = _FROM.astype(np.float32)  # times a row: its running sums


class _Model:
    """Adaptive state of all lanes; the same calls in the same order serve coding and decoding."""

    def __init__(self, lanes: int, digits: int):
        self.lanes, self.digits = lanes, digits
        self.row = np.arange(lanes)
        self.counts = np.ones((lanes * (_NODES + _HASHED), 16), np.uint16)
        self.guess = [np.full(lanes * _CELLS, -1, np.int32) for _ in range(2)]
        self.sure = [np.zeros(lanes * _CELLS, np.uint8) for _ in range(2)]
        start = (np.linspace(0.15, 0.95, _SURE) * _SCALE).astype(np.int32)
        self.odds = [np.tile(start, lanes * digits) for _ in range(2)]
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)

    def begin(self) -> None:
        """Ask the cells of orders 1 and 2 for the next id."""
        base, one = self.row * _CELLS, self.one * 0x9E3B
        self.at = [base + (one >> 4 & _CELLS - 1), base + ((one ^ self.two * 0x3C6F35) >> 3 & _CELLS - 1)]
        self.said = [guess[at].astype(np.int64) for guess, at in zip(self.guess, self.at, strict=True)]
        self.right = [sure[at].astype(np.int64) for sure, at in zip(self.sure, self.at, strict=True)]
        self.alive = [said >= 0 for said in self.said]
        self.prefix = np.zeros(self.lanes, np.int64)

    def predict(self, k: int) -> None:
        """The mixed distribution of digit ``k``: counts of order 0, each ``rest`` / 256 wide, and two weights."""
        node = (16**k - 1) // 15 + self.prefix if k < 3 else _NODES + ((self.prefix * 0x9E3779B1 + k) >> 8 & _HASHED - 1)
        self.node = self.row * (_NODES + _HASHED) + node
        own = self.own = self.counts[self.node]
        self.upto = (own.astype(np.float32) @ _SUMS).astype(np.uint32)  # exact below 2^24
        self.total = self.upto[:, 15]
        shift = 4 * (self.digits - 1 - k)
        self.digit = [said >> shift & 15 for said in self.said]
        self.slot = [(self.row * self.digits + k) * _SURE + right for right in self.right]
        self.held = [odds[slot] for odds, slot in zip(self.odds, self.slot, strict=True)]
        one, two = (held * alive for held, alive in zip(self.held, self.alive, strict=True))
        self.weight = [((_SCALE - two) * one >> 15).astype(np.uint32), two.astype(np.uint32)]
        self.rest = (np.uint32(_SCALE - 16) - self.weight[0] - self.weight[1] << np.uint32(8)) // self.total

    def span(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where digit ``d`` of each lane begins on a line of _SCALE, and its width."""
        place = self.row * 16 + d
        upto = self.upto.reshape(-1)[place]
        below = upto - self.own.reshape(-1)[place]
        first = (below * self.rest >> np.uint32(8)) + d.astype(np.uint32)
        last = (upto * self.rest >> np.uint32(8)) + (d + 1).astype(np.uint32)
        for digit, weight in zip(self.digit, self.weight, strict=True):
            first += weight * (digit < d)
            last += weight * (digit <= d)
        return first.astype(np.int64), (last - first).astype(np.int64)

    def find(self, place: np.ndarray) -> np.ndarray:
        """The digit that holds each lane's place on the line."""
        upto = (self.upto * self.rest[:, None] >> np.uint32(8)) + _UP
        for digit, weight in zip(self.digit, self.weight, strict=True):
            upto += weight[:, None] * _FROM[digit]
        return np.minimum((upto <= place[:, None].astype(np.uint32)).sum(1), 15)

    def learn(self, k: int, d: np.ndarray) -> None:
        place = self.node * 16 + d
        self.counts.reshape(-1)[place] = self.own.reshape(-1)[self.row * 16 + d] + np.uint16(_STEP)
        full = self.node[self.total > _MOST]
        if len(full):
            self.counts[full] = (self.counts[full] + 1) >> 1
        for odds, slot, p, alive, digit in zip(self.odds, self.slot, self.held, self.alive, self.digit, strict=True):
            hit = digit == d
            odds[slot] = p + ((hit * np.int32(_RIGHT - _WRONG) + np.int32(_WRONG) - p >> _RATE) * alive)
            alive &= hit
        self.prefix = self.prefix << 4 | d

    def end(self, ids: np.ndarray) -> None:
        """Tell the cells which id it was."""
        for guess, sure, at, said, right in zip(self.guess, self.sure, self.at, self.said, self.right, strict=True):
            hit = said == ids
            sure[at] = np.where(hit, np.minimum(right + 1, _SURE - 1), right >> 1)
            guess[at] = np.where(right >= _KEPT, said, ids)
        self.two, self.one = self.one, ids


class _Writer:
    def __init__(self, lanes: int, length: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, 0xFFFFFFFF, np.int64)
        self.words = np.zeros((lanes, length + 4), np.int64)
        self.used = np.zeros(lanes, np.int64)

    def put(self, live: int, below: np.ndarray, size: np.ndarray) -> None:
        part = self.range[:live] >> 15
        self.low[:live] += part * below[:live]
        self.range[:live] = part = part * size[:live]
        self._shift(np.flatnonzero(part < _TOP))

    def _shift(self, lanes: np.ndarray) -> None:
        if len(lanes):
            self.words[lanes, self.used[lanes]] = self.low[lanes] >> 16  # may hold a carry
            self.used[lanes] += 1
            self.low[lanes] = (self.low[lanes] & 0xFFFF) << 16
            self.range[lanes] <<= 16

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self._shift(every)
        self._shift(every)
        for k in range(int(self.used.max()) - 1, 0, -1):  # carries run to the left
            self.words[:, k - 1] += self.words[:, k] >> 16
        words = (self.words & 0xFFFF).astype("<u2")
        return [words[i, : self.used[i]].tobytes() for i in every]


class _Reader:
    def __init__(self, blocks: list[bytes]):
        longest = max(len(b) // 2 for b in blocks) + 4
        self.words = np.zeros((len(blocks), longest), np.int64)
        for i, block in enumerate(blocks):
            self.words[i, : len(block) // 2] = np.frombuffer(block, "<u2")
        self.used = np.full(len(blocks), 2, np.int64)
        self.code = self.words[:, 0] << 16 | self.words[:, 1]
        self.range = np.full(len(blocks), 0xFFFFFFFF, np.int64)

    def places(self) -> np.ndarray:
        """Where each lane's next digit lies on the line."""
        self.part = self.range >> 15
        return np.minimum(self.code // self.part, _SCALE - 1)

    def take(self, live: int, below: np.ndarray, size: np.ndarray) -> None:
        self.code[:live] -= self.part[:live] * below[:live]
        self.range[:live] = part = self.part[:live] * size[:live]
        low = np.flatnonzero(part < _TOP)
        if len(low):
            self.code[low] = self.code[low] << 16 | self.words[low, self.used[low]]
            self.used[low] = np.minimum(self.used[low] + 1, self.words.shape[1] - 1)  # a damaged block may run on
            self.range[low] <<= 16


def _digits(most: int) -> int:
    """Digits of ids up to ``most``."""
    return max(1, -(-most.bit_length() // 4))


def encode_blocks(blocks: list[np.ndarray], digits: int) -> list[bytes]:
    """Code blocks of ids (longest first, each at least one id) in step."""
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((lengths[0], len(blocks)), np.int64)
    for i, block in enumerate(blocks):
        ids[: len(block), i] = block
    model, writer = _Model(len(blocks), digits), _Writer(len(blocks), int(lengths[0]) * digits)
    for t in range(int(lengths[0])):
        live = int(np.searchsorted(-lengths, -t, "left"))  # lanes with more than t ids
        model.begin()
        for k in range(digits):
            model.predict(k)
            d = ids[t] >> 4 * (digits - 1 - k) & 15
            writer.put(live, *model.span(d))
            model.learn(k, d)
        model.end(ids[t])
    return writer.finish()


def decode_blocks(coded: list[bytes], lengths: list[int], digits: int) -> list[np.ndarray]:
    """The ids of coded blocks (longest first)."""
    counts = np.array(lengths)
    ids = np.zeros((counts[0], len(coded)), np.int64)
    model, reader = _Model(len(coded), digits), _Reader(coded)
    for t in range(int(counts[0])):
        live = int(np.searchsorted(-counts, -t, "left"))
        model.begin()
        for k in range(digits):
            model.predict(k)
            d = model.find(reader.places())
            d[live:] = 0  # as the coder fills ended lanes
            reader.take(live, *model.span(d))
            model.learn(k, d)
        model.end(model.prefix)
        ids[t, :live] = model.prefix[:live]
    return [ids[:n, i] for i, n in enumerate(lengths)]


class _Tokens:
    """Ids of texts by the tokenizers library, which is asked once for each piece between spaces.

    A space between other characters always starts a token; texts with longer white space before
    a space, or with the string of a special token, are given to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = max(self.library.get_vocab(with_added_tokens=True).values(), default=0)
        self.kind = np.dtype("<u2") if self.most < 1 << 16 else np.dtype("<u4")
        special = [re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join([_RUN.pattern, *special]))
        self.known = _Known()

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "HI"[self.kind.itemsize // 2 - 1]
        return [array(code, found.ids).tobytes() for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of type ``kind``."""
        whole = [i for i, text in enumerate(texts) if self.special.search(text)]
        taken = set(whole)
        apart = [i for i in range(len(texts)) if i not in taken]
        split = [texts[i].split(" ") for i in apart]
        heads = self._ids([parts[0] for parts in split])
        wanted: set[str] = set()
        for parts in split:
            del parts[0]
            wanted.update(parts)
        known = self.known
        missing = [x for x in wanted if x not in known]
        known.once.clear()
        for i in range(0, len(missing), 10_000):
            part = missing[i : i + 10_000]
            keep = known if len(known) < CACHED_CHUNKS else known.once
            keep.update(zip(part, self._ids([" " + x for x in part]), strict=True))
        out = [b""] * len(texts)
        for i, head, parts in zip(apart, heads, split, strict=True):
            out[i] = head + b"".join(map(known.__getitem__, parts))
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


class _Known(dict):
    """Ids of what stands behind a space; those beyond the room for them are held in ``once`` for a batch."""

    def __init__(self) -> None:
        self.once: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.once[piece]


_tokens: dict[str, _Tokens] = {}


def _group(blocks: list[np.ndarray], digits: int) -> bytes:
    """A group of up to LANES blocks: number, digits, (ids, bytes, CRC-32) of each, then their codes."""
    coded = encode_blocks(blocks, digits)
    heads = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded, strict=True))
    return struct.pack("<BII", _GROUP, len(blocks), digits) + heads + b"".join(coded)


def _listed(index: list[tuple[bool, int, int]]) -> bytes:
    """A chunk of the index: number of bytes, then the documents."""
    packed = zlib.compress(b"".join(struct.pack("<?qq", *x) for x in index))
    return struct.pack("<BI", _INDEX, len(packed)) + packed


class _File:
    """A file that is being written."""

    def __init__(self, folder: str, kind: np.dtype, digits: int):
        self.kind, self.digits = kind, digits
        store, at = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tok"
        self.path, self.total, self.held, self.index = f"{folder}/{name}", 0, bytearray(), []
        self.out = store.open_output_stream(f"{at}/{name}", compression=None)
        self.out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        self.held += ids
        n = len(ids) // self.kind.itemsize
        self.index.append((key is None, key or 0, n))
        self.total += n
        if len(self.held) >= self.kind.itemsize * BLOCK * LANES or len(self.index) >= INDEX_DOCUMENTS:
            self.flush(False)

    def flush(self, all_of_it: bool) -> None:
        if self.index:
            self.out.write(_listed(self.index))
            self.index = []
        ids = np.frombuffer(bytes(self.held), self.kind).astype(np.int64)
        whole = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        blocks = [ids[i : i + BLOCK] for i in range(0, whole, BLOCK)]
        for i in range(0, len(blocks), LANES):
            self.out.write(_group(blocks[i : i + LANES], self.digits))
        del self.held[: self.kind.itemsize * whole]

    def close(self, part: int, nth: int) -> pa.RecordBatch:
        self.flush(True)
        self.out.write(bytes([_END]))
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([self.path]), pa.array([self.total], pa.int64())], names=["part", "nth", "path", "tokens"])


def write_tokens(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns their list (part, nth, path, tokens), one row a file."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    dealt = rows.repartitionByRange(partitions(spark), "row_id").sortWithinPartitions("row_id", "body").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = _Tokens(path)
        own, file, part, nth = _tokens[path], None, 0, 0
        end, digits = np.array([end_id], own.kind).tobytes(), _digits(max(own.most, end_id))
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                part = piece.column("part")[0].as_py()
                for key, ids in zip(piece.column("row_id").to_pylist(), own.encode(piece.column("body").to_pylist()), strict=True):
                    if file is not None and file.total >= FILE_TOKENS:
                        yield file.close(part, nth)
                        file, nth = None, nth + 1
                    file = _File(folder, own.kind, digits) if file is None else file
                    file.add(key, ids + end)
        if file is not None:
            yield file.close(part, nth)

    return materialize(dealt.mapInArrow(lean(write), "part int, nth int, path string, tokens long"), "token-list")


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(identifier, ids) of every document of an open file, in order; checks every block."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    held, have = [], 0
    waiting: list[tuple[bool, int, int]] = []  # documents whose ids are not all read
    while (kind := source.read(1)) != bytes([_END]):
        if not kind:
            raise ValueError("the file ends early")
        if kind[0] == _INDEX:
            waiting += struct.iter_unpack("<?qq", zlib.decompress(source.read(struct.unpack("<I", source.read(4))[0])))
            continue
        n, digits = struct.unpack("<II", source.read(8))
        heads = [struct.unpack("<III", source.read(12)) for _ in range(n)]
        coded = [source.read(h[1]) for h in heads]
        for (_, _, check), ids in zip(heads, decode_blocks(coded, [h[0] for h in heads], digits), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                raise ValueError("a block's checksum does not match")
            held.append(ids)
            have += len(ids)
        done = 0
        joined, at = np.concatenate(held), 0
        for null, key, n in waiting:
            if at + n > have:
                break
            yield None if null else key, joined[at : at + n]
            at, done = at + n, done + 1
        del waiting[:done]
        held, have = [joined[at:]], have - at


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Read the files back: row_id, start (ids of all documents before), n_tokens, ids_crc32."""
    listed = files.orderBy("part", "nth").collect()  # one row a file
    bases, base = [], 0
    for row in listed:
        bases.append((row["path"], base))
        base += row["tokens"]
    schema = "row_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(at) as source:
                    for key, ids in read_file(source):
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["row_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["row_id", "start", "n_tokens", "ids_crc32"])

    todo = spark.createDataFrame(bases, "path string, base long").repartition(max(1, len(bases)))
    return todo.mapInArrow(lean(read), schema)
