"""Exact deduplication over a log-structured merge index of content digests.

Every task collects digests in a memtable (digest -> kept identifier, rows).  A full memtable is
flushed as one sorted run, cut by ranges of digests into segments.  Compaction deals the segments of
a range, not their rows, to one task, which merges the sorted segments into one of the next
generation, keeping the smallest (or largest) identifier and the rows of each digest; the merged
runs' predecessors are deleted.  A digest costs one entry a memtable however many rows have it.

A segment of a compacted generation carries a filter of the digests that several rows have, sized by
their number.  Rows ask the filter of their digest's range; the few that pass are hits.  Hits are
grouped by digest and all their bytes, combined in each task before the shuffle, which verifies the
index: where a digest turns out to have different texts, the groups are those of the texts, so the
result does not rest on the digest.

Defined cases: a null text counts as empty; null identifiers sort below all others, and a group of
null identifiers only has a null ``keep_id``; of rows that repeat both identifier and text exactly
one is kept; an empty table gives an empty result; further columns are ignored, or kept whole by
``drop_copies`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm.shared import fresh_names, lean, materialize, new_path, partitions, remove, settle, small

MEMTABLE_ROWS = 200_000
#: Bits of a filter for each repeated digest, and of all ranges' filters together at most.
BITS_EACH, MOST_BITS = 16, 1 << 28
_SEGMENT = "part int, digests binary, widths binary, keep_ids binary, no_id binary, sizes binary, filter binary"
_BYTES = np.dtype("<i8")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _segment(part: int, entries: list[tuple[bytes, int | None, int]], bits: int | None) -> list:
    """A sorted run of a range: digests, identifiers and rows as packed columns, and its filter."""
    digests = b"".join(e[0] for e in entries)
    widths = np.array([len(e[0]) for e in entries], _BYTES).tobytes()
    ids = np.array([0 if e[1] is None else e[1] for e in entries], _BYTES).tobytes()
    none = np.packbits(np.array([e[1] is None for e in entries], bool)).tobytes()
    held = None
    if bits is not None:
        table = np.zeros(bits, bool)
        table[[_slot(e[0], bits) for e in entries if e[2] > 1]] = True
        held = np.packbits(table).tobytes()
    return [part, digests, widths, ids, none, np.array([e[2] for e in entries], _BYTES).tobytes(), held]


def _entries(digests: bytes, widths: bytes, ids: bytes, none: bytes, sizes: bytes) -> list[tuple[bytes, int | None, int]]:
    ends = np.cumsum(np.frombuffer(widths, _BYTES)).tolist()
    nulls = np.unpackbits(np.frombuffer(none, np.uint8), count=len(ends)).tolist()
    begins = [0, *ends[:-1]]
    return [(digests[b:e], None if null else i, n) for b, e, null, i, n in zip(begins, ends, nulls, np.frombuffer(ids, _BYTES).tolist(), np.frombuffer(sizes, _BYTES).tolist(), strict=True)]


def _hash(digest: bytes) -> int:
    """The first eight bytes, or fewer with the length, as a number: digests are hashes already."""
    return int.from_bytes(digest[:8].ljust(8, bytes([len(digest) & 255])), "big")


def _range(digest: bytes, parts: int) -> int:
    return (_hash(digest) >> 32) * parts >> 32


def _slot(digest: bytes, bits: int) -> int:
    return (_hash(digest) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20 & bits - 1


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _SEGMENT.split(", ")])


class DigestIndex:
    """Generations of sorted runs of (digest, kept identifier, rows) below a shared path.

    ``keep`` says which identifier of a group survives compaction: ``min`` or ``max``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS):
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.keep, self.memtable_rows = spark, keep, memtable_rows
        self.path = path or new_path(spark, "digest-index")
        self.parts = partitions(spark)
        self.generation = 0
        self.runs: list[str] = []

    def _better(self) -> Callable[[int | None, int | None], int | None]:
        smallest = self.keep == "min"

        def better(a: int | None, b: int | None) -> int | None:
            if a is None or b is None:
                return a if b is None else b
            return a if (a < b) == smallest else b

        return better

    def flush(self, entries: DataFrame) -> None:
        """Add ``entries`` (digest binary, keep_id long) as sorted runs."""
        limit, parts, better = self.memtable_rows, self.parts, self._better()

        def run(table: dict) -> Iterator[pa.RecordBatch]:
            cut: dict[int, list] = {}
            for digest in sorted(table):
                cut.setdefault(_range(digest, parts), []).append((digest, *table[digest]))
            rows = [_segment(part, found, None) for part, found in cut.items()]
            for i in range(0, len(rows), 500):
                yield _batch(rows[i : i + 500])

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[bytes, tuple[int | None, int]] = {}
            for batch in batches:
                for digest, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    kept, n = table.get(digest, (None, 0))
                    table[digest] = (better(kept, key), n + 1)
                    if len(table) >= limit:
                        yield from run(table)
                        table = {}
            if table:
                yield from run(table)

        self._write(entries.select("digest", F.col("keep_id").cast("long")).mapInArrow(lean(memtables), _SEGMENT))

    def compact(self) -> DataFrame:
        """Merge all runs into one generation with one entry a digest, and return it."""
        better, most = self._better(), max(64, MOST_BITS // self.parts)

        def merge(part: int, segments: list[list]) -> pa.RecordBatch:
            merged: list[tuple[bytes, int | None, int]] = []
            for digest, key, n in sorted((e for s in segments for e in s), key=lambda e: e[0]):  # sorted runs: one merge
                if merged and merged[-1][0] == digest:
                    merged[-1] = (digest, better(merged[-1][1], key), merged[-1][2] + n)
                else:
                    merged.append((digest, key, n))
            repeated = sum(e[2] > 1 for e in merged)
            return _batch([_segment(part, merged, min(1 << (most.bit_length() - 1), max(64, 1 << (BITS_EACH * repeated).bit_length())))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, segments = None, []
            for batch in batches:
                for own, *packed in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                    if own != part and segments:
                        yield merge(part, segments)
                        segments = []
                    part = own
                    segments.append(_entries(*packed))
            if segments:
                yield merge(part, segments)

        old = self.runs
        dealt = self._segments().repartition(self.parts, "part").sortWithinPartitions("part")
        self.runs = []
        self._write(dealt.mapInArrow(lean(run), _SEGMENT))
        for path in old:
            remove(self.spark, path)
        return self.read()

    def _segments(self) -> DataFrame:
        return self.spark.read.schema(_SEGMENT).parquet(*self.runs)

    def read(self, least: int = 1) -> DataFrame:
        """(digest, keep_id, group_size) of the entries with that many rows at least."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = [e for e in _entries(*row) if e[2] >= least]
                    for i in range(0, len(found), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[i : i + 10_000], strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["digest", "keep_id", "group_size"])

        return self._segments().drop("part", "filter").mapInArrow(lean(run), "digest binary, keep_id long, group_size long")

    def filters(self) -> dict[int, np.ndarray]:
        """Each range's filter of digests with several rows: MOST_BITS bits together at most."""
        rows = self._segments().select("part", "filter").filter("filter is not null").collect()
        return {r["part"]: np.frombuffer(r["filter"], np.uint8) for r in rows}

    def _write(self, run: DataFrame) -> None:
        self.generation += 1
        path = f"{self.path}/run-{self.generation:05d}"
        run.write.parquet(path)
        self.runs.append(path)


def _tagged(rows: DataFrame, digest: str, tag: str, filters: dict[int, np.ndarray], parts: int, body: str | None = None) -> DataFrame:
    """``rows``, materialized, with a number of its own for each row that is a hit, else null; misses
    lose the column ``body``, if one is named."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), T.StructField(tag, T.LongType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = shared.value, TaskContext.get().partitionId() << 36

        def hit(d: bytes) -> bool:
            own = held.get(_range(d, parts))
            if own is None:
                return False
            slot = _slot(d, 8 * len(own))
            return bool(own[slot >> 3] >> (7 - (slot & 7)) & 1)

        for batch in batches:
            hits = np.fromiter(map(hit, batch.column(digest).to_pylist()), bool, batch.num_rows)
            columns = [pa.compute.if_else(pa.array(hits), c, pa.scalar(None, c.type)) if n == body else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number + np.arange(batch.num_rows), pa.int64(), mask=~hits)], names=schema.names)
            number += batch.num_rows

    return materialize(rows.mapInArrow(lean(probe), schema), "dedup-rows")


def _verified(hits: DataFrame, keep: str) -> tuple[DataFrame, DataFrame | None]:
    """Groups of ``hits`` (tag, row_id, digest, body) by their bytes: (digest, keep_id, group_size,
    keep_tag), and the same by (digest, body) of digests that several texts have, if there are any."""
    first = F.max(F.struct("row_id", (-F.col("tag")).alias("order"))) if keep == "max" else F.min(F.struct(F.col("row_id").isNull().alias("none"), "row_id", F.col("tag").alias("order")))
    groups = hits.groupBy("digest", "body").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    tag = -F.col("first.order") if keep == "max" else F.col("first.order")
    groups = materialize(groups.select("digest", "body", F.col("first.row_id").alias("keep_id"), "group_size", tag.alias("keep_tag")), "dedup-groups")
    several = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    if not several.limit(1).count():
        return groups.drop("body"), None
    several = materialize(several, "dedup-differing")
    return groups.drop("body").join(several, "digest", "left_anti"), groups.join(several, "digest", "left_semi")


def _index(rows: DataFrame, keep: str, memtable_rows: int) -> DigestIndex:
    """The compacted index of ``rows`` (row_id, digest)."""
    index = DigestIndex(rows.sparkSession, keep=keep, memtable_rows=memtable_rows)
    index.flush(rows.select("digest", F.col("row_id").alias("keep_id")))
    index.compact()
    return index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256_digest, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: row_id, keep_id, group_size, kept, digest.

    ``digest`` may be any deterministic function of the text to binary: equal bytes are verified.
    """
    return settle(lambda: _exact_dedup(docs, id_col, text_col, keep, digest, memtable_rows).drop("first"), "dedup")


def _exact_dedup(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Callable[[Column], Column], memtable_rows: int) -> DataFrame:
    """exact_dedup with ``first``: whether a row is the one of its identifier and text that counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), text.alias("body")).withColumn("digest", digest(F.col("body")))
    index = _index(rows, keep, memtable_rows)
    tagged = _tagged(rows, "digest", "tag", index.filters(), index.parts, "body")
    misses = tagged.filter("tag is null").select("row_id", F.col("row_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    hits = tagged.filter("tag is not null")
    plain, differing = _verified(hits, keep)
    own = ["row_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), "digest"]
    found = misses.unionByName(hits.drop("body").join(plain, "digest").select(*own))
    found = found if differing is None else found.unionByName(hits.join(differing, ["digest", "body"]).select(*own))
    return found.withColumn("first", F.col("kept") | ~F.col("row_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with their columns."""
    gone, digest = fresh_names(docs, "gone", "digest")
    names = {"row_id": gone, "digest": digest}
    others = settle(lambda: _exact_dedup(docs, id_col, text_col, keep, sha256_digest, MEMTABLE_ROWS).filter("not kept").select("row_id", "digest", "first").withColumnsRenamed(names), "copies")
    own = docs.withColumn(digest, sha256_digest(F.coalesce(F.col(text_col), F.lit(""))))
    # rows of the identifier that stays are gone only as repeats of the very row
    other = small(others.filter("first").drop("first").distinct(), others)
    left = own.join(other, own[id_col].cast("long").eqNullSafe(other[gone]) & (own[digest] == other[digest]), "left_anti")
    repeated = others.filter("not first").limit(1).count()
    return (left.dropDuplicates([id_col, digest]) if repeated else left).drop(digest)
