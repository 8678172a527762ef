"""Exact Jaccard self-join on word shingles by relations between sets.

Documents are sets of 64-bit hashes of five consecutive words; equal sets are one set.  The join
does the work for similar sets once:

1. *Index lists.*  All shingles are ordered by how often they occur (read from a count sketch of
   fixed size, ties by hash), rare ones first.  Two sets that reach the threshold share a shingle
   among the first n - ceil(t n) + 1 of each.  An index list holds the sets whose prefix has that
   shingle, with their sizes and the shingle's position.  Lists of a single set are never made:
   tokens are dealt as packed keys, and each block of sets is told by one bit a key what is shared.
2. *Pivots.*  The set with the earliest position in a list has the fewest rare shingles of its own,
   so it is the most central one; every other set of the list is offered it as a pivot and compared
   exactly.  Sets that stay apart are offered the next one, as long as that is worth a round.
   Linked sets are in one component, and nothing inside a component is looked at again.
3. *Skipped blocks.*  What is left of the lists is cut into blocks by size (in steps of five per
   cent), pivot and component.  From its least size and greatest remainder behind the position a
   block knows which sizes it can link with; it meets only blocks of those sizes and of other
   components, by an equi-join on token and size.
4. *Derived answers.*  The pivots of a remaining pair of groups are compared exactly.  If they are
   linked, so are the groups, without looking at members.  If not, the Jaccard distance is a metric:
   members x of A and y of B can only be linked if d(A, B) - d(x, A) - d(y, B) <= 1 - t, so most
   groups are done; members of the others meet by the same blocks and are compared exactly.

No list is collected, and no token, set or pivot needs a task of its own.

Defined cases: a text of fewer words than a shingle is one shingle of all its words; an empty, null
or blank text has no shingle and links with nothing; a null identifier is never a component, and
rows with one take part in no link unless a row with the same set has an identifier; repeated rows
each get a result, and rows that repeat an identifier with different texts are different documents;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.components import components
from rillmark.llm.shared import discard, fresh_names, in_groups, lean, partitions, settle, small, tidy
from rillmark.llm.words import mix, words

SHINGLE = 5
THRESHOLD = 80  # per cent
SKETCH = 1 << 22
SLICES = 64
SEEN = 50_000  # digests a task remembers; a set that returns later is only written again
BLOCK_TOKENS = 1 << 17
PART_TOKENS = 1 << 19  # keys of a part that are in memory at once, about
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
STEPS = 20  # size blocks: by the natural logarithm of the size
MOST_ROUNDS, WORTH = 6, 8
_FACTOR = np.random.default_rng(77).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row, whole texts."""
    for part in words(column):
        hashes, at = part.hashes, part.at
        n = len(hashes) - k + 1
        grams = np.zeros(0, np.uint64)
        if n > 0:
            grams = hashes[:n] * _FACTOR[0]
            for j in range(1, k):
                grams += hashes[j : j + n] * _FACTOR[j]
            grams = mix(grams)
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            count = end - begin
            if count >= k:
                yield np.unique(grams[begin : end - k + 1])
            elif count:
                yield mix((hashes[begin:end] * _FACTOR[:count]).sum(keepdims=True) + np.uint64(count))
            else:
                yield grams[:0]


def _digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    n = np.uint64(len(own))
    one = mix(mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(keepdims=True) + n)
    two = mix(mix(own * np.uint64(0xD6E8FEB86659FD93)).sum(keepdims=True) ^ n)
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def _prefix_length(n: int) -> int:
    return n - (THRESHOLD * n + 99) // 100 + 1


def _scan(docs: DataFrame) -> DataFrame:
    """kind 0: each row's size and digest (and shingles, where a task meets a set first); kind 1:
    slices of the task's count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SKETCH, np.uint32), set()
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                sizes, ones, twos, held = [], [], [], []
                for own in shingle_sets(batch.column("body")):
                    n = len(own)
                    digest = _digest(own) if n else (0, 0)
                    first = n > 0 and digest not in seen
                    if first:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        counts[(own & np.uint64(SKETCH - 1)).astype(np.int64)] += np.uint32(1)
                    sizes.append(n)
                    ones.append(digest[0])
                    twos.append(digest[1])
                    held.append(own.view(np.int64) if first else None)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column("row_id"), batch.column("body_hash"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(held, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SLICES, -1)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * SLICES, pa.int32()), none, none, none, none, none, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    names = ["kind", "row_id", "body_hash", "n", "d1", "d2", "shingles", "slice", "counts"]
    return docs.mapInArrow(lean(run), "kind int, row_id long, body_hash long, n long, d1 long, d2 long, shingles array<long>, slice int, counts binary")


def _sum_slices(sketches: DataFrame, *keys: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(data), np.uint32)
                total[number] = total[number] + own if number in total else own
        if total:
            packed = [zlib.compress(x.tobytes(), 1) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    return sketches.repartition(partitions(sketches.sparkSession), *keys).select("slice", "counts").mapInArrow(lean(run), "slice int, counts binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The summed count sketch: SKETCH counters reach the driver, whatever the input's size."""
    own = scanned.filter("kind = 1").select("slice", "counts").withColumn("salt", F.floor(F.rand(5) * 16))
    found = _sum_slices(_sum_slices(own, "slice", "salt"), "slice").collect()
    counts = np.zeros((SLICES, SKETCH // SLICES), np.uint32)
    for row in found:
        counts[row["slice"]] += np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return counts.reshape(-1)


def _prefixes(scanned: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(d1, d2, n, tokens) of written sets: their prefixes, rare shingles first."""
    shared = scanned.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            held, tokens = batch.column("shingles"), []
            at, values = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = values[begin:end]
                order = np.lexsort((own, counts[(own & np.uint64(SKETCH - 1)).astype(np.int64)]))
                tokens.append(own[order[: _prefix_length(len(own))]].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d1", "d2", "n")), pa.array(tokens, pa.list_(pa.int64()))], names=["d1", "d2", "n", "tokens"])

    return scanned.filter("shingles is not null").select("d1", "d2", "n", "shingles").mapInArrow(lean(run), "d1 long, d2 long, n long, tokens array<long>")


_BLOCK = "block long, tokens binary, sids binary, n binary, size binary"
_ASKED = "block long, part int, keys binary, sids binary, n binary, place binary"


def _sid(one: np.ndarray, two: np.ndarray, turn: int) -> np.ndarray:
    """A set's number by its digest; ``turn`` is chosen so that no two sets of the data share one."""
    return one ^ two >> np.int64(64 - turn) if turn else one


def _blocks(prefixes: DataFrame, turn: int) -> DataFrame:
    """Blocks of distinct sets, one row each: their prefixes, numbers, sizes and prefix lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, held, total = TaskContext.get().partitionId() << 32, None, [], 0

        def flush() -> pa.RecordBatch:
            one, two, n, tokens = zip(*held, strict=True)
            sides = [np.concatenate(tokens), _sid(np.array(one, np.int64), np.array(two, np.int64), turn), np.array(n, np.int64), np.array([len(t) for t in tokens], np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in sides)], names=["block", "tokens", "sids", "n", "size"])

        for batch in batches:
            tokens = batch.column("tokens")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "n")), strict=True)):
                if row[:2] == last:
                    continue
                last = row[:2]
                held.append((*row, np.asarray(tokens[i].values)))
                total += len(held[-1][3])
                if total >= BLOCK_TOKENS:
                    yield flush()
                    number, held, total = number + 1, [], 0
        if held:
            yield flush()

    return prefixes.repartition(partitions(prefixes.sparkSession), "d1").sortWithinPartitions("d1", "d2").mapInArrow(lean(run), _BLOCK)


def _opened(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's number, and the token, set, size and position of each entry."""
    tokens, sids, n, size = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("tokens", "sids", "n", "size"))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
    return batch.column("block")[i].as_py(), tokens, np.repeat(sids, size), np.repeat(n, size), place


def _asked(number: int, keys: np.ndarray, columns: list[np.ndarray | None], parts: int) -> Iterator[pa.RecordBatch]:
    """A block's ascending keys and what goes with them, a row for each part (a range of keys)."""
    at = np.searchsorted(keys, (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts) << np.uint64(32))
    at = np.r_[0, at, len(keys)]
    some = np.flatnonzero(np.diff(at)).tolist()
    for i in range(0, len(some), 512):
        own = some[i : i + 512]
        packed = [pa.nulls(len(own), pa.binary()) if x is None else pa.array([x[at[j] : at[j + 1]].tobytes() for j in own], pa.binary()) for x in (keys, *columns)]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), pa.array(own, pa.int32()), *packed], names=["block", "part", "keys", "sids", "n", "place"])


def _told(asked: DataFrame, parts: int, hubs: bool) -> DataFrame:
    """Answers to each block and part in the order of its keys.

    At first (``n``: how many sets of the block have the key, two standing for more) whether several
    sets have it; then of all blocks' entries the one of the earliest position, and how many there
    are (above the position's 32 bits)."""

    def answer(part: int, rows: list[tuple]) -> pa.RecordBatch:
        lists = [np.frombuffer(r[1], np.uint64) for r in rows]
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.concatenate([np.frombuffer(r[3], np.int64 if hubs else np.uint8) for r in rows])
        at = np.cumsum([0, *map(len, lists)])
        if hubs:
            sids, packed = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in (2, 4))
            place, count = packed & _PLACE, packed >> 32
            order = np.lexsort((sids, place, inverse))
            best = order[np.flatnonzero(np.r_[True, np.diff(inverse[order]) > 0])]
            place = place[best] | np.bincount(inverse, count, len(distinct)).astype(np.int64) << 32
            columns = [[x[inverse][i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)] for x in (sids[best], n[best], place)]
        else:
            shared = (np.bincount(inverse, n, len(distinct)) > 1)[inverse]
            columns = [[None] * len(rows), [shared[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], [None] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), *(pa.array(c, pa.binary()) for c in columns)], names=["block", "part", "keys", "sids", "n", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for block, own, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part and rows:
                    yield answer(part, rows)
                    rows = []
                part = own
                rows.append((block, *packed))
        if rows:
            yield answer(part, rows)

    return asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(run), _ASKED)


def _visited(blocks: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """The answers to a block, and then the block, in one task."""
    answers = told.withColumnsRenamed({"sids": "hub", "n": "hub_n", "place": "hub_place"}).drop("keys")
    rows = blocks.withColumn("part", F.lit(2**31 - 1)).unionByName(answers, allowMissingColumns=True)
    return rows.repartition(parts, "block").sortWithinPartitions("block", "part")


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[tuple]]]:
    """Each block's row with the packed answers (hub, hub_n, hub_place) that came before it."""
    told: list[tuple] = []
    for batch in batches:
        part = batch.column("part").to_pylist()
        for i in range(batch.num_rows):
            if part[i] == 2**31 - 1:
                yield batch, i, told
                told = []
            else:
                told.append(tuple(batch.column(c)[i].as_py() for c in ("hub", "hub_n", "hub_place")))


_PLACE = (1 << 32) - 1
_ENTRIES = "token long, sid long, n int, rest int, hub long, offered boolean, open boolean"


def _lists(prefixes: DataFrame, tokens: int, turn: int) -> DataFrame:
    """Index lists (token, sid, n, rest) of the tokens that more than one set has in its prefix.

    ``offered`` entries can link with the most central set of their list (hub).  The offer decides all
    pairs with the hub, so it stays out of what is left (``open``), as do lists of two sets."""
    parts = max(partitions(prefixes.sparkSession), -(-tokens // PART_TOKENS))
    blocks = in_groups(_blocks(prefixes, turn), "prefix-blocks")

    def ask_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("tokens")[i].as_py(), np.uint64)
                keys, count = np.unique(tokens, return_counts=True)
                yield from _asked(batch.column("block")[i].as_py(), keys, [None, np.minimum(count, 2).astype(np.uint8), None], parts)

    def keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, told in _answered(batches):
            number, tokens, sids, n, place = _opened(batch, i)
            inverse = np.unique(tokens.view(np.uint64), return_inverse=True)[1]
            keep = np.frombuffer(b"".join(t[1] for t in told), bool)[inverse]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x[keep].tobytes()], pa.binary()) for x in (tokens, sids, n, place))], names=["block", "tokens", "sids", "n", "size"])

    def ask_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, sids, n, place = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("tokens", "sids", "n", "size"))
                order = np.lexsort((sids, place, tokens.view(np.uint64)))
                starts = np.flatnonzero(np.r_[True, np.diff(tokens[order]) != 0])
                first, count = order[starts], np.diff(np.r_[starts, len(order)])
                yield from _asked(batch.column("block")[i].as_py(), tokens[first].view(np.uint64), [sids[first], n[first], place[first] | count << 32], parts)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, told in _answered(batches):
            tokens, sids, n, place = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("tokens", "sids", "n", "size"))
            inverse = np.unique(tokens.view(np.uint64), return_inverse=True)[1]
            hub, hub_n, hub_place = (np.frombuffer(b"".join(t[k] for t in told), np.int64)[inverse] for k in range(3))
            hub_place, count = hub_place & _PLACE, hub_place >> 32
            sized = 100 * np.minimum(n, hub_n) >= THRESHOLD * np.maximum(n, hub_n)
            placed = (100 + THRESHOLD) * np.minimum(n - place, hub_n - hub_place) >= THRESHOLD * (n + hub_n)
            offered, open_ = sized & placed & (sids != hub), (count > 2) & (sids != hub)
            keep = offered | open_
            columns = [x[keep] for x in (tokens, sids, n.astype(np.int32), (n - place).astype(np.int32), hub, offered, open_)]
            for j in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[j : j + 50_000]) for x in columns], names=["token", "sid", "n", "rest", "hub", "offered", "open"])

    shared = in_groups(_visited(blocks, _told(blocks.mapInArrow(lean(ask_shared), _ASKED), parts, False), parts).mapInArrow(lean(keep_shared), _BLOCK), "shared-prefixes")
    discard(blocks)
    found = in_groups(_visited(shared, _told(shared.mapInArrow(lean(ask_hubs), _ASKED), parts, True), parts).mapInArrow(lean(entries), _ENTRIES), "index-lists")
    discard(shared)
    return found


def _fetch(scanned: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, shingles) of the wanted sets (sid, d1, d2).

    A filter sized by their number, up to MOST_BITS bits, keeps other sets out of the shuffle."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.col("d1"), F.lit(bits))
    lanes = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("lane")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy()
    shared = scanned.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            place = batch.column("d1").to_numpy() % bits
            keep = held[place >> 6] >> (place & 63) & 1
            if keep.any():
                yield batch.filter(pa.array(keep.astype(bool)))

    found = scanned.filter("shingles is not null").select("d1", "d2", "shingles").mapInArrow(lean(run), "d1 long, d2 long, shingles array<long>")
    found = found.groupBy("d1", "d2").agg(F.max("shingles").alias("shingles"))
    return in_groups(found.join(wanted, ["d1", "d2"]).select("sid", "shingles"), "sets")


def _compare(scanned: DataFrame, names: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """pairs (a, b, ...), which must be materialized, with the exact intersection and union of their sets."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "sid")
    wanted = in_groups(names.join(wanted, "sid"), "wanted")
    sets = _fetch(scanned, wanted)
    right = pairs.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("right")), "b")
    both = right.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("left")), "a")
    common = F.size(F.array_intersect("left", "right")).cast("long")
    found = both.withColumn("common", common).withColumn("either", F.size("left") + F.size("right") - F.col("common")).drop("left", "right")
    compared = in_groups(found, label)
    discard(wanted)
    discard(sets)
    return compared


_LINKED = f"100 * common >= {THRESHOLD} * either"


def _possible(a: str, b: str) -> str:
    """Whether sets of sizes ``*_n`` may reach the threshold: a first common shingle leaves an overlap
    of the smaller remainder ``*_rest`` at most."""
    return f"100L * least({a}_n, {b}_n) >= {THRESHOLD}L * greatest({a}_n, {b}_n) and {100 + THRESHOLD}L * least({a}_rest, {b}_rest) >= {THRESHOLD}L * ({a}_n + {b}_n)"


def _linked_components(compared: DataFrame) -> DataFrame | None:
    """(sid, component) of the sets in links, the component being its least set."""
    links = compared.filter(_LINKED).select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not links.limit(1).count():
        return None
    return in_groups(components(links).select(F.col("node").alias("sid"), "component"), "components")


def _pivots(scanned: DataFrame, names: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The comparisons (a: pivot, b, common, either) of all rounds, (sid, component) by them, and the
    entries that are left."""
    offers = in_groups(lists.filter("offered").select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct(), "offers")
    done = _compare(scanned, names, offers, "compared")
    found = _linked_components(done)
    entries = lists.filter("open").select("token", "sid", "n", "rest")
    if found is None:
        return done, None, entries.withColumn("component", F.col("sid"))
    left = in_groups(_apart(entries, found), "left")
    entry = F.struct((F.col("n") - F.col("rest")).alias("place"), "sid", "n", "rest")
    last: DataFrame | None = None
    for _ in range(MOST_ROUNDS if _many(left) else 0):  # offer the next set of each list
        later = left if last is None else left.join(last.withColumnRenamed("hub", "before"), "token").filter(entry > F.col("before"))
        last = in_groups(later.groupBy("token").agg(F.min(entry).alias("hub")), "pivots")
        side = last.select("token", F.col("hub.sid").alias("a"), F.col("hub.n").alias("a_n"), F.col("hub.rest").alias("a_rest"))
        side = side.join(found.select(F.col("sid").alias("a"), F.col("component").alias("a_component")), "a", "left").withColumn("a_component", F.coalesce("a_component", "a"))
        met = left.withColumnsRenamed({"sid": "b", "n": "b_n", "rest": "b_rest"}).join(side, "token").filter(f"component <> a_component and {_possible('a', 'b')}")
        tried = done.select("a", "b").union(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
        offers = in_groups(met.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "offers")
        compared = _compare(scanned, names, offers, "compared")
        linked = compared.filter(_LINKED).count()
        done = done.unionByName(compared)
        if linked:
            found = _linked_components(done)
            before, left = left, in_groups(_apart(left.drop("component"), found), "left")
            discard(before)
        if 10 * linked < offers.count():  # few sets are left that a pivot would take
            break
    return done, found, left


def _many(left: DataFrame) -> bool:
    """Whether sets of different components would meet in the lists' blocks more often than there are entries."""
    rows = left.withColumn("block", _block(F.col("n"))).filter(f"{100 + THRESHOLD}L * rest >= {2 * THRESHOLD}L * n")
    each = rows.groupBy("token", "block", "component").agg(F.count(F.lit(1)).alias("c"))
    whole = each.groupBy("token", "block").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("met"))
    return (whole.agg(F.sum("met")).first()[0] or 0) > WORTH * left.count()


def _apart(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The entries with their components, of tokens that several components have."""
    rows = entries.join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    return rows.join(mixed, "token", "left_semi")


def _block(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * STEPS).cast("int")


def _met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (token, block, component, keys..., least, most, rest) paired as a_ and b_, a being the
    larger one: blocks of different components that sizes and positions don't rule out.

    ``rows`` stand for blocks of sets of sizes least to most and remainders up to rest."""
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("least", "most", "rest")})
    top = F.least(F.col("most"), F.floor(((100 + THRESHOLD) * F.col("rest").cast("long") - THRESHOLD * F.col("least").cast("long")) / THRESHOLD))
    low = F.ceil(THRESHOLD * F.col("least").cast("long") / 100)
    able = rows.withColumns({"top": top, "low": low}).filter("top >= low and top > 0")
    a = able.withColumn("block", F.explode(F.sequence(_block(F.col("low")), _block(F.col("top"))))).drop("top", "low")
    a = a.withColumnsRenamed({c: f"a_{c}" for c in (*keys, "component", "least", "most", "rest")})
    b = rows.withColumnsRenamed({c: f"b_{c}" for c in (*keys, "component", "least", "most", "rest")})
    possible = f"a_component <> b_component and b_least <= a_most and 100L * b_most >= {THRESHOLD}L * a_least and {100 + THRESHOLD}L * least(a_rest, b_rest) >= {THRESHOLD}L * (a_least + b_least)"
    return a.join(b, ["token", "block"]).filter(possible)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: row_id, n_shingles, component_id."""
    return settle(lambda: _components(docs, id_col, text_col).select("row_id", F.col("n").alias("n_shingles"), "component_id"), "near-groups")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, body_hash (of the text), n, group (null without shingles) and component_id of each row."""
    with tidy(docs.sparkSession):
        return _grouped(docs, id_col, text_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(body).alias("body_hash"), body.alias("body"))
    scanned = in_groups(_scan(source), "scan")
    rows = scanned.filter("kind = 0").select("row_id", "body_hash", "n", "d1", "d2")
    sets = rows.filter("n > 0 and row_id is not null").groupBy("d1", "d2").agg(F.min("row_id").alias("label"), F.max("n").alias("n"))
    sets, turn = in_groups(sets, "distinct-sets"), 0
    while True:
        sets = sets.withColumn("sid", F.col("d1").bitwiseXOR(F.shiftright("d2", 64 - turn) if turn else F.lit(0).cast("long")))
        if not sets.groupBy("sid").count().filter("count > 1").limit(1).count():
            break
        turn += 1
    names = sets.select("sid", "d1", "d2")

    shingles = sets.agg(F.sum("n")).first()[0] or 0
    lists = _lists(_prefixes(scanned, _sketch(scanned)), shingles * (100 - THRESHOLD) // 100, turn)
    compared, found, left = _pivots(scanned, names, lists)
    if found is not None:
        discard(lists)
    more = _across(scanned, names, left, compared)
    if more is not None:
        # edges between components found so far, and then what they make of them
        again = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        known = names.select("sid", F.col("sid").alias("component")) if found is None else names.select("sid").join(found, "sid", "left").select("sid", F.coalesce("component", "sid").alias("component"))
        found = in_groups(known.join(again, "component", "left").select("sid", F.coalesce("whole", "component").alias("component")), "components")
    grouped = sets if found is None else sets.join(found, "sid", "left")
    grouped = grouped.withColumn("group", F.col("sid") if found is None else F.coalesce("component", "sid"))
    least = grouped.groupBy("group").agg(F.min("label").alias("least"))
    named = in_groups(grouped.join(least, "group").select("d1", "d2", "group", "least"), "named-sets")
    each = rows.join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("row_id"))
    return each.select("row_id", "body_hash", "n", "group", component.alias("component_id"))


def _across(scanned: DataFrame, names: DataFrame, left: DataFrame, compared: DataFrame) -> DataFrame | None:
    """Edges (u, v) between components whose sets are linked though no pivot has told."""
    linked = compared.filter(_LINKED).withColumn("distance", 1 - F.col("common") / F.col("either"))
    used = linked.select(F.col("a").alias("sid")).distinct().withColumn("pivot", F.col("sid"))
    best = linked.groupBy(F.col("b").alias("sid")).agg(F.min(F.struct("distance", "a")).alias("best"))
    best = best.join(used.select("sid"), "sid", "left_anti").select("sid", F.col("best.a").alias("pivot"), F.col("best.distance").alias("distance"))
    members = in_groups(best.unionByName(used.withColumn("distance", F.lit(0.0))), "members")

    entries = left.join(members, "sid", "left")
    entries = entries.withColumns({"pivot": F.coalesce("pivot", "sid"), "distance": F.coalesce("distance", F.lit(0.0)), "block": _block(F.col("n"))})
    entries = in_groups(entries, "entries")
    if hasattr(left, "_rillmark_path"):
        discard(left)
    blocks = entries.groupBy("token", "block", "component", "pivot").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    pairs = _met(blocks, ["pivot"]).select(F.least("a_pivot", "b_pivot").alias("a"), F.greatest("a_pivot", "b_pivot").alias("b")).distinct()
    pairs = in_groups(pairs, "pivot-pairs")
    if not pairs.limit(1).count():
        return None
    told = _compare(scanned, names, pairs, "compared-pivots")
    of = entries.select(F.col("pivot"), "component").distinct()
    edges = told.filter(_LINKED).join(of.withColumnsRenamed({"pivot": "a", "component": "u"}), "a").join(of.withColumnsRenamed({"pivot": "b", "component": "v"}), "b").select("u", "v")

    reach = members.groupBy("pivot").agg(F.max("distance").alias("reach"))
    far = told.filter(f"not ({_LINKED})").withColumn("gap", 1 - F.col("common") / F.col("either") - F.lit(1 - THRESHOLD / 100 + 1e-9))
    for side in "ab":
        far = far.join(reach.withColumnsRenamed({"pivot": side, "reach": f"{side}_reach"}), side, "left")
    far = in_groups(far.filter("gap <= coalesce(a_reach, 0) + coalesce(b_reach, 0)").select("a", "b", "gap"), "open-pairs")
    if not far.limit(1).count():
        return edges
    wanted = far.select(F.col("a").alias("pivot")).union(far.select("b")).distinct()
    able = entries.join(wanted, "pivot", "left_semi").withColumns({"least": F.col("n"), "most": F.col("n")}).drop("n")
    met = _met(able, ["sid", "pivot", "distance"]).select("a_sid", "b_sid", "a_component", "b_component", (F.col("a_distance") + F.col("b_distance")).alias("reach"), F.least("a_pivot", "b_pivot").alias("a"), F.greatest("a_pivot", "b_pivot").alias("b")).distinct()
    met = met.join(far, ["a", "b"]).filter("reach >= gap")
    met = met.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"), F.col("a_component").alias("u"), F.col("b_component").alias("v")).distinct()
    more = _compare(scanned, names, in_groups(met, "member-pairs"), "compared-members").filter(_LINKED)
    return edges.unionByName(more.select("u", "v"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all columns: the one that names the component.

    A document is an identifier with its text: rows that repeat both stay or go together, and of one
    identifier's texts in a group one stays.  Rows without a shingle, or in a group without an
    identifier, stay."""
    gone, text_hash = fresh_names(docs, "gone", "text_hash")

    def others() -> DataFrame:
        found = _components(docs, id_col, text_col).filter("group is not null and row_id is not null")
        stays = found.groupBy("group").agg(F.min(F.struct("row_id", "body_hash")).alias("stays"))
        return found.join(stays, "group").filter(F.struct("row_id", "body_hash") != F.col("stays")).select(F.col("row_id").alias(gone), F.col("body_hash").alias(text_hash)).distinct()

    drop = settle(others, "near-copies")
    drop = small(drop, drop)
    same = (F.col(id_col).cast("long") == F.col(gone)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(text_hash))
    return docs.join(drop, same, "left_anti")
