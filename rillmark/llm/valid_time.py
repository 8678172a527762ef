"""Valid-time enrichment: each sale with its client's state at the time of the sale, as a stream.

Sales and client changes arrive in batches.  A stateful streaming query keeps the versions of every
client and the sales that wait, and is started anew for each batch on one checkpoint:

* every row carries its table's *clock*: the largest timestamp of that table up to and including its
  batch.  A row is therefore never late for Spark, a batch without rows still brings its clock (one
  marker row), and Spark's watermark (clock minus ``delay``, the smaller of the two tables) is H;
* changes below their own table's watermark are late; every other change is one version;
* event-time timers (timeouts of the state's groups) release the sales that wait (no ``sold_at``, or ``sold_at`` < H) and then prune: of a
  client's versions with ``valid_at`` <= H only the last stays;
* a released sale takes its client's last unpruned version with ``valid_at`` <= ``sold_at``, in the order of
  ``valid_at``, ``seq``, ``change_id`` (null lowest);
* after the last batch a flush row for each bucket emits what still waits, as one batch more.

State is keyed by buckets of clients (a hash), so that a task works on arrays of thousands of rows
and not on one client at a time; a bucket has one timer, for the first of its clients that needs one.
The number of buckets grows with the rows.

A client with more than 1/HOT of the rows of a table would fill one bucket.  Its rows are cut by time
into at most SLICES + batches cells, each with a bucket of its own.  Cells end at the values of H, so
pruning takes a cell whole, and each cell is told the other cells' counts and last versions (bounded
summaries, at most cells x cells a batch): with them it knows the client's unpruned versions and the
version that holds when the cell begins.  There are at most 2 HOT such clients, and they alone are
broadcast.

Defined cases: repeated rows of sales are separate sales, repeated rows of changes are one; a row
without arrival day (for changes: without change_id) belongs to the last batch, one before the first
day to the first; changes without ``valid_at`` are ignored; null clients have no versions (their late
changes are reported); versions that tie are ordered by op and balance; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillmark.llm.shared import materialize, new_path, partitions

BATCHES, FIRST_DAY, DAYS, DELAY_HOURS = 8, 19723, 152, 12
#: Rows of the whole stream that one bucket of clients takes, about.
BUCKET_ROWS = 20_000
#: A client with more than this part of a table's rows is cut into cells of time.
HOT = 128
SLICES = 64
#: Clocks are shifted by so many seconds, as Spark's watermark begins at 0, and held between 0 and twice that
#: (1834 to 2106); what a clock loses by that, or below a millisecond, each start is told as ``rest``.
SHIFT = 1 << 32
_NONE = np.iinfo(np.int64).min

CHANGE, SALE, LATE, TICK, SUMMARY, FLUSH = range(6)
_FEED = "kind int, bucket int, client_id long, cell int, from_cell int, n long, id long, at long, seq long, cents long, op string, clock timestamp"
_VERSION = ["client_id", "cell", "at", "seq", "id", "cents", "op"]
_KEEP = {"versions": _VERSION, "waiting": ["client_id", "cell", "at", "id"], "entries": ["client_id", "cell", "from_cell", "n", "at", "seq", "id", "cents", "op"]}
_COLUMNS = [f.split()[0] for f in _FEED.split(", ") ]
_STATE = ", ".join(f"{name} binary" for name in _KEEP)
_OUT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string"
_ORDER = ["at", "seq", "id", "op", "cents"]


def _micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, in the session's zone."""
    return F.unix_micros(stamp.cast("timestamp"))


def _pack(table: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes | None, columns: list[str]) -> pd.DataFrame:
    if not data:
        kinds = {c: pd.Series([], dtype=object if c == "op" else np.int64) for c in columns}
        return pd.DataFrame(kinds)
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _ordered(table: pd.DataFrame, *first: str) -> pd.DataFrame:
    """Sorted by ``first`` and then in the versions' order; null operations come before all."""
    text = table["op"].fillna("").to_numpy(str) if len(table) else np.zeros(0, str)
    keys = [table["cents"].to_numpy(), text, *(table[c].to_numpy() for c in ("id", "seq", "at", *reversed(first)))]
    return table.iloc[np.lexsort(keys)].reset_index(drop=True)


def _groups(table: pd.DataFrame) -> np.ndarray:
    """Offsets of the runs of (client, cell) in a sorted table, and its length."""
    if not len(table):
        return np.zeros(1, np.int64)
    client, cell = table["client_id"].to_numpy(), table["cell"].to_numpy()
    return np.concatenate([[0], np.flatnonzero((client[1:] != client[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(table)]])


def _last_at(versions: pd.DataFrame, sales: pd.DataFrame) -> np.ndarray:
    """For each sale the place of its (client, cell)'s last version with ``at`` <= the sale's, or -1."""
    if not len(versions) or not len(sales):
        return np.full(len(sales), -1)
    both = {c: np.concatenate([versions[c].to_numpy(), sales[c].to_numpy()]) for c in ("client_id", "cell", "at")}
    is_sale = np.concatenate([np.zeros(len(versions), np.int8), np.ones(len(sales), np.int8)])
    place = np.concatenate([np.arange(len(versions)), np.arange(len(sales))])
    order = np.lexsort([place, is_sale, both["at"], both["cell"], both["client_id"]])
    sale = is_sale[order] == 1
    latest = np.maximum.accumulate(np.where(sale, -1, np.arange(len(order))))
    found = np.where(latest >= 0, place[order[latest]], -1)
    same = latest >= 0
    for c in ("client_id", "cell"):
        same &= both[c][order[latest]] == both[c][order]
    out = np.full(len(sales), -1)
    out[place[order[sale]]] = np.where(same, found, -1)[sale]
    return out


def _known(values: np.ndarray) -> pd.Series:
    return pd.Series(values).mask(values == _NONE).astype("Int64")


def release(versions: pd.DataFrame, waiting: pd.DataFrame, entries: pd.DataFrame, batch: int) -> pd.DataFrame:
    """The result rows of ``waiting``, each with its client's versions as they stand."""
    held = np.zeros(len(waiting), np.int64)
    chosen = {"id": np.full(len(waiting), _NONE), "cents": np.full(len(waiting), _NONE), "op": np.full(len(waiting), None, object)}
    if len(waiting):
        at = _last_at(versions, waiting)
        for c in chosen:
            if len(versions):
                chosen[c] = np.where(at >= 0, versions[c].to_numpy()[at], chosen[c])
        if len(versions):
            counts = versions.groupby(["client_id", "cell"]).size().rename("n_held").reset_index()
            held = waiting[["client_id", "cell"]].merge(counts, how="left").n_held.fillna(0).to_numpy(np.int64)
        if len(entries):
            known = {key: own for key, own in _ordered(entries, "client_id", "cell", "from_cell").groupby(["client_id", "cell"])}
            cells = waiting["cell"].to_numpy()
            for (client, cell), rows in waiting[cells >= 0].groupby(["client_id", "cell"]).groups.items():
                own = known.get((client, cell))
                rows = np.asarray(rows)
                held[rows] = 0 if own is None else own["n"].sum()
                before = None if own is None else own[own["from_cell"] < cell]
                if before is not None and len(before):
                    open_ = rows[(at[rows] < 0) & (waiting["at"].to_numpy()[rows] != _NONE)]
                    for c in chosen:
                        chosen[c][open_] = before[c].iloc[-1]
    return pd.DataFrame({"rec": "sale", "id": _known(waiting["id"].to_numpy()), "batch": batch, "n_held": pd.Series(held, dtype="Int64"), "change_id": _known(chosen["id"]), "balance_cents": _known(chosen["cents"]), "op": chosen["op"]})


def prune(versions: pd.DataFrame, entries: pd.DataFrame, limit: int, done_cells: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of each client's versions at ``limit`` or before only the last; ``versions`` are in order, and the
    cells before ``done_cells`` end at ``limit`` or before."""
    bounds = _groups(versions)
    old = versions["at"].to_numpy() <= limit
    last = np.zeros(len(versions), bool)
    if len(versions):
        count = np.add.reduceat(old, bounds[:-1])
        last[(bounds[:-1] + count - 1)[count > 0]] = True
    keep = ~old | last
    if len(entries):
        entries = _ordered(entries, "client_id", "cell", "from_cell")
        done = entries["from_cell"].to_numpy() < done_cells
        gone = entries[done]
        carried = gone.groupby(["client_id", "cell"]).tail(1).assign(n=1)
        holder = {(c, k): f for c, k, f in zip(carried["client_id"], carried["cell"], carried["from_cell"], strict=True)}
        entries = pd.concat([carried, entries[~done]], ignore_index=True)
        cell = versions["cell"].to_numpy()
        for i in np.flatnonzero(last & (cell >= 0)):
            keep[i] = holder.get((versions["client_id"].iloc[i], cell[i])) == cell[i]
    return versions[keep].reset_index(drop=True), entries


def step(batch: int, rest: int, done_cells: int) -> Callable:
    """The function of one start of the query, for a bucket with rows or whose timer has expired."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() - SHIFT * 1000
        limit = now * 1000 + rest
        new = pd.concat([pd.DataFrame(columns=_COLUMNS), *rows], ignore_index=True) if not state.hasTimedOut else pd.DataFrame(columns=_COLUMNS)
        kind = new["kind"].to_numpy(np.int64)
        late = new["id"].to_numpy(np.int64)[kind == LATE]
        if len(late):
            nothing = pd.array([None] * len(late), dtype="Int64")
            yield pd.DataFrame({"rec": "late", "id": _known(late), "batch": batch, "n_held": nothing, "change_id": nothing, "balance_cents": nothing, "op": None})
        kept = state.get if state.exists else (None,) * len(_KEEP)
        tables = {name: _unpack(data, _KEEP[name]) for name, data in zip(_KEEP, kept, strict=True)}
        for name, wanted in (("versions", CHANGE), ("waiting", SALE), ("entries", SUMMARY)):
            found = new.loc[kind == wanted, _KEEP[name]]
            if len(found):
                found = found.astype({c: np.int64 for c in found.columns if c != "op"})
                tables[name] = pd.concat([tables[name], found], ignore_index=True) if len(tables[name]) else found.reset_index(drop=True)
        versions, waiting, entries = tables.values()
        versions = _ordered(versions, "client_id", "cell")
        at = waiting["at"].to_numpy()
        free = (at < limit) | (at == _NONE) | (kind == FLUSH).any()
        if free.any():
            yield release(versions, waiting[free].reset_index(drop=True), entries, batch)
            waiting = waiting[~free].reset_index(drop=True)
        versions, entries = prune(versions, entries, limit, done_cells)
        if not (len(versions) or len(waiting) or len(entries)):
            if state.exists:
                state.remove()
            return
        state.update(tuple(_pack(t) if len(t) else None for t in (versions, waiting, entries)))
        # the timer: the first moment at which a sale is released or a version pruned
        second = _groups(versions)
        second = (second[:-1] + 1)[np.diff(second) > 1]
        due = [waiting["at"].min()] if len(waiting) else []
        due += [versions["at"].to_numpy()[second].min()] if len(second) else []
        due += [now * 1000] if len(entries) else []
        if due:
            state.setTimeoutTimestamp(max(1, max(int(min(due)) // 1000 - 1, now) + SHIFT * 1000))

    return run


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """No batch without data may move the watermark between two feeds."""
    wanted = {
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.streaming.multipleWatermarkPolicy": "min",
    }
    old = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _batch(day: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def _clocks(table: DataFrame) -> tuple[list[int | None], int]:
    """The largest ``at`` up to each batch (one small row a batch), and the number of rows."""
    found = {r["batch"]: (r["top"], r["n"]) for r in table.groupBy("batch").agg(F.max("at").alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    out: list[int | None] = []
    for k in range(BATCHES):
        seen = [x for x in (out[-1] if out else None, found.get(k, (None, 0))[0]) if x is not None]
        out.append(max(seen) if seen else None)
    return out, sum(n for _, n in found.values())


def _before(clocks: list[int | None]) -> list[int]:
    """A table's watermark in each batch, from the clock of the earlier ones."""
    return [_NONE, *(_NONE if c is None else c - DELAY_HOURS * 3_600_000_000 for c in clocks[:-1])]


def _watermarks(sold: list[int | None], valid: list[int | None]) -> tuple[list[int], list[int]]:
    """H of each batch and of the flush, and what Spark's watermark shows of it, both in microseconds."""
    delay = DELAY_HOURS * 3_600_000_000
    exact, shown = [], []
    for k in range(BATCHES + 1):
        ends = [_NONE if k == 0 or c[k - 1] is None else c[k - 1] for c in (sold, valid)]
        exact.append(min(_NONE if x == _NONE else x - delay for x in ends))
        held = (0 if x == _NONE else max(0, min(x + SHIFT * 10**6, 2 * SHIFT * 10**6)) for x in ends)
        shown.append(max(0, min(x // 1000 * 1000 - delay for x in held)) - SHIFT * 10**6)
    return exact, shown


def _by_batch(values: list[int | None], batch: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), batch + 1)


def _clock(micros: Column) -> Column:
    """A clock as a shifted timestamp; none seen counts as the beginning of time."""
    shifted = F.greatest(F.lit(0), F.least(micros + F.lit(SHIFT * 10**6), F.lit(2 * SHIFT * 10**6)))
    return F.timestamp_micros(F.coalesce(shifted, F.lit(0)))


def _cells(at: Column, limits: list[int]) -> Column:
    """Number of a hot client's cell: which values of H lie before, then the slice of time."""
    passed = sum(((at > F.lit(h)).cast("int") for h in limits[1:BATCHES]), F.lit(0))
    width = DAYS * 86_400_000_000 // SLICES
    piece = F.least(F.lit(SLICES - 1), F.greatest(F.lit(0), F.floor((at - F.lit(FIRST_DAY * 86_400_000_000)) / width)))
    return (passed * SLICES + piece).cast("int")


def _staged(sales: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables as (batch, client_id, id, at, ...); changes as a written table of distinct rows."""
    day = lambda stamp: F.floor(_micros(stamp) / 86_400_000_000)
    sales = sales.select(_batch(day(F.col("arrived_at"))).alias("batch"), F.col("client_id").cast("long"), F.col("sale_id").cast("long").alias("id"), _micros(F.col("sold_at")).alias("at"))
    known = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
    distinct = changes.filter(F.col("valid_at").isNotNull()).select(*known).distinct()
    late = F.pmod(F.crc32(F.col("change_id").cast("string")), F.lit(4))
    cents = F.floor(F.col("balance") * 100 + 0.5).cast("long")
    distinct = distinct.select(_batch(day(F.col("valid_at")) + late).alias("batch"), F.col("client_id").cast("long"), F.col("change_id").cast("long").alias("id"), _micros(F.col("valid_at")).alias("at"), F.col("seq").cast("long"), cents.alias("cents"), "op")
    return sales, materialize(distinct, "changes")


def _hot(tables: list[tuple[DataFrame, int]]) -> DataFrame:
    """Clients with more than 1/HOT of a table's rows: at most 2 HOT of them."""
    found = [t.groupBy("client_id").count().filter((F.col("count") * HOT > n) & F.col("client_id").isNotNull()).select("client_id") for t, n in tables]
    return materialize(found[0].union(found[1]).distinct(), "hot")


def _feed(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` in the feed's columns (and its batch); a number that is not there is _NONE, as nulls would
    reach pandas as floats."""
    taken = {**{c: F.col(c) for c in df.columns}, **values}
    fields = [f.split() for f in _FEED.split(", ")]
    filled = ((n, t, taken.get(n, F.lit(None)).cast(t)) for n, t in fields)
    none = {"long": F.lit(_NONE), "int": F.lit(-1)}
    return df.select("batch", *((F.coalesce(c, none[t]) if t in none else c).alias(n) for n, t, c in filled))


def _feeds(sales: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """What the two streams read, by batch, and what H is beyond Spark's watermark in each."""
    spark = sales.sparkSession
    sales, changes = _staged(sales, changes)
    (sold, n_sales), (valid, n_changes) = _clocks(sales), _clocks(changes)
    own = _before(valid)
    limits, shown = _watermarks(sold, valid)
    buckets = max(2 * partitions(spark), -(-(n_sales + n_changes) // BUCKET_ROWS))
    hot = _hot([(sales, n_sales), (changes, n_changes)]).withColumn("is_hot", F.lit(True))
    deal = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    some = F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int")  # a sale without a time may wait anywhere
    cell = F.when(F.col("is_hot"), F.coalesce(_cells(F.col("at"), limits), some)).otherwise(-1)
    lone = F.col("client_id").isNull()
    sales = sales.join(F.broadcast(hot), "client_id", "left").withColumn("cell", cell)
    sales = _feed(sales, kind=F.lit(SALE), bucket=F.when(lone, deal("id")).otherwise(deal("client_id", "cell")))
    late = F.col("at") < _by_batch(own, F.col("batch"))
    changes = changes.join(F.broadcast(hot), "client_id", "left").withColumn("cell", cell).withColumn("late", late)
    rows = _feed(changes.filter(F.col("late") | ~lone), kind=F.when(F.col("late"), LATE).otherwise(CHANGE), bucket=F.when(F.col("late"), deal("id")).otherwise(deal("client_id", "cell")))
    order = F.struct(*(F.col(c) for c in _ORDER))
    told = changes.filter("is_hot AND NOT late").groupBy("batch", "client_id", F.col("cell").alias("from_cell")).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
    used = sales.filter("cell >= 0").select("client_id", "cell").union(rows.filter(f"cell >= 0 AND kind = {CHANGE}").select("client_id", "cell")).distinct()
    told = told.join(F.broadcast(used), "client_id").select("batch", "client_id", "cell", "from_cell", "n", "last.*")
    rows = rows.union(_feed(told, kind=F.lit(SUMMARY), bucket=deal("client_id", "cell")))
    ticks = spark.range(BATCHES).select(F.col("id").cast("int").alias("batch"))
    tick = _feed(ticks, kind=F.lit(TICK), bucket=F.lit(0))
    near = [k for k in range(1, BATCHES) if limits[k] != limits[k - 1] and shown[k] == shown[k - 1]]
    if near:  # H moves by less than a timer can tell: every bucket is woken
        woken = spark.range(buckets).select(F.explode(F.array(*map(F.lit, near))).alias("batch"), F.col("id").alias("bucket"))
        tick = tick.union(_feed(woken, kind=F.lit(TICK)))
    flush = _feed(spark.range(buckets).select(F.lit(BATCHES).alias("batch"), F.col("id").alias("bucket")), kind=F.lit(FLUSH))
    clocked = lambda df, clocks: df.withColumn("clock", _clock(_by_batch([*clocks, clocks[-1]], F.col("batch"))))
    return clocked(sales.union(tick).union(flush), sold), clocked(rows.union(tick).union(flush.limit(1)), valid), [a - b for a, b in zip(limits, shown, strict=True)]


def enrich(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """rec (``sale`` or ``late``), id, batch, n_held, change_id, balance_cents, op."""
    spark = sales.sparkSession
    root = new_path(spark, "valid-time")
    left, right, rest = _feeds(sales, changes)
    for name, feed in (("sales", left), ("changes", right)):
        feed.write.partitionBy("batch").parquet(f"{root}/staged/{name}")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with _settings(spark):
        for batch in range(BATCHES + 1):
            streams = []
            for name in ("sales", "changes"):
                fs.mkdirs(fs_path(f"{root}/feed/{name}"))
                fs.rename(fs_path(f"{root}/staged/{name}/batch={batch}"), fs_path(f"{root}/feed/{name}/{batch}"))
                stream = spark.readStream.schema(_FEED).option("recursiveFileLookup", "true").parquet(f"{root}/feed/{name}")
                streams.append(stream.withWatermark("clock", f"{DELAY_HOURS} hours"))
            rows = streams[0].union(streams[1]).groupBy("bucket")
            found = rows.applyInPandasWithState(step(batch, rest[batch], batch * SLICES), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
            query = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{root}/out")
