"""Tables written to the folder that the driver and every executor share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: the files outlive a lost
executor and need no second computation.  Only where that setting is missing (unit tests on one
machine) a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of keys (some 40 bytes each) that may be broadcast.
SMALL_ROWS = 500_000

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", _BATCH: str(4 << 20)}
#: A task has a row group and a page in memory when it writes or reads; by Parquet's own settings sizes
#: are first looked at after 100 rows.
_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_fallback: str | None = None
_written: list[tuple[SparkSession, str]] = []
_kept: dict[tuple, object] = {}
_used: set[tuple] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, from the session; a temporary one only where none is set."""
    global _fallback
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if _fallback is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _fallback = "file://" + tempfile.mkdtemp(prefix="rillmark-")
    return _fallback


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind, and give Python workers batches of a
    bounded size, as rows may be whole blocks or very long texts."""
    old = {key: spark.conf.get(key, None) for key in _TIDY}
    for key, value in _TIDY.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _give_back() -> None:
    """Return to the system what Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a process; a worker drops it after a task that has not asked for it."""
    if key not in _kept:
        _kept[key] = make()
    _used.add(key)
    return _kept[key]


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; a worker, which serves many tasks, gives memory back after each, and
    what tasks of another kind have kept.

    A session that sets no size for batches is given one: texts may be long, and a batch is in memory
    several times, in the executor and in its worker."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(_BATCH, None) is None:
        session.conf.set(_BATCH, str(4 << 20))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _used.clear()
        try:
            yield from run(batches)
        finally:
            for key in _kept.keys() - _used:
                del _kept[key]
            _give_back()

    return wrapped


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with tidy(spark):
        df.write.options(**(options or {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._rillmark_path = path
    return back


def in_groups(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` in small row groups, for tables whose rows may be whole blocks or sets."""
    return materialize(df, name, _GROUPS)


def settle(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of ``build``, materialized; the tables made on the way go at once."""
    begin = len(_written)
    out = materialize(build(), name)
    made = [x for x in _written[begin:] if x[1] != out._rillmark_path]
    del _written[begin:]
    _written.append((out.sparkSession, out._rillmark_path))
    for spark, path in made:
        remove(spark, path)
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    remove(df.sparkSession, df._rillmark_path)


def small(keys: DataFrame, of: DataFrame) -> DataFrame:
    """``keys``, drawn from the materialized table ``of``, to be broadcast if that has SMALL_ROWS rows
    at most and the keys are numbers or digests; else left to Spark."""
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BinaryType)) for f in keys.schema)
    return F.broadcast(keys) if fixed and of.count() <= SMALL_ROWS else keys


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM may already be gone when the interpreter ends
            return


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not use, made of the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: list[str], *results: str) -> list[str]:
    """``columns`` but those whose names the results take."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


atexit.register(_remove_all)


def partitions(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: the session's setting, as for Spark's own."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
