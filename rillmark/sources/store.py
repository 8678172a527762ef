"""A collection of points as Parquet: upsert by identifier, delete by source, checks, scroll."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.text import index_tokens
from rillmark.operators import search
from rillmark.sources import postings

_PLACE = ("segment", "number")  # a point's place in the index
_HASH = "source_hash"
#: Identifiers that are broadcast, when points are replaced.
SMALL_KEYS = 500_000


def merge_points(old: DataFrame, new: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Points of both; a new one replaces the old one of its identifier, of several new ones the
    one that is last in ``order`` wins."""
    rank = [F.col(c).desc() for c in (order or ["doc_id", "chunk_id"])]
    latest = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*rank))).filter("__n = 1").drop("__n")
    return old.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def _small(keys: DataFrame) -> tuple[DataFrame, int]:
    """Keys, to be broadcast if they are few, and how many there are."""
    n = keys.count()
    return (F.broadcast(keys) if n <= SMALL_KEYS else keys), n


def latest_points(points: DataFrame) -> DataFrame:
    """``points`` with one row an identifier, as ``merge_points`` chooses; only rows of repeated identifiers are moved."""
    keys, n = _small(points.groupBy("id").count().filter("count > 1").select(F.col("id").alias("__id")))
    if not n:
        return points
    same = F.col("id").eqNullSafe(F.col("__id"))
    several = points.join(keys, same, "left_semi")
    return points.join(keys, same, "left_anti").unionByName(merge_points(several.limit(0), several))


def replace_points(old: DataFrame, latest: DataFrame) -> DataFrame:
    """Points of both; a point of ``latest`` replaces the old one of its identifier, and no other row is moved."""
    keys, n = _small(old.select("id").join(latest.select("id"), "id", "left_semi").distinct())
    return (old.join(keys, "id", "left_anti") if n else old).unionByName(latest, allowMissingColumns=True)


def delete_sources(points: DataFrame, incoming: DataFrame, source: str = "source") -> DataFrame:
    """Points of sources that are not among the incoming ones."""
    return points.join(incoming.select(source).distinct(), source, "left_anti")


def scroll(points: DataFrame, wanted: DataFrame, per_doc: int) -> DataFrame:
    """The first points by identifier of each wanted (query_id, doc_id)."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("id")
    return wanted.join(points, "doc_id").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_doc).drop("__n")


def verify(points: DataFrame, vector: str = "vector", content: str = "content") -> DataFrame:
    """One row of data-quality counts over all points."""
    return points.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.col(vector).isNull()).alias("no_vector"),
        F.count_distinct(F.size(vector)).alias("n_dimensions"),
        F.max(F.size(vector)).alias("dimension"),
        F.count_if(F.coalesce(F.trim(content), F.lit("")) == "").alias("no_content"),
        F.count_distinct("id").alias("n_ids"),
    )


class Collection:
    """Points below a path, dealt to buckets by their source, under a log of numbered commits.

    A commit names each bucket's files.  A write makes new files for the buckets it touches, and commits last:
    readers of the state before are not disturbed, a failed write leaves it alone, and other buckets are
    not read or written again.  A commit's number can be taken once; a writer that finds its number taken
    merges again, onto the state that the other one left.  An identifier belongs to one source, as
    identifiers are made of sources.

    A bucket holds the sources whose hash ends in its bits.  One that a write leaves with more than
    ``bucket_rows`` points of several sources is split by further bits, so what a write reads and writes is
    bounded by the sources it touches and ``bucket_rows``, however large the collection is.

    Beside a bucket's points stands its inverted index (``rillmark.sources.postings``), made by the same write."""

    MOST_DEPTH = 24

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, metric: str = "cosine", bucket_rows: int = 200_000):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows
        meta = self._meta()
        if meta and dimension is not None and meta["dimension"] not in (None, dimension):
            raise ValueError(f"collection has vectors of {meta['dimension']}, not {dimension} elements")
        self.dimension, self.metric = dimension or (meta or {}).get("dimension"), metric

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _commits(self) -> list[str]:
        """Names of the commits, in order."""
        fs, path = self._file("commits")
        return sorted(n for x in fs.listStatus(path) if (n := x.getPath().getName()).endswith(".json") and not n.startswith(".")) if fs.exists(path) else []

    def _meta(self) -> dict | None:
        names = self._commits()
        return json.loads(self.spark.read.text(f"{self.path}/commits/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _commit(self, meta: dict) -> bool:
        """Take the commit's number, if no one else has; the file appears whole."""
        fs, draft = self._file(f"commits/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        sc = self.spark.sparkContext
        options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        target = self._file(f"commits/{meta['number']:012d}.json")[1]
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, options)  # fails where the target exists
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def _read(self, meta: dict, buckets: list[str], what: str = "buckets", kind: str = "schema") -> DataFrame:
        schema = T.StructType.fromJson(meta[kind])
        paths = [f"{self.path}/{meta[what][b]}" for b in buckets if meta[what].get(b)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def index(self) -> DataFrame | None:
        """Posting lists of all points; None where a collection is empty."""
        meta = self._meta()
        return self._read(meta, list(meta["index"]), "index", "index_schema") if meta else None

    def text_match(self, queries: DataFrame, k: int, query_col: str = "query") -> DataFrame:
        """``operators.search.text_match`` over the stored lists: (query_id, id, pos)."""
        lists, points = self.index(), self.read(places=True)
        if lists is None:
            raise ValueError("the collection is empty")
        found = postings.match(lists, queries, query_col).join(points.select("id", "source", *_PLACE), [*_PLACE])
        return search.top_per_query(search.passing(found.select("query_id", "id"), points, queries), k, [F.col("id")])

    def read(self, places: bool = False) -> DataFrame | None:
        """All points; with ``places`` also where the index has them."""
        meta = self._meta()
        if not meta:
            return None
        points = self._read(meta, list(meta["buckets"]))
        return points if places else points.drop(*_PLACE)

    def _stage(self, points: DataFrame) -> tuple[DataFrame, str]:
        """The points with index tokens and their source's hash, written once, so that no vector is made again."""
        name = f"staging-{uuid.uuid4().hex}"
        points.drop("tokens", *_PLACE).withColumns({"tokens": index_tokens(F.col("content")), _HASH: F.xxhash64("source")}).write.parquet(f"{self.path}/{name}")
        staged = self.spark.read.parquet(f"{self.path}/{name}")
        low, high = staged.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first() if "vector" in staged.columns else (None, None)
        sizes = {n for n in (low, high, self.dimension) if n is not None and n >= 0}
        if len(sizes) > 1:
            self._remove(name)
            raise ValueError(f"a vector has another dimension than the collection: {sorted(sizes)}")
        self.dimension = next(iter(sizes), None)
        return staged, name

    def _remove(self, name: str) -> None:
        fs, path = self._file(name)
        fs.delete(path, True)

    def _dirs(self, version: str) -> dict[str, str]:
        fs, path = self._file(version)
        names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()]
        return {n.split("=")[1]: f"{version}/{n}" for n in names if n.startswith("source_bucket=")}

    def _dealt(self, points: DataFrame, buckets: list[str]) -> DataFrame:
        """Points (with their source's hash) and their bucket, the deepest whose bits their hash ends in."""
        out = points.withColumn("source_bucket", F.lit(None).cast("string"))
        by_depth: dict[int, list[int]] = {}
        for b in buckets:
            depth, bits = map(int, b.split("-"))
            by_depth.setdefault(depth, []).append(bits)
        for depth, bits in sorted(by_depth.items(), reverse=True):  # one small table a depth, at most MOST_DEPTH of them
            known = self.spark.createDataFrame([(x, f"{depth}-{x}") for x in bits], "__bits long, __bucket string")
            out = out.withColumn("__bits", F.col(_HASH).bitwiseAND(F.lit((1 << depth) - 1))).join(F.broadcast(known), "__bits", "left").withColumn("source_bucket", F.coalesce("source_bucket", "__bucket")).drop("__bits", "__bucket")
        return out

    def _split(self, dealt: DataFrame, touched: list[str]) -> list[str]:
        """The buckets to write instead of the touched ones: those too large are parted by further bits,
        and all parts are named, with or without points, so that buckets go on to tile all hashes."""
        counts = dealt.groupBy("source_bucket").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(_HASH).alias("sources")).collect()  # a row a touched bucket
        sizes = {r["source_bucket"]: (r["n"], r["sources"]) for r in counts}
        out = []
        for bucket in touched:
            (depth, bits), (n, sources), more = map(int, bucket.split("-")), sizes.get(bucket, (0, 0)), 0
            while sources > 1 and n > self.bucket_rows << more and depth + more < self.MOST_DEPTH:
                more += 1
            out += [f"{depth + more}-{bits + (i << depth)}" for i in range(1 << more)]
        return out

    def _save(self, points: DataFrame, touched: list[str], meta: dict | None, stream: tuple[str, int] | None) -> bool:
        """Write points (with their source's hash) in place of the touched buckets, and commit; False if
        another writer took the number."""
        segment = uuid.uuid4().hex
        points = points.drop(*_PLACE)
        targets = self._split(self._dealt(points, touched), touched)
        dealt = self._dealt(points, targets).drop(_HASH)  # rows stay in the tasks that read them
        dealt = dealt.withColumns({"segment": F.lit(segment), "number": F.monotonically_increasing_id()})
        dealt.write.partitionBy("source_bucket").parquet(f"{self.path}/points-{segment}")
        written = self.spark.read.schema(dealt.schema).parquet(f"{self.path}/points-{segment}")
        lists = postings.build(written, ["source_bucket"])
        lists.sortWithinPartitions("source_bucket", "token", "block").write.partitionBy("source_bucket").parquet(f"{self.path}/index-{segment}")
        made, lists_of = self._dirs(f"points-{segment}"), self._dirs(f"index-{segment}")
        kept = {what: {b: w for b, w in (meta or {}).get(what, {}).items() if b not in touched} for what in ("buckets", "index")}
        streams = dict((meta or {}).get("streams", {}))
        if stream is not None:
            streams[stream[0]] = stream[1]
        new = {
            "number": (meta or {"number": -1})["number"] + 1, "dimension": self.dimension, "metric": self.metric, "streams": streams,
            "schema": dealt.drop("source_bucket").schema.jsonValue(), "index_schema": lists.drop("source_bucket").schema.jsonValue(),
            "buckets": kept["buckets"] | dict.fromkeys(targets, "") | made, "index": kept["index"] | lists_of,
        }
        if self._commit(new):
            return True
        for name in (f"points-{segment}", f"index-{segment}"):
            self._remove(name)
        return False

    def write(self, points: DataFrame) -> None:
        """Make ``points`` the whole collection."""
        staged, name = self._stage(points)
        done = False
        while not done:
            meta = self._meta()
            done = self._save(staged, list(meta["buckets"]) if meta else ["0-0"], meta, None)
        self._remove(name)

    def upsert(self, points: DataFrame, overwrite: bool = True, replace: list[str] | None = None, stream: tuple[str, int] | None = None) -> int:
        """Add points; with ``overwrite`` all older points that share ``replace`` (the source) with a
        new one go first.  Only the buckets of the points' sources are read and written.

        ``stream`` names a stream and the number of its batch: a batch that was committed before does
        nothing, so a batch that is run again after a failure is there once."""
        if stream is not None and (self._meta() or {}).get("streams", {}).get(stream[0], -1) >= stream[1]:
            return 0
        staged, name = self._stage(points)
        n = staged.count()
        done = False
        while not done:
            meta = self._meta()
            if meta is None:
                done = self._save(latest_points(staged), ["0-0"], None, stream)
                continue
            if stream is not None and meta.get("streams", {}).get(stream[0], -1) >= stream[1]:
                n, done = 0, True
                continue
            touched = [r[0] for r in self._dealt(staged, list(meta["buckets"])).select("source_bucket").distinct().collect()]  # a row a touched bucket
            old = self._read(meta, touched).drop(*_PLACE).withColumn(_HASH, F.xxhash64("source"))
            if overwrite:
                by = replace or ["source"]
                for c in by:
                    old = old if c in old.columns else old.withColumn(c, F.lit(None).cast(staged.schema[c].dataType))
                old = old.join(_small(staged.select(*by).distinct())[0], by, "left_anti")
            done = self._save(replace_points(_like(old, staged), latest_points(_like(staged, old))), touched, meta, stream)
        self._remove(name)
        return n

    def vacuum(self) -> int:
        """Remove files that the last commit doesn't name: earlier states, and what failed writes left.
        Not while another writer is at work."""
        meta = self._meta() or {"buckets": {}}
        used = {where.split("/")[0] for what in ("buckets", "index") for where in meta.get(what, {}).values()} | {"commits"}
        fs, path = self._file("")
        gone = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory() and x.getPath().getName() not in used] if fs.exists(path) else []
        for name in gone:
            self._remove(name)
        for name in self._commits()[:-1]:
            self._remove(f"commits/{name}")
        return len(gone)


def _like(points: DataFrame, other: DataFrame) -> DataFrame:
    """``points`` with the columns that only ``other`` has, as nulls."""
    return points.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in other.columns if c not in points.columns})
