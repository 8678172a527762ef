"""A vector index of k-means cells: approximate search by the nearest cells, exact search by bounds.

Cells are fitted on a bounded sample (SAMPLE_ROWS rows of least hash) and then take in every point; each cell
keeps its radius, the largest distance of a point from its centre.  Points are stored sorted by cell,
so a search reads the row groups of the cells it asks.

Approximate search asks ``probes`` cells for each query; ``probes_for`` finds how many reach a recall.  Exact search asks them first and then every
cell in which, by the triangle inequality, a point may score as high as the query's k-th so far; what
other cells hold cannot be among the results.  ``recall`` measures the one against the other.

A point without a vector, or with zeros only, is in no cell, as in ``operators.search.dense_topk``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators.search import DIGITS, QUERY_BLOCK, VECTOR_BLOCK, Best, top_per_query

SAMPLE_ROWS, ROUNDS, MOST_CELLS = 20_000, 12, 4096
#: Queries that ``probes_for`` measures.
TUNED = 200
#: Queries whose vectors all tasks hold at once; more take a pass each.
MOST_QUERIES = 20_000


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which have a direction."""
    norms = np.linalg.norm(vectors, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return np.where(good[:, None], vectors / np.where(good, norms, 1)[:, None], 0), good


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = np.maximum(0, (vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1))
    cell = squares.argmin(1)
    return cell, np.sqrt(squares[np.arange(len(cell)), cell])


def fit_centres(points: DataFrame, n_cells: int, id_col: str = "id") -> np.ndarray:
    """Centres of at most ``n_cells`` cells, from SAMPLE_ROWS points."""
    sample = points.filter("vector is not null").orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(SAMPLE_ROWS)
    rows = [r["vector"] for r in sample.select("vector").collect()]
    vectors, good = _unit(np.array(rows, np.float64).reshape(len(rows), -1)) if rows else (np.zeros((0, 1)), np.zeros(0, bool))
    vectors = vectors[good]
    n = min(n_cells, MOST_CELLS, len(vectors))
    if not n:
        return vectors
    rng = np.random.default_rng(17)
    centres = vectors[rng.choice(len(vectors), n, replace=False)]
    for _ in range(ROUNDS):
        cell, far = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        counts = np.bincount(cell, minlength=n)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = vectors[np.argsort(-far)[: len(empty)]]  # an empty cell moves to a far point
    return centres


@dataclass
class CellIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    radii: np.ndarray

    @classmethod
    def build(cls, points: DataFrame, path: str, n_cells: int | None = None) -> CellIndex:
        """Write the cells of points (id, vector); by default as many cells as the root of the points."""
        spark = points.sparkSession
        n = n_cells or max(1, round(points.count() ** 0.5))
        centres = fit_centres(points, n)
        shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS vectors at most
        kind = points.schema["id"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, good = _unit(_matrix(batch.column(1)))
                own = batch.filter(pa.array(good))
                if own.num_rows:
                    cell, far = _nearest(vectors[good], shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), own.column(0), pa.array(vectors[good].tolist(), pa.list_(pa.float64()))], names=["cell", "far", "id", "vector"])

        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), kind, T.StructField("vector", T.ArrayType(T.DoubleType()))])
        dealt = points.filter("vector is not null").select("id", "vector").mapInArrow(assign, schema)
        # sorted by cell; a cell that is larger than a partition is cut by the identifier's hash
        dealt.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id").write.parquet(f"{path}/points")
        radii = np.zeros(len(centres))
        for r in spark.read.parquet(f"{path}/points").groupBy("cell").agg(F.max("far").alias("far")).collect():
            radii[r["cell"]] = r["far"]
        spark.createDataFrame([(json.dumps({"centres": centres.tolist(), "radii": radii.tolist()}),)], "value string").coalesce(1).write.text(f"{path}/cells")
        return cls(spark, path, centres, radii)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        known = json.loads(spark.read.text(f"{path}/cells").first()[0])
        return cls(spark, path, np.array(known["centres"]), np.array(known["radii"]))

    def _far(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of unit vectors from the centres."""
        return np.sqrt(np.maximum(0, 1 + (self.centres**2).sum(1) - 2 * vectors @ self.centres.T))

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95) -> int:
        """The least number of cells that holds the share ``target`` of the exact results of TUNED queries of
        least hash: how near their cells are decides how many must be asked."""
        own = queries.filter("query_vec is not null").orderBy(F.xxhash64(F.col("query_id").cast("string")), "query_id").limit(TUNED)
        rows = own.collect()
        if not rows or not len(self.centres):
            return 1
        vectors, _ = _unit(np.array([r["query_vec"] for r in rows], np.float64).reshape(len(rows), -1))
        order = self._far(vectors).argsort(axis=1).argsort(axis=1)
        place = {r["query_id"]: i for i, r in enumerate(rows)}
        points = self.spark.read.parquet(f"{self.path}/points").select("id", "cell")
        found = self.topk(self.spark.createDataFrame(rows, own.schema), k, exact=True).join(points, "id").select("query_id", "cell").collect()  # k rows a query
        ranks = sorted(int(order[place[r["query_id"]], r["cell"]]) for r in found)
        return ranks[min(len(ranks), -(-int(target * 1000) * len(ranks) // 1000)) - 1] + 1 if ranks else 1

    def topk(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, threshold: float | None = None) -> DataFrame:
        """(query_id, id, score, pos) of queries (query_id, query_vec): the k points of highest cosine
        in the ``probes`` nearest cells, or with ``exact`` among all points."""
        asked = queries.select("query_id", "query_vec").filter("query_vec is not null")
        parts = max(1, -(-asked.count() // MOST_QUERIES))
        out = None
        for part in range(parts):
            own = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
            found = self._part(own.collect(), queries.schema["query_id"], k, probes, exact, threshold)
            out = found if out is None else out.unionByName(found)
        return out

    def _part(self, rows: list, key: T.StructField, k: int, probes: int, exact: bool, threshold: float | None) -> DataFrame:
        names = self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("q", T.IntegerType()), key]))
        vectors, good = _unit(np.array([r["query_vec"] for r in rows], np.float64).reshape(len(rows), -1)) if rows else (np.zeros((0, 1)), np.zeros(0, bool))
        n = len(self.centres)
        if not n or not len(vectors):
            return self._named(self._scan(np.zeros((0, 1)), np.zeros((0, n), bool), k, None), names, k)
        far = self._far(vectors)
        wanted = np.zeros((len(vectors), n), bool)
        order = np.argsort(far, axis=1)[:, : min(probes, n)]
        np.put_along_axis(wanted, order, True, axis=1)
        if exact:
            wanted[~good] = True  # a query without direction scores 0 everywhere
            # the k-th score so far, one small row a query
            first = top_per_query(self._scan(vectors, wanted, k, threshold), k, [F.col("score").desc(), F.col("id")], "q")
            least = np.full(len(vectors), -2.0 if threshold is None else threshold)
            for r in first.filter(F.col("pos") == k).select("q", "score").collect():
                least[r["q"]] = max(least[r["q"]], r["score"])
            nearest = np.maximum(0, far - self.radii - 1e-9)
            wanted |= 1 - nearest**2 / 2 >= (least - 2 * 10.0**-DIGITS)[:, None]
        return self._named(self._scan(vectors, wanted, k, threshold), names, k)

    def _named(self, local: DataFrame, names: DataFrame, k: int) -> DataFrame:
        best = top_per_query(local, k, [F.col("score").desc(), F.col("id")], "q")
        return best.join(F.broadcast(names), "q").select("query_id", "id", "score", "pos")

    def _scan(self, vectors: np.ndarray, wanted: np.ndarray, k: int, threshold: float | None) -> DataFrame:
        """(q, id, score): each task's best k of each query, from the cells that the query wants."""
        points = self.spark.read.parquet(f"{self.path}/points")
        used = np.flatnonzero(wanted.any(0)).tolist()
        points = points.filter(F.col("cell").isin(used)) if used else points.limit(0)
        shared = self.spark.sparkContext.broadcast((vectors, wanted))
        floor = -2.0 if threshold is None else threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_queries, asked = shared.value
            held = Best(len(all_queries), k, floor)
            for batch in (whole.slice(i, VECTOR_BLOCK) for whole in batches for i in range(0, whole.num_rows, VECTOR_BLOCK)):
                cells = batch.column(0).to_numpy()
                own, ids = _matrix(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    mine, who = cells == cell, np.flatnonzero(asked[:, cell])
                    for begin in range(0, len(who), QUERY_BLOCK):
                        some = who[begin : begin + QUERY_BLOCK]
                        held.add(some, ids[mine], np.round(all_queries[some] @ own[mine].T, DIGITS) + 0.0)
            yield from held.batches()

        schema = T.StructType([T.StructField("q", T.IntegerType()), points.schema["id"], T.StructField("score", T.DoubleType())])
        return points.select("cell", "id", "vector").mapInArrow(run, schema)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, k, hits): how many of each query's exact results were found."""
    good = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(good, ["query_id", "id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("hits"))
