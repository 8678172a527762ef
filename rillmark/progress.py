"""Progress of a running job, measured where rows pass and shown at the driver.

Rows are counted as they go through a step; a task reports its count to the driver when it ends, under its
partition's number, so a task that is run again replaces its report and is not counted twice.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, SparkSession

from rillmark.operators.evaluation import throughput


class _Latest(AccumulatorParam):
    """Counts by partition; of two reports of one partition the larger one holds."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for part, n in b.items():
            a[part] = max(n, a.get(part, 0))
        return a


class Progress:
    """``with Progress(spark, total) as p: p.counted(df).write...``: a line every ``every`` seconds, and one at the end."""

    def __init__(self, spark: SparkSession, total: int | None = None, every: float = 10.0, show: Callable[[str], None] = print, clock: Callable[[], float] = time.monotonic):
        self.total, self.every, self.show, self.clock = total, every, show, clock
        self._counts = spark.sparkContext.accumulator({}, _Latest())
        self._done = threading.Event()

    def counted(self, df: DataFrame) -> DataFrame:
        """``df``, whose rows are counted as they pass."""
        counts = self._counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for batch in batches:
                yield batch
                n += batch.num_rows
            counts.add({TaskContext.get().partitionId(): n})

        return df.mapInArrow(run, df.schema)

    def rows(self) -> int:
        """Rows of the tasks that have ended."""
        return sum(self._counts.value.values())

    def line(self) -> str:
        return throughput(self.rows(), self.total, self.clock() - self._begin)

    def _run(self) -> None:
        while not self._done.wait(self.every):
            self.show(self.line())

    def __enter__(self) -> Progress:
        self._begin = self.clock()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._done.set()
        self._thread.join()
        self.show(self.line())
