"""What workers and tables of the pipeline hold in memory: finding 1 of round 3."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rillmark.llm import shared


def test_a_worker_drops_what_tasks_of_another_kind_kept():
    made = []

    def asks(batches):
        for batch in batches:
            made.append(shared.kept(("test", 1), lambda: object()))
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    for _ in range(2):
        assert list(shared.lean(asks)([batch])) == [batch]
    assert made[0] is made[1]
    list(shared.lean(lambda batches: batches)([batch]))
    assert ("test", 1) not in shared._kept


def test_tables_of_large_rows_are_in_small_row_groups(spark):
    noise = "array_join(transform(sequence(1, 8192), i -> sha2(concat(id, ' ', i), 512)), '')"
    back = shared.in_groups(spark.range(0, 40, 1, 1).select("id", F.unhex(F.expr(noise)).alias("x")), "large-rows")
    [file] = back.inputFiles()
    found = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
    assert back.count() == 40
    assert max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) < 12 << 20
