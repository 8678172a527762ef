"""Chunk files that arrive in a folder, upserted batch by batch.

A batch replaces the points of the files it holds, and identifiers follow from source, file and
number, so a source may come in many files.  The batch's number is part of the collection's commit: a batch that
is run again after its commit does nothing, one that failed before it left nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillmark.functions.text import point_id
from rillmark.operators.enrich import enrich, number_chunks
from rillmark.sources.readers import CHUNK
from rillmark.sources.store import Collection


def ingest_stream(spark: SparkSession, folder: str, collection: Collection, embed: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that enriches, embeds and upserts new JSONL files of ``folder``."""
    rows = spark.readStream.format("text").load(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def upsert(batch: DataFrame, number: int) -> None:
        parsed = batch.filter(F.trim("value") != "").withColumn("line_no", F.monotonically_increasing_id()).withColumn("j", F.from_json("value", CHUNK))
        chunks = parsed.select("line_no", "file", F.col("j.text").alias("text"), "j.metadata.*")
        own = enrich(number_chunks(chunks, doc_col=["doc_id", "file"]))
        name = point_id(F.concat("source", F.lit(":"), F.element_at(F.split("file", "/"), -1)), F.col("chunk_id"))
        collection.upsert(embed(own.withColumn("id", name)), replace=["source", "file"], stream=(checkpoint, number))

    writer = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
