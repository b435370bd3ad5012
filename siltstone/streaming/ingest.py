"""Ingestion of a folder as a stream: every new file once, a generation for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.store import VectorStore
from siltstone.plans.ingest import Config, ingest_files


def ingest_stream(spark: SparkSession, folder: str, store_path: str, checkpoint: str, config: Config | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Start an availableNow stream over `folder`. A batch that is run again stores the same ids again, so the store ends in the same state."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")

    def batch(df: DataFrame, number: int) -> None:
        # a batch has files_per_batch paths at most, so one task can number them, and they can be broadcast
        order = df.select("path").distinct().withColumn("seq", F.lit(number).cast("long") * (1 << 20) + F.row_number().over(Window.orderBy("path")))
        ingest_files(df.join(F.broadcast(order), "path"), VectorStore(df.sparkSession, store_path), config)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
