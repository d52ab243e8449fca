"""Background ingest as a file-source stream: each micro-batch is chunked and appended."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import chunk


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads new parquet files of (file_id, filename, text) under ``source`` and writes their chunks.

    Runs over what is there (availableNow); each batch writes to a folder of its own number, so a batch
    that is repeated after a failure replaces its first attempt.
    """
    files = spark.readStream.schema("file_id long, filename string, text string").parquet(source)

    def write(batch, number: int) -> None:
        chunk.by_blocks(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
