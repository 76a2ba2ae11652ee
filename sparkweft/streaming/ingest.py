"""Indexing files as they arrive: a file stream whose batches run the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkweft.operators import chunking, scan

LINES = "path string, text string"


def chunk_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Chunks of the text files that appear in a folder, appended to parquet. Each file is read once, also over restarts:
    what was done is kept in ``checkpoint``, and a batch that is run again overwrites its own folder."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("changed_at"))

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.where(~scan.is_excluded(F.element_at(F.split("path", "/"), -1)))
        latest = kept.groupBy("path").agg(F.max_by("text", "changed_at").alias("text"))
        hashed = latest.withColumn("content_hash", F.sha2(F.encode("text", "UTF-8"), 256))
        chunks = chunking.chunk_documents(hashed, "path").join(hashed.select("path", "content_hash"), "path")
        chunks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window with a watermark, over a stream or a table with ``ts`` and ``event_type``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
