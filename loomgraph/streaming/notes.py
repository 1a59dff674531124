"""Incremental ingestion as a stream: each micro-batch of files goes through the batch merge, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash

FILES = "path string, content string, content_hash string"


def merge_batch(target: str):
    """A ``foreachBatch`` function: newest content of each path, a version of the table for each batch, written once."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("path", "content").dropDuplicates(["path"]).withColumn("content_hash", content_hash(F.col("content")))
        old = None
        if number > 0:
            old = spark.read.schema(FILES).parquet(f"{target}/v{number - 1}")
        merged = new if old is None else old.join(new.select("path"), "path", "left_anti").unionByName(new)
        merged.select("path", "content", "content_hash").write.mode("overwrite").parquet(f"{target}/v{number}")

    return run


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Follows a folder of Parquet files (path, content); a restart goes on from the checkpoint."""
    rows = spark.readStream.schema("path string, content string").parquet(source)
    return rows.writeStream.foreachBatch(merge_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums by window and type with a watermark; works on streams and tables."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
