"""Structured Streaming over trace events: windowed counts with late data, sessions, and an append-only trace sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet event files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value per type and window; events later than the watermark are dropped, as is the state of closed windows."""
    marked = events.withWatermark("at", late) if events.isStreaming else events
    return marked.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: events no more than ``gap`` apart."""
    marked = events.withWatermark("at", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def append_traces(df: DataFrame, path: str, checkpoint: str):
    """Write a stream as JSON lines, one folder per batch number, so a batch that is written again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
