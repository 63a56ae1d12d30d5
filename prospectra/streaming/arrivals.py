"""Structured Streaming over arriving rows: windowed sums with a watermark, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, d: str, table: str = "events", stream: bool = True, files: int = 1) -> DataFrame:
    """The event table, as a stream of its files or as a whole; ts is a timestamp."""
    path = f"{d}/{table}.parquet"
    fixed = spark.read.parquet(path)
    if stream:
        folder, name = path.rsplit("/", 1)
        fixed = spark.readStream.schema(fixed.schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    return fixed.withColumn("ts", F.col("ts").cast("timestamp"))


def timely(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Sets the watermark of a stream, once for all that follows; whole tables stay as they are."""
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their sum by window and type, of timely() events; state older than the watermark is dropped."""
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once, within the watermark of timely() events."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def drain(out: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived and ends; run again with the same checkpoint, it goes on where it was. Needs file sinks' append mode."""
    out.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
