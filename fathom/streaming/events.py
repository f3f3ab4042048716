"""The event log as a stream: appended as it comes, and counted in windows with late rows allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Event files of a folder as they come; ``ts`` is read as UTC."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, start, n, total: tumbling windows; rows later than the watermark are dropped by the stream."""
    w = F.window("ts", window)
    counts = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counts.select("event_type", F.col("window.start").alias("start"), "n", "total")


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every event once into a Parquet log; ends when what is there has been taken."""
    unique = events.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["event_id"])
    return unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
