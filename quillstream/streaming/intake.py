"""Streams: intake of files, and windows over events with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.sources.files import documents, read_files


def intake(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Take in the files that lie below ``path`` and haven't been taken in; a file that comes again within a day
    of processing is one document; one that comes later is told by its hash, which ``exact_duplicates`` groups."""
    rows = documents(read_files(spark, path, stream=True)).withColumn("uploaded_at", F.current_timestamp())
    once = rows.withWatermark("uploaded_at", "1 day").dropDuplicatesWithinWatermark(["file_hash"])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark on ts; what comes later than ``late`` is dropped. A batch is complete as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total; batch or stream."""
    rows = _timed(events, late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 4).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end (last event plus the gap), n."""
    rows = _timed(events, late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
