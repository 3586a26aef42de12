"""Streaming means over event time, and first-seen deduplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions import text as X


def windowed_means(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean value by event type and tumbling window; rows later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def first_seen(documents: DataFrame, at: str | None = None, late: str = "1 day") -> DataFrame:
    """Documents whose fingerprint wasn't seen before in the stream.

    With ``at``, the column of the event time, a fingerprint is remembered until the watermark is ``late`` past it, which
    bounds the state of an endless stream; without it, for a stream that ends, it is remembered for good.
    """
    known = documents.withColumn("fingerprint", X.fingerprint(F.col("text")))
    if at is None:
        return known.dropDuplicates(["fingerprint"])
    return known.withWatermark(at, late).dropDuplicatesWithinWatermark(["fingerprint"])
