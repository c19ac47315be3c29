"""API calls of running evaluations as a stream: totals for each window, with a bound on how late a call may come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_windows(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """start, by, calls, total: for batch and streaming DataFrames alike; in a stream, windows close behind the watermark."""
    held = calls.withWatermark(time, late) if calls.isStreaming else calls
    counted = held.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("start"), by, "calls", "total")
