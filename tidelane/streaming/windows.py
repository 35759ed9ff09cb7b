"""Rates and sessions over streams: event-time windows with a watermark, state kept by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """`stream` with `ts` as a timestamp with a watermark; rows later than that are dropped by Spark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def windowed_totals(stream: DataFrame, ts: str, key: str, value: str, width: str, slide: str | None = None) -> DataFrame:
    """key, window_start, n, total of each (sliding) window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(window, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("window_start"), "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """key, session_start, n of runs of rows less than `gap` apart."""
    return stream.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), "n")
