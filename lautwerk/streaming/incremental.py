"""Counts over arriving pairs: sums, so they are kept up to date by adding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """``window, source, target, count`` of a stream of (time, source, target), with a watermark for late rows."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), "source", "target").agg(F.count(F.lit(1)).alias("count"))


def running_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"))
