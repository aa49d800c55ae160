"""Hourly means of a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_means(stream: DataFrame, key: str, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """Means per key and hour, emitted once the watermark has passed the hour."""
    return stream.withWatermark(ts, late).groupBy(key, F.window(ts, "1 hour")).agg(F.avg(value).alias(value)).select(key, F.col("window.start").alias(ts), value)
