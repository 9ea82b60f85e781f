"""Structured Streaming forms of the batch checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_over_time(stream: DataFrame, ts: str, status: str, lateness: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Rows per status and event-time window. The watermark bounds the state: a window is dropped once it is ``lateness`` old."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, every).alias("window"), F.col(status)).agg(F.count("*").alias("n_rows"))
