"""Polled slices of a stream: look-back, overlap, and each event once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(events: DataFrame, *, id: str, ts: str, look_back: str = "7 days") -> DataFrame:
    """Each id once while the watermark remembers it; events later than the look-back are dropped, as a poll would not ask for them."""
    return events.withWatermark(ts, look_back).dropDuplicatesWithinWatermark([id])


def sliced_counts(events: DataFrame, *, ts: str, by: str, look_back: str = "7 days", every: str = "12 hours", length: str = "12 hours 10 minutes") -> DataFrame:
    """Counts per overlapping slice and kind."""
    return events.withWatermark(ts, look_back).groupBy(F.window(ts, length, every).alias("slice"), by).agg(F.count("*").alias("n"))
