"""Backlogs of open items in batch form; ``plumbline.streaming.reminders`` keeps the same state over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliced(events: DataFrame, ts: str, every: str, length: str) -> DataFrame:
    """Each event with every slice it falls into; slices longer than their distance overlap."""
    return events.withColumn("slice", F.window(ts, length, every))


def in_flight(events: DataFrame, status: Column, running: Sequence[str]) -> DataFrame:
    """Events that are running, or have no status."""
    return events.where(status.isin(*running) | (F.coalesce(status, F.lit("")) == ""))


def overdue(events: DataFrame, ts: str, now: Column, *, hours: int, look_back: str) -> DataFrame:
    """Events within the look-back that are strictly older than ``hours``, with their age in whole hours; null times are not overdue."""
    recent = events.where((F.col(ts) > now - F.expr(f"interval {look_back}")) & (F.col(ts) < now - F.expr(f"interval {hours} hours")))
    return recent.withColumn("age_hours", F.floor(F.timestamp_diff("SECOND", F.col(ts), now) / 3600))


def due_reminders(items: DataFrame, state: DataFrame, key: str, now: Column, *, hours: int) -> DataFrame:
    """Items whose key was last reminded at least ``hours`` ago or never; ``state`` holds key and last_reminded."""
    return items.join(state.select(key, "last_reminded"), key, "left").where(F.coalesce(F.col("last_reminded") <= now - F.expr(f"interval {hours} hours"), F.lit(True)))


def quiet(now: Column, zone: str = "Asia/Shanghai") -> Column:
    """Whether it is 21:00 or later, or before 07:30, in the zone; ``now`` is in UTC."""
    local = F.from_utc_timestamp(now, zone)
    minutes = F.hour(local) * 60 + F.minute(local)
    return (minutes >= 21 * 60) | (minutes < 7 * 60 + 30)
