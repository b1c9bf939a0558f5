"""Reminders over a stream of open items, with a cool-down per key and a state that ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.sources.sinks import upsert

HOUR_MS = 3_600_000


def _remind(cool_down_ms: int, ttl_ms: int):
    def update(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for pdf in batches:
            for at in sorted(pdf["at_ms"].tolist()):
                if last is None or at - last >= cool_down_ms:
                    out.append((key[0], at))
                    last = at
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["id", "at_ms"])

    return update


def reminder_stream(items: DataFrame, *, id: str, ts: str, cool_down_hours: int = 8, ttl_days: int = 8, lateness: str = "1 day") -> DataFrame:
    """(id, at_ms) of each reminder: an item is reminded when its last reminder lies ``cool_down_hours`` back or more.

    State is forgotten ``ttl_days`` after the last reminder, by event time. Items later than
    ``lateness`` are dropped.
    """
    rows = items.withWatermark(ts, lateness).select(F.col(id).cast("string").alias("id"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"))
    return rows.groupBy("id").applyInPandasWithState(_remind(cool_down_hours * HOUR_MS, ttl_days * 24 * HOUR_MS), "id string, at_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def commit_after_send(folder: str, send):
    """A foreachBatch function: state is written only after ``send(rows)`` came back, so a failure repeats reminders but never loses one."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            send(rows)
            upsert(rows.sparkSession, folder, rows, "id", "at_ms")
        finally:
            rows.unpersist()

    return batch
