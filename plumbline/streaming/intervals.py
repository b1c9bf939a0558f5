"""Continuous periods over a stream: the ordered disjoint intervals of an entity are its state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.intervals import DisjointIntervals

_OUT = "k1 string, k2 string, kind string, lo int, hi int"


def _update(key: tuple, batches, state: GroupState):
    held = DisjointIntervals(*state.get) if state.exists else DisjointIntervals()
    for pdf in batches:
        for lo, hi in zip(pdf["lo"].tolist(), pdf["hi"].tolist()):
            held.insert(lo, hi)
    state.update((held.starts, held.ends))
    rows = [(*key, "period", s, e) for s, e in zip(held.starts, held.ends)] + [(*key, "gap", s, e) for s, e in held.gaps()]
    yield pd.DataFrame(rows, columns=["k1", "k2", "kind", "lo", "hi"])


def coverage_stream(spans: DataFrame) -> DataFrame:
    """``spans``: k1, k2, lo, hi (day numbers). Emits an entity's whole picture whenever a record of it arrives (update mode)."""
    return spans.groupBy("k1", "k2").applyInPandasWithState(_update, _OUT, "starts array<int>, ends array<int>", "update", GroupStateTimeout.NoTimeout)
