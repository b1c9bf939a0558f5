"""Continuous periods and gaps of entities whose records overlap, nest or leave days uncovered.

``DisjointIntervals`` is the keyed state: an ordered map of disjoint closed intervals; an
insertion finds what it touches by binary search, merges it and so updates the gaps. Batch runs
keep it twice: on the map side, where every input task folds its records of an entity into few
intervals before anything is shuffled (so an entity with a third of all rows sends a handful of
intervals per task), and behind the shuffle, where rows arrive in the order of entity and start
and only the current entity's state is held. The streaming operator keeps the same state between
micro-batches (``plumbline.streaming.intervals``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_day
from plumbline.functions.text import is_blank

#: Day numbers of open bounds; both lie beyond any date that parse_day gives.
OPEN_FROM, OPEN_TO = -(2**31) + 1, 2**31 - 1
#: Entities that a map-side task holds before it hands them on; a bound on memory, not on the result.
HELD_ENTITIES = 100_000


class DisjointIntervals:
    """Ordered disjoint closed intervals of day numbers; neighbours that meet on the next day are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts=(), ends=()):
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        """Add [start, end]; an empty interval (start after end) changes nothing."""
        if start > end:
            return
        a = bisect_left(self.ends, start - 1)  # the first that reaches up to the day before start
        b = bisect_right(self.starts, end + 1)  # the first that begins beyond the day after end
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [start], [end]

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map side: each entity's records as disjoint intervals, flushed at HELD_ENTITIES."""
    held: dict[tuple, DisjointIntervals] = {}

    def flush() -> pd.DataFrame:
        rows = [(*k, s, e) for k, m in held.items() for s, e in zip(m.starts, m.ends)]
        held.clear()
        return pd.DataFrame(rows, columns=["k1", "k2", "lo", "hi"])

    for pdf in batches:
        for k1, k2, lo, hi in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["lo"].tolist(), pdf["hi"].tolist()):
            m = held.get((k1, k2))
            if m is None:
                held[(k1, k2)] = m = DisjointIntervals()
            m.insert(lo, hi)
        if len(held) >= HELD_ENTITIES:
            yield flush()
    if held:
        yield flush()


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce side: rows sorted by entity; emits an entity's periods and gaps when the next begins."""
    current, state = None, DisjointIntervals()

    def rows(out: list) -> None:
        if current is not None:
            out += [(*current, "period", s, e) for s, e in zip(state.starts, state.ends)]
            out += [(*current, "gap", s, e) for s, e in state.gaps()]

    columns = ["k1", "k2", "kind", "lo", "hi"]
    for pdf in batches:
        out: list = []
        for k1, k2, lo, hi in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["lo"].tolist(), pdf["hi"].tolist()):
            if (k1, k2) != current:
                rows(out)
                current, state = (k1, k2), DisjointIntervals()
            state.insert(lo, hi)
        if out:
            yield pd.DataFrame(out, columns=columns)
    out = []
    rows(out)
    if out:
        yield pd.DataFrame(out, columns=columns)


def bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Day numbers of two date columns, null being open."""
    return F.coalesce(F.unix_date(start), F.lit(OPEN_FROM)), F.coalesce(F.unix_date(end), F.lit(OPEN_TO))


def coverage(records: DataFrame, *, key1: str, key2: str, start: Column, end: Column) -> DataFrame:
    """(key1, key2, kind, first_day, last_day) with kind ``period`` or ``gap``; open bounds are null.

    Records with a blank key part, or that start after their end, are left out. Null dates are
    open on their side. Repeated records change nothing; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    lo, hi = bounds(start, end)
    flat = (
        records.where(~is_blank(F.col(key1)) & ~is_blank(F.col(key2)))
        .select(F.col(key1).cast("string").alias("k1"), F.col(key2).cast("string").alias("k2"), lo.alias("lo"), hi.alias("hi"))
        .where("lo <= hi")
    )
    partial = flat.mapInPandas(_fold, "k1 string, k2 string, lo int, hi int")
    merged = partial.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "lo").mapInPandas(_merge, "k1 string, k2 string, kind string, lo int, hi int")
    return merged.select(
        F.col("k1").alias(key1),
        F.col("k2").alias(key2),
        "kind",
        F.when(F.col("lo") > OPEN_FROM, F.date_from_unix_date("lo")).alias("first_day"),
        F.when(F.col("hi") < OPEN_TO, F.date_from_unix_date("hi")).alias("last_day"),
    )


def price_coverage(info_record: DataFrame) -> DataFrame:
    """Periods and gaps of the price records of each material and supplier."""
    return coverage(info_record, key1="material_id", key2="supplier_id", start=parse_day(F.col("price_valid_from")), end=parse_day(F.col("price_valid_to")))
