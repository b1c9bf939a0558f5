"""What changed between full exports of a table.

The rows of each key are put in the order of the exports; the lag of a hash over the compared
fields shows changes, gaps in the export numbers show removals and later additions. One shuffle
by key carries the whole history; it holds one row per key and export, so a key that repeats
inside an export is first reduced by a partial aggregate (``max_by``) on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_day, time_of_day
from plumbline.functions.numbers import parse_number
from plumbline.functions.text import is_blank, strip


def same_text(c: str) -> Column:
    """A field in the form in which null and empty are equal."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def same_number(c: str) -> Column:
    """A field compared as a number where it is one, else as text."""
    n = parse_number(F.col(c))
    return F.when(n.isNotNull(), n.cast("string")).otherwise(same_text(c))


def snapshot_changes(
    rows: DataFrame,
    *,
    snapshot: str,
    key: Column,
    compared: Sequence[Column],
    newest: Sequence[Column],
) -> DataFrame:
    """(snapshot_date, code, change_kind): added, removed or changed against the export just before.

    Rows without export date or key have no place in any export and are left out. Of several rows
    of a key in an export the one with the greatest ``newest`` counts (nulls are the least); on a
    full tie the greatest hash, so the choice never depends on row order. An empty table and a
    single export give no rows. Further columns, whatever their names, are not read.
    """
    flat = rows.select(
        F.col(snapshot).alias("s"),
        key.alias("k"),
        F.xxhash64(*compared).alias("h"),
        F.struct(*[c.alias(f"n{i}") for i, c in enumerate(newest)]).alias("newest"),
    ).where(F.col("s").isNotNull() & F.col("k").isNotNull() & (F.col("k") != ""))
    kept = flat.groupBy("s", "k").agg(F.max_by("h", F.struct("newest", "h")).alias("h"))
    # One row per export: as many as there are delivery days, whatever the size of the table.
    exports = rows.select(F.col(snapshot).alias("s")).where(F.col("s").isNotNull()).distinct()
    by_date = W.partitionBy(F.lit(0)).orderBy("s")
    exports = exports.select("s", F.row_number().over(by_date).alias("i"), F.lead("s").over(by_date).alias("s_next"))
    history = W.partitionBy("k").orderBy("i")
    seen = kept.join(F.broadcast(exports), "s").select(
        "s", "s_next", "k", "i", "h",
        F.lag("i").over(history).alias("i_prev"),
        F.lag("h").over(history).alias("h_prev"),
        F.lead("i").over(history).alias("i_next"),
    )
    here = (
        F.when((F.col("i") > 1) & (F.col("i_prev").isNull() | (F.col("i_prev") < F.col("i") - 1)), "added")
        .when((F.col("i_prev") == F.col("i") - 1) & (F.col("h") != F.col("h_prev")), "changed")
    )
    gone = F.when(F.col("s_next").isNotNull() & (F.col("i_next").isNull() | (F.col("i_next") > F.col("i") + 1)), "removed")
    events = F.array(
        F.struct(F.col("s").alias("snapshot_date"), here.alias("change_kind")),
        F.struct(F.col("s_next").alias("snapshot_date"), gone.alias("change_kind")),
    )
    return seen.select("k", F.explode(events).alias("e")).where("e.change_kind is not null").select("e.snapshot_date", F.col("k").alias("code"), "e.change_kind")


def material_changes(snapshots: DataFrame) -> DataFrame:
    """The changes of the material master between its exports."""
    return snapshot_changes(
        snapshots.where(~is_blank(F.col("snapshot_date"))),
        snapshot="snapshot_date",
        key=F.upper(strip(F.col("code"))),
        compared=[*(same_text(c) for c in ("name", "mat_desc", "cat", "manufacturer", "unit", "lead_time")), same_number("price")],
        newest=[parse_day(F.col("modify_date")), time_of_day(F.col("modify_date"))],
    )
