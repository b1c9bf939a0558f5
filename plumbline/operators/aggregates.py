"""Aggregations over purchase lines and similar facts: two-level spreads, trends, shares, indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import pct_change
from plumbline.operators.windows import globally_ordered


def stats(df: DataFrame, keys: Sequence[str], *, price: str, amount: str, qty: str) -> DataFrame:
    """Mean, least and greatest price, sums and line count per key; rows with a null key part are dropped, sums of nothing are 0."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.avg(price).alias("avg_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"), F.coalesce(F.sum(qty), F.lit(0.0)).alias("total_qty"), F.count(amount).alias("n_lines"),
    )


def spread(per_source: DataFrame, key: str, source: str, *, average: str = "avg_price", at_least: int = 2) -> DataFrame:
    """Per key: number of sources, least and greatest source average, range and percentage; keys with fewer than ``at_least`` sources are left out."""
    out = per_source.groupBy(key).agg(
        F.count_distinct(source).alias("n_sources"), F.min(average).alias("low"), F.max(average).alias("high"), F.array_join(F.array_sort(F.collect_set(source)), " | ").alias("sources"), F.sum("total_amount").alias("total_amount")
    )
    return out.where(F.col("n_sources") >= at_least).select("*", (F.col("high") - F.col("low")).alias("range"), pct_change(F.col("low"), F.col("high")).alias("spread_pct"))


def repeats(df: DataFrame, keys: Sequence[str], *, price: str, amount: str, qty: str, source: str, when: Column, at_least: int = 2) -> DataFrame:
    """Keys seen at least ``at_least`` times: count, sums, mean, distinct sources, first and last date."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_amount"), F.coalesce(F.sum(qty), F.lit(0.0)).alias("total_qty"), F.avg(price).alias("avg_price"),
        F.count_distinct(source).alias("n_sources"), F.min(when).alias("first_date"), F.max(when).alias("last_date"),
    ).where(F.col("n") >= at_least)


def monthly(df: DataFrame, keys: Sequence[str], *, price: str, amount: str, qty: str, when: Column) -> DataFrame:
    """Mean price and sums per key and month; rows without date have no month and are left out."""
    rows = df.withColumn("month", F.date_format(when, "yyyy-MM")).where("month is not null")
    return rows.groupBy(*keys, "month").agg(F.avg(price).alias("avg_price"), F.sum(amount).alias("amount"), F.sum(qty).alias("qty"))


def first_to_last(per_month: DataFrame, keys: Sequence[str], *, value: str = "avg_price", order: str = "month") -> DataFrame:
    """First and last value in order, number of steps and change in percent; null values take no part."""
    return (
        per_month.where(F.col(value).isNotNull()).groupBy(*keys)
        .agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count("*").alias("n_steps"))
        .withColumn("change_pct", pct_change(F.col("first_value"), F.col("last_value")))
    )


def running_share(ranked: DataFrame, *, amount: str, key: str, places: int = 2) -> DataFrame:
    """Rank, share of the total in percent and its running sum from the largest on, both rounded; the sum is that of the rounded shares.

    Ordered in parallel by range: a task adds up its own range, and what the ranges before it
    amount to comes from a table of one row per partition.
    """
    ordered, offsets = globally_ordered(ranked, [F.col(amount).desc_nulls_last(), F.col(key)])
    total = ordered.agg(F.sum(amount)).head()[0]
    shared = ordered.withColumn("share_pct", F.round(F.col(amount) / F.lit(float(total)) * 100, places) if total else F.lit(None).cast("double"))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = shared.groupBy("__part").agg(F.sum("share_pct").alias("__s")).select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__share"))
    inside = W.partitionBy("__part").orderBy("__pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = shared.join(F.broadcast(offsets), "__part").join(F.broadcast(sums), "__part")
    return out.withColumns({"running_pct": F.round(F.col("__share") + F.sum("share_pct").over(inside), places), "rank": F.col("__before") + F.col("__pos") + 1}).drop("__part", "__pos", "__before", "__share")


def unpivoted(df: DataFrame, label: str = "metric", value: str = "value") -> DataFrame:
    """The columns of a one-row table as rows (label, value as text)."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, label, value)


def against_mean(rows: DataFrame, keys: Sequence[str], *, value: str, history: Column, current: Column, at_least: int = 2) -> DataFrame:
    """Current rows with the mean of their key's history and the deviation in percent.

    History is whatever ``history`` selects (the same day, or all days before); keys with fewer
    than ``at_least`` history rows have no mean and are left out. The mean is aggregated before the
    join, so a hot key costs one row on the right side.
    """
    mean = rows.where(history & F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n_history")).where(F.col("n_history") >= at_least)
    out = rows.where(current).join(mean, list(keys))
    return out.withColumn("deviation_pct", pct_change(F.col("mean_value"), F.col(value)))


def banded(value: Column, bands: Sequence[tuple[float, str]]) -> Column:
    """The name of the first band whose lower bound the absolute value reaches, else null; bands from high to low."""
    out = None
    for least, name in bands:
        hit = F.abs(value) >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def source_state(ids: DataFrame, lines: DataFrame, *, id: str, source: str) -> DataFrame:
    """For each requested id: its distinct sources, whether it has exactly one, and whether it has none."""
    found = lines.where(F.col(source).isNotNull()).groupBy(id).agg(F.array_sort(F.collect_set(source)).alias("__s"))
    out = ids.select(id).distinct().join(found, id, "left").withColumn("__n", F.coalesce(F.size("__s"), F.lit(0)))
    out = out.withColumn("__n", F.when(F.col("__n") < 0, 0).otherwise(F.col("__n")))
    return out.select(id, F.col("__n").alias("n_sources"), (F.col("__n") == 1).alias("sole_source"), (F.col("__n") == 0).alias("no_source"), F.array_join(F.coalesce("__s", F.array()), "|").alias("sources"))


def top(df: DataFrame, n: int, *, by: str, key: str) -> DataFrame:
    """The n largest rows; ties by the smaller key."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(key)).limit(n)


def total_or_null(c: Column) -> Column:
    """A sum that is null as soon as any part is."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def histogram(text: Column, pattern: str) -> Column:
    """array of struct(key, n) from all "key(n)" in a text, by a pattern with two groups."""
    keys, counts = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.zip_with(keys, counts, lambda k, n: F.struct(k.alias("key"), n.try_cast("int").alias("n")))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the exact median per key; null values take no part, keys without one are left out.

    Values are counted first, on the map side too, and the middle ones found by a running sum over
    the distinct values in order, so no task holds all values of a key in memory.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    up_to = F.sum("__n").over(W.partitionBy(*keys).orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counted.withColumn("__to", up_to).join(totals, list(keys))
    # The ranks of the two middle values, one and the same for an odd number.
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor((F.col("__total") + 2) / 2)
    holds = lambda rank: (F.col("__to") >= rank) & (F.col("__to") - F.col("__n") < rank)
    middle = placed.where(holds(low) | holds(high))
    return middle.groupBy(*keys).agg(((F.min("__v") + F.max("__v")) / 2).alias(name))


def counts_above(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """One row: n, and for each threshold how many values reach it, as at_least_<threshold>; null reaches none."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(value) >= t).alias(f"at_least_{t:g}") for t in thresholds])
