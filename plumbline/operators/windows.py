"""Order-dependent operators: first occurrences, labels, capped sections, effective records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.joins import last_per_key
from plumbline.session import cut_lineage


def merge_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row per key, with the position of the key's first row as ``first_position``."""
    first = df.groupBy(*keys).agg(F.min(order).alias("first_position"))
    last = last_per_key(df, keys, [order])
    on = None
    for k in keys:
        c = last[k].eqNullSafe(first[k])
        on = c if on is None else on & c
    return last.join(first, on).select(*[last[c] for c in df.columns], first["first_position"])


def repeats_of_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Every later row of a key, with the order value of the key's first row; null and empty keys repeat nothing."""
    keyed = df.withColumn("__key", key).where("__key is not null and __key <> ''")
    first = keyed.groupBy("__key").agg(F.min(order).alias("first_seen"))
    return keyed.join(first, "__key").where(F.col(order) > F.col("first_seen")).drop("__key")


def capped_sections(df: DataFrame, section: str, order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each section with their position, and how many more the section has.

    This is a report's cap, the rows behind it are counted, not lost.
    """
    w = W.partitionBy(section)
    out = df.withColumn("position", F.row_number().over(w.orderBy(*order))).where(F.col("position") <= cap)
    sizes = df.groupBy(section).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("n_more"))
    return out.join(sizes, section)


def globally_ordered(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows with their sorted partition ``__part`` and position ``__pos`` in it, and the rows per partition before each.

    Sorted by range in parallel and written once; no task sees more than its range, and the second
    table has one row per partition.
    """
    ordered = cut_lineage(df.orderBy(*order).withColumn("__raw", F.monotonically_increasing_id()))
    ordered = ordered.withColumns({"__part": F.shiftright("__raw", 33), "__pos": F.col("__raw").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__raw")
    parts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    return ordered, parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n") -> DataFrame:
    """Rows numbered from 1 in a global order; ``order`` must be unique for a defined result."""
    ordered, offsets = globally_ordered(df, order)
    return ordered.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__pos") + 1).drop("__part", "__pos", "__before")


def pair_labels(pairs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Pairs numbered from 1 in order, with the labels A-n and B-n."""
    return numbered(pairs, order).withColumns({"label_a": F.concat(F.lit("A-"), F.col("n")), "label_b": F.concat(F.lit("B-"), F.col("n"))})


def latest_effective(records: DataFrame, keys: Sequence[str], *, price: str, start: Column, end: Column, created: Column, today: Column, tie: str) -> DataFrame:
    """The latest record per key that holds on ``today``: price above zero, start to end inclusive, null open.

    Latest by creation date, else by start, else before all dated; then by ``tie``. A null key part
    is a group of its own.
    """
    valid = records.where((F.col(price) > 0) & F.coalesce(start <= today, F.lit(True)) & F.coalesce(end >= today, F.lit(True)))
    return last_per_key(valid, keys, [F.coalesce(created, start, F.lit("0001-01-01").cast("date")).alias("when"), F.col(tie).alias("tie")])


def greedy_pairs(rows: DataFrame, passes: Sequence[Sequence[Column]], *, key: str) -> DataFrame:
    """(key_a, key_b, pass): each row is used at most once.

    In each pass the rows still unused that share the pass's columns are paired by rank: first with
    second, third with fourth; an odd one is left for the next pass. Blank and null values pair nothing.
    """
    out, left = None, rows
    for i, columns in enumerate(passes):
        usable = F.lit(True)
        for c in columns:
            usable = usable & c.isNotNull() & (c.cast("string") != "")
        names = [f"__g{j}" for j in range(len(columns))]
        grouped = left.where(usable).select(F.col(key).alias("__k"), *[c.alias(n) for c, n in zip(columns, names)])
        # A row's rank in its group is its place in a global order less that of the group's first row.
        placed = numbered(grouped, [*map(F.col, names), F.col("__k")], "__n")
        first = placed.groupBy(*names).agg(F.min("__n").alias("__first"))
        ranked = placed.join(first, names).withColumn("__p", F.floor((F.col("__n") - F.col("__first")) / 2))
        pairs = ranked.groupBy(*names, "__p").agg(F.min("__k").alias("key_a"), F.max("__k").alias("key_b"), F.count("*").alias("n")).where("n = 2").select("key_a", "key_b", F.lit(i + 1).alias("pass"))
        used = pairs.select(F.explode(F.array("key_a", "key_b")).alias(key))
        left = left.join(used, key, "left_anti")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    """Rows numbered from 1 within each key; ``order`` must be unique within a key for a defined result.

    The rows are numbered in the order of keys and ``order`` by range, in parallel, and each key's
    first number is taken off, so a key of any size is spread over many tasks.
    """
    all_rows = cut_lineage(numbered(df, [*map(F.col, keys), *order], "__all"))
    first = all_rows.groupBy(*keys).agg(F.min("__all").alias("__first"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = all_rows.alias("r").join(first.alias("f"), same[0] if len(same) == 1 else F.expr(" and ".join(f"r.`{k}` <=> f.`{k}`" for k in keys)))
    return joined.select("r.*", (F.col("__all") - F.col("__first") + 1).alias(name)).drop("__all")
