"""Joins that keep what they do not find, lookups, and pairs within blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key in the given order; null is a key value like any other.

    A partial aggregate on the map side, so a hot key is reduced before the shuffle. ``order``
    must be unique within a key for a defined result.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("row"))
    return picked.select(*keys, "row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order; see ``last_per_key``."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("row"))
    return picked.select(*keys, "row.*").select(*df.columns)


def orphan_join(left: DataFrame, *rights: tuple[DataFrame, Sequence[str | Column]], on: str, flag: str = "_orphan") -> DataFrame:
    """Every left row with the columns of each right table, and whether any right table misses it.

    Each right table is (table, order of its rows): its last row per key counts. Null matches null.
    Columns of a match replace columns of the same name, also by null; without a match they stay.
    An empty left table gives no rows; an empty right table makes every row an orphan.
    """
    out, missing = left, []
    for i, (right, order) in enumerate(rights):
        last = last_per_key(right, [on], order)
        cols = [c for c in last.columns if c != on]
        hit = f"__hit{i}"
        last = last.select(F.col(on).alias(f"__k{i}"), *[F.col(c).alias(f"__r{i}_{c}") for c in cols], F.lit(True).alias(hit))
        joined = out.join(last, out[on].eqNullSafe(last[f"__k{i}"]), "left")
        kept = [c for c in out.columns if c not in cols]
        out = joined.select(
            *kept,
            *[(F.when(F.col(hit), F.col(f"__r{i}_{c}")).otherwise(F.col(c)) if c in out.columns else F.col(f"__r{i}_{c}")).alias(c) for c in cols],
            F.coalesce(hit, F.lit(False)).alias(hit),
        )
        missing.append(~F.col(hit))
    orphan = missing[0] if missing else F.lit(False)
    for m in missing[1:]:
        orphan = orphan | m
    return out.withColumn(flag, orphan).drop(*[f"__hit{i}" for i in range(len(rights))])


def with_lines(headers: DataFrame, lines: DataFrame, *, header_id: str, line_ref: str, items: str = "items") -> DataFrame:
    """Headers with their lines as an array of structs, sorted; headers without lines get an empty one."""
    grouped = lines.where(F.col(line_ref).isNotNull()).groupBy(F.col(line_ref).cast("string").alias("__ref")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in lines.columns if c != line_ref]))).alias(items))
    joined = headers.join(grouped, headers[header_id].cast("string") == grouped["__ref"], "left").drop("__ref")
    return joined.withColumn(items, F.coalesce(items, F.array()))


def lookup_code(df: DataFrame, column: str, codes: DataFrame, *, names: Sequence[str], target: str) -> DataFrame:
    """``column`` replaced by ``target`` of the code table row that knows it under any of ``names``.

    Unknown, null and empty codes stay. Where two rows claim a name the smallest target wins.
    """
    known = codes.select(F.explode(F.array(*[F.col(n).cast("string") for n in names])).alias("__code"), F.col(target).alias("__to"))
    known = known.where("__code is not null and __code <> '' and __to is not null").groupBy("__code").agg(F.min("__to").alias("__to"))
    return df.join(known, df[column].cast("string") == known["__code"], "left").withColumn(column, F.coalesce("__to", F.col(column).cast("string"))).drop("__code", "__to")


def companions(df: DataFrame, suffix: str = "_no") -> DataFrame:
    """A column x for each column x_no that has none yet; the originals stay as they are."""
    return df.withColumns({c[: -len(suffix)]: F.col(c) for c in df.columns if c.endswith(suffix) and c[: -len(suffix)] not in df.columns})


def block_classes(rows: DataFrame, *, block: Sequence[Column], key: str, differ: Column | None = None) -> DataFrame:
    """(key, class_key, n_links): the class of each key that is linked with another one of its block.

    All keys of a block are linked with each other, or with ``differ`` those whose value differs;
    class_key is the block's smallest key and n_links counts a key's partners. Pairs are never
    formed: blocks and their parts are counted by aggregates and joined back, so a block with a
    third of all rows costs no more than its rows. Blocks with a null part link nothing; repeated
    rows count once; a key with several values of ``differ`` counts with each.
    """
    usable = F.col(key).isNotNull()
    for c in block:
        usable = usable & c.isNotNull()
    value = differ if differ is not None else F.lit(0)
    names = [f"b{i}" for i in range(len(block))]
    flat = rows.where(usable).select(*[c.alias(n) for c, n in zip(block, names)], F.col(key).alias("k"), value.alias("v")).distinct()
    whole = flat.groupBy(*names).agg(F.count("*").alias("n"), F.min("k").alias("class_key"))
    linked = flat.join(whole.where("n > 1"), names)
    if differ is None:
        linked = linked.withColumn("n_links", F.col("n") - 1)
    else:
        own = flat.groupBy(*names, "v").agg(F.count("*").alias("n_own"))
        linked = linked.join(own, [*names, "v"]).withColumn("n_links", F.col("n") - F.col("n_own"))
    return linked.where("n_links > 0").select(F.col("k").alias("key"), "class_key", "n_links").distinct()


def full_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and state: ``resolved`` only in old, ``added`` only in new, ``unresolved`` in both."""
    o = old.select(*keys).distinct().withColumn("__o", F.lit(1))
    n = new.select(*keys).distinct().withColumn("__n", F.lit(1))
    joined = o.join(n, list(keys), "full_outer")
    return joined.select(*keys, F.when(F.col("__n").isNull(), "resolved").when(F.col("__o").isNull(), "added").otherwise("unresolved").alias("state"))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, by priority of the sources."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def longer_list(a: Column, b: Column) -> Column:
    """The array with more elements; the first on a tie; null counts as empty."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    return F.when(size(a) >= size(b), F.coalesce(a, b)).otherwise(b)


def recomputed(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """keys, both values and whether two routes to the same aggregate agree; keys of one route alone do not."""
    x = a.select(*keys, F.col(value).alias("value_a"))
    y = b.select(*keys, F.col(value).alias("value_b"))
    agrees = F.coalesce(F.abs(F.col("value_a") - F.col("value_b")) < tolerance, F.lit(False))
    return x.join(y, list(keys), "full_outer").withColumn("agrees", agrees)
