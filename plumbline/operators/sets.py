"""Set operations on tables and on arrays."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_distinct(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def requested_and_found(requested: Column, found: Column) -> Column:
    """The requested values that were found, in the order of the request; null where none or fewer than two were requested."""
    both = F.array_intersect(requested, found)
    return F.when((F.size(requested) >= 2) & (F.size(both) > 0), both)


def symmetric_difference(a: Column, b: Column) -> Column:
    """Values of exactly one of two arrays, sorted."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def character_overlap(a: Column, b: Column, characters: str = r"[一-鿿]") -> Column:
    """Shared distinct characters over those of the smaller side; null where a side has none."""
    chars = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(characters), 0))
    least = F.least(F.size(chars(a)), F.size(chars(b)))
    return F.when(least > 0, F.size(F.array_intersect(chars(a), chars(b))) / least)


def clean_values(values: Column) -> Column:
    """An array of strings without nulls, empty ones and the word undefined."""
    return F.filter(values, lambda x: x.isNotNull() & (x != "") & (x != "undefined"))


def words_present(text: Column, words: list[str]) -> Column:
    """Which of the words a text contains, in their order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def chunked(ids: DataFrame, column: str, size: int = 80) -> DataFrame:
    """(column, chunk): distinct non-null ids in order, ``size`` to a chunk, chunks from 1; for services that take a bounded list."""
    from plumbline.operators.windows import numbered

    n = numbered(ids.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], "__n")
    return n.select(column, (F.floor((F.col("__n") - 1) / size) + 1).alias("chunk"))


def quantity_column(df: DataFrame, known: Sequence[str] = ("quantity", "order_quantity", "purchase_quantity", "qty", "demand_quantity", "num")) -> str | None:
    """The name of the numeric column that holds the quantity: the first known name, else the first whose name says so, else None."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    says = lambda c: "quant" in c.lower() or c.lower().endswith("_qty") or c.lower() == "qty"
    return next((c for c in known if c in numeric), next(filter(says, numeric), None))


def union_selected(mode: str, modes: Mapping[str, Sequence[str]], sources: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """The rows of the sources that a mode asks for, with the source's name; the others are never read. An unknown mode is an error."""
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}")
    return union_all(*[sources[name]().withColumn("source", F.lit(name)) for name in modes[mode]])


def limited(df: DataFrame, n: int, order: Sequence[Column]) -> tuple[DataFrame, bool]:
    """The first ``n`` rows in order, and whether more were left out."""
    first = df.orderBy(*order).limit(n + 1)
    return df.orderBy(*order).limit(n), first.count() > n
