"""Exports in folders: the newest one, its header, its rows."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank


def latest_file(folder: str, pattern: str, exclude: str | None = None) -> str | None:
    """The most recently modified file whose name matches, or None."""
    names = [n for n in os.listdir(folder) if re.search(pattern, n) and not (exclude and re.search(exclude, n))]
    return max((os.path.join(folder, n) for n in names), key=lambda p: (os.path.getmtime(p), p), default=None)


def date_in_name(path: str) -> str:
    m = re.search(r"\d{4}-\d{2}-\d{2}", os.path.basename(path))
    return m[0] if m else "unknown"


def map_header(header: Sequence[str], rules: Sequence[tuple[str, Sequence[str]]]) -> dict[str, str]:
    """field -> column, by the first column that contains one of the field's words; a column serves one field."""
    out: dict[str, str] = {}
    for field, words in rules:
        hit = next((h for h in header if h not in out.values() and any(w in (h or "").strip() for w in words)), None)
        if hit is not None:
            out[field] = hit
    return out


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Header names trimmed, then renamed by the map; absent names are ignored."""
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def read_export(spark: SparkSession, path: str, rules: Sequence[tuple[str, Sequence[str]]], *, sep: str = ",", extra: Mapping[str, str] | None = None) -> DataFrame:
    """A delimited export as text columns named by the rules; fields without a column are null, ``extra`` are constants."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    at = map_header(df.columns, rules)
    columns = [(F.col(f"`{at[field]}`") if field in at else F.lit(None)).cast("string").alias(field) for field, _ in rules]
    return df.select(*columns, *[F.lit(v).alias(k) for k, v in (extra or {}).items()])


def read_positions(spark: SparkSession, path: str, positions: Mapping[str, int], *, sep: str = ",", first: str | None = None, exclude: Mapping[str, Sequence[str]] | None = None, header: bool = True) -> DataFrame:
    """A delimited export as text columns by position, from 0; positions beyond the row are null.

    Rows whose ``first`` field is blank are left out, and those with one of the values of
    ``exclude`` in a field; a null there excludes nothing.
    """
    df = spark.read.option("header", header).option("sep", sep).csv(path)
    names = df.columns
    out = df.select(*[(F.col(f"`{names[i]}`") if i < len(names) else F.lit(None)).cast("string").alias(field) for field, i in positions.items()])
    if first is not None:
        out = out.where(~is_blank(F.col(first)))
    for field, values in (exclude or {}).items():
        out = out.where(~F.coalesce(F.trim(field).isin(*values), F.lit(False)))
    return out


def purchase_rows(df: DataFrame, *, day: str, positive_price: bool = True) -> DataFrame:
    """Rows of an order number, a material and the day; with a price above zero where asked."""
    kept = df.where(F.col("po").startswith("PO") & (F.coalesce(F.trim("material_id"), F.lit("")) != "") & (F.to_date(F.try_to_timestamp("order_date")) == F.lit(day).cast("date")))
    kept = kept.withColumns({"price": F.col("price").try_cast("double"), "qty": F.col("qty").try_cast("double")}).where("price is not null")
    return kept.where("price > 0") if positive_price else kept
