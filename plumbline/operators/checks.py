"""Arithmetic and completeness checks on rows; all findings have one form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding(level: str, category: str, row: Column, evidence: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), row.cast("string").alias("row_ref"), evidence.cast("string").alias("evidence"))


def mismatch(left: Column, right: Column, tolerance: float) -> Column:
    """Whether both sides are known and further apart than ``tolerance``."""
    return F.coalesce(F.abs(left - right) > tolerance, F.lit(False))


def row_findings(rows: DataFrame, *, row: Column, required: Sequence[str], equations: Sequence[tuple[str, Column, Column, float]]) -> DataFrame:
    """One finding per row and broken equation (category, left, right, tolerance), level P0.

    A row that lacks a required field gets one P1 finding that names them and skips its equations.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    broken = [F.when((F.size(missing) == 0) & mismatch(a, b, tol), finding("P0", name, row, F.concat_ws(" <> ", a.cast("string"), b.cast("string")))) for name, a, b, tol in equations]
    lacks = F.when(F.size(missing) > 0, finding("P1", "missing", row, F.array_join(missing, ",")))
    return rows.select(F.explode(F.array_compact(F.array(lacks, *broken))).alias("f")).select("f.*")


def blank_cells(rows: DataFrame, *, row: str, columns: Sequence[str], blank) -> DataFrame:
    """(row, column) of each cell that is blank or a placeholder, by the predicate ``blank``."""
    cells = rows.select(row, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([row], list(columns), "column", "cell")
    return cells.where(blank(F.col("cell"))).select(row, "column")


def unreadable_cells(rows: DataFrame, *, row: str, columns: Sequence[str], blank, number) -> DataFrame:
    """(row, column, state) of each cell without a number: ``blank`` where the predicate says so, else ``unparseable``; a cell is never both."""
    cells = rows.select(row, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([row], list(columns), "column", "cell")
    state = F.when(blank(F.col("cell")), "blank").when(number(F.col("cell")).isNull(), "unparseable")
    return cells.withColumn("state", state).where("state is not null").select(row, "column", "state")


def totals_check(rows: DataFrame, totals: DataFrame, columns: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """(column, summed, stated) where the stated total differs from the sum; a column with an unknown cell is skipped."""
    sums = rows.agg(*[F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in columns]).unpivot([], list(columns), "column", "summed")
    stated = totals.select(*[F.col(c).cast("double").alias(c) for c in columns]).limit(1).unpivot([], list(columns), "column", "stated")
    return sums.join(stated, "column").where(mismatch(F.col("summed"), F.col("stated"), tolerance))


def totals_check_by(rows: DataFrame, totals: DataFrame, keys: Sequence[str], columns: Sequence[str], *, line: str, tolerance: float = 0.01) -> DataFrame:
    """(keys, line, column, summed, stated): ``totals_check`` for many tables at once; of several totals rows of a key the first by ``line`` counts."""
    sums = rows.groupBy(*keys).agg(*[F.when(F.count(c) == F.count(F.lit(1)), F.round(F.sum(c), 2)).alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "summed")
    stated = totals.groupBy(*keys).agg(F.min(F.struct(F.col(line).alias("__line"), *[F.col(c).cast("double").alias(c) for c in columns])).alias("t"))
    stated = stated.select(*keys, F.col("t.__line").alias(line), *[F.col(f"t.{c}").alias(c) for c in columns]).unpivot([*keys, line], list(columns), "column", "stated")
    return sums.join(stated, [*keys, "column"]).where(mismatch(F.col("summed"), F.col("stated"), tolerance)).select(*keys, line, "column", "summed", "stated")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by level and the verdict: mismatch with any P0, else incomplete with any P1, else consistent."""
    n = lambda level: F.count_if(F.col("level") == level)
    out = findings.agg(n("P0").alias("p0"), n("P1").alias("p1"), n("P2").alias("p2"))
    return out.withColumn("verdict", F.when(F.col("p0") > 0, "mismatch").when(F.col("p1") > 0, "incomplete").otherwise("consistent"))
