"""Queries of the general data problems (units, periods, orphans, snapshots) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.intervals import price_coverage
from plumbline.operators.orphans import material_orphans
from plumbline.operators.snapshots import material_changes
from plumbline.operators.units import price_per_common_unit, same_price_pairs
from plumbline.plans.duck import day as duck_day
from plumbline.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_price_pairs(table(spark, sf, "info_record"))


def p2_common_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its price per common unit."""
    return price_per_common_unit(table(spark, sf, "info_record")).select("record_id", "material_id", "supplier_id", "unit_price", "material_unit", "common_unit", "unit_scale", "common_price")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    gaps = price_coverage(table(spark, sf, "info_record")).where("kind = 'gap'")
    return gaps.select("material_id", "supplier_id", F.date_format("first_day", "yyyy-MM-dd").alias("gap_from"), F.date_format("last_day", "yyyy-MM-dd").alias("gap_to"))


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    """The continuous periods; an open bound is null."""
    periods = price_coverage(table(spark, sf, "info_record")).where("kind = 'period'")
    return periods.select("material_id", "supplier_id", F.date_format("first_day", "yyyy-MM-dd").alias("period_from"), F.date_format("last_day", "yyyy-MM-dd").alias("period_to"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return material_orphans(
        table(spark, sf, "material"),
        {n: (table(spark, sf, n), k) for n, k in (("info_record", "record_id"), ("po_line", "row_id"), ("available_stock", "row_id"))},
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p5_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan rows per table and month."""
    return _orphans(spark, sf).groupBy("table_name", "period_month").agg(F.count("*").alias("orphans"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return material_changes(table(spark, sf, "material_snapshot")).select("snapshot_date", "code", "change_kind")


_SPANS = f"""
WITH r AS (
  SELECT DISTINCT material_id, supplier_id, coalesce({duck_day("price_valid_from")}, DATE '0001-01-01') AS lo, coalesce({duck_day("price_valid_to")}, make_date(20000, 1, 1)) AS hi
  FROM info_record WHERE trim(coalesce(material_id, '')) <> '' AND trim(coalesce(supplier_id, '')) <> ''
), o AS (
  SELECT *, max(hi) OVER (PARTITION BY material_id, supplier_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE lo <= hi
), b AS (
  SELECT *, before IS NULL OR (before < make_date(20000, 1, 1) AND lo > before + 1) AS starts FROM o
)
"""

SQL = {
    "p3_found": _SPANS
    + """
SELECT material_id, supplier_id, strftime(before + 1, '%Y-%m-%d') AS gap_from, strftime(lo - 1, '%Y-%m-%d') AS gap_to
FROM b WHERE starts AND before IS NOT NULL""",
    "p3_periods": _SPANS
    + """
, g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY material_id, supplier_id ORDER BY lo, hi) AS n FROM b)
SELECT material_id, supplier_id,
  CASE WHEN min(lo) > DATE '0001-01-01' THEN strftime(min(lo), '%Y-%m-%d') END AS period_from,
  CASE WHEN max(hi) < make_date(20000, 1, 1) THEN strftime(max(hi), '%Y-%m-%d') END AS period_to
FROM g GROUP BY material_id, supplier_id, n""",
    "p5_found": """
WITH r AS (
  SELECT 'info_record' AS table_name, record_id AS row_id, material_id, landed_at FROM info_record
  UNION ALL SELECT 'po_line', row_id, material_id, landed_at FROM po_line
  UNION ALL SELECT 'available_stock', row_id, material_id, landed_at FROM available_stock)
SELECT DISTINCT table_name, strftime(landed_at, '%Y-%m') AS period_month, row_id FROM r
WHERE trim(coalesce(material_id, '')) <> '' AND NOT EXISTS (
  SELECT 1 FROM material m WHERE m.material_id = r.material_id AND m.landed_at <= r.landed_at AND (m.deleted_at IS NULL OR r.landed_at < m.deleted_at))""",
    "p6_found": f"""
WITH x AS (
  SELECT snapshot_date AS s, upper(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) AS k, {duck_day("modify_date")} AS d, regexp_extract(modify_date, ' (\\d+:\\d+:\\d+)', 1) AS t,
    concat_ws('|', coalesce(name, ''), coalesce(mat_desc, ''), coalesce(cat, ''), coalesce(manufacturer, ''), coalesce(unit, ''), coalesce(lead_time, ''), coalesce(CAST(try_cast(price AS DOUBLE) AS VARCHAR), price, '')) AS h
  FROM material_snapshot),
y AS (SELECT s, k, h, dense_rank() OVER (ORDER BY s) AS i FROM x QUALIFY row_number() OVER (PARTITION BY s, k ORDER BY d DESC NULLS LAST, t DESC) = 1),
n AS (SELECT i, min(s) AS s FROM y GROUP BY i)
SELECT n.s AS snapshot_date, coalesce(a.k, b.k) AS code, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM y a FULL JOIN y b ON a.k = b.k AND b.i = a.i + 1 JOIN n ON n.i = coalesce(b.i, a.i + 1)
WHERE (a.k IS NULL AND b.i > 1) OR b.k IS NULL OR a.h <> b.h""",
}
SQL["p5_by_month"] = f"SELECT table_name, period_month, count(*) AS orphans FROM ({SQL['p5_found']}) GROUP BY ALL"

QUERIES = {f.__name__: f for f in (p2_found, p2_common_prices, p3_found, p3_periods, p5_found, p5_by_month, p6_found)}
