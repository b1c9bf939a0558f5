"""Purchase lines: spreads, repeats, trends, rankings, stock and sole sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_day
from plumbline.functions.numbers import open_quantity
from plumbline.functions.text import is_blank
from plumbline.operators import aggregates as A
from plumbline.operators.joins import orphan_join, recomputed
from plumbline.operators.sets import union_all
from plumbline.operators.windows import capped_sections
from plumbline.plans.duck import day as duck_day
from plumbline.sources.tables import table

#: Days the queries take as today, and the first day of the top-spend profile; parameters, not data.
TODAY, SINCE = "2025-06-30", "2025-01-01"
_PRICE, _AMOUNT, _QTY = "price_ex_tax", "total_ex_tax", "qty"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with an amount above zero, with their order day."""
    return table(spark, sf, "po_line").where(F.col(_AMOUNT) > 0).withColumn("day", F.coalesce(parse_day(F.col("order_time")), parse_day(F.col("create_time"))))


def _r(c: str, places: int = 10) -> Column:
    return (F.round(c, places) + F.lit(0.0)).alias(c)  # no negative zero


def po_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = A.stats(_lines(spark, sf), ["mat_code", "mat_name", "supplier_code"], price=_PRICE, amount=_AMOUNT, qty=_QTY)
    return s.select("mat_code", "mat_name", "supplier_code", _r("avg_price"), "min_price", "max_price", _r("total_amount", 2), _r("total_qty", 2), "n_lines")


def _spread(lines: DataFrame) -> DataFrame:
    s = A.stats(lines, ["mat_code", "supplier_code"], price=_PRICE, amount=_AMOUNT, qty=_QTY)
    return A.spread(s, "mat_code", "supplier_code")


def price_spread(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(_lines(spark, sf)).select("mat_code", "n_sources", _r("low"), _r("high"), "sources", _r("total_amount", 2), _r("range"), _r("spread_pct"))


def price_spread_category(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the categories whose name contains 材."""
    cable = _lines(spark, sf).where(F.coalesce(F.contains("mat_category", F.lit("材")), F.lit(False)))
    return _spread(cable).select("mat_code", "n_sources", _r("low"), _r("high"), _r("spread_pct"))


def repeat_purchase(spark: SparkSession, sf: str) -> DataFrame:
    r = A.repeats(_lines(spark, sf), ["mat_code"], price=_PRICE, amount=_AMOUNT, qty=_QTY, source="supplier_code", when=F.col("day"))
    return r.select("mat_code", "n", _r("total_amount", 2), _r("total_qty", 2), _r("avg_price"), "n_sources", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"))


def repeat_purchase_category(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).where(F.col("mat_category") == "线材")
    return A.repeats(lines, ["mat_code"], price=_PRICE, amount=_AMOUNT, qty=_QTY, source="supplier_code", when=F.col("day")).select("mat_code", "n", _r("total_amount", 2), "n_sources")


def _trend(spark: SparkSession, sf: str) -> DataFrame:
    """Months of the materials bought at least three times (a semi join on their codes)."""
    lines = _lines(spark, sf)
    frequent = lines.where("mat_code is not null").groupBy("mat_code").count().where("count >= 3").select("mat_code")
    return A.monthly(lines.join(frequent, "mat_code", "left_semi"), ["mat_code"], price=_PRICE, amount=_AMOUNT, qty=_QTY, when=F.col("day"))


def price_trend_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _trend(spark, sf).select("mat_code", "month", _r("avg_price"), _r("amount", 2), _r("qty", 2))


def price_trend_change(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_to_last(_trend(spark, sf), ["mat_code"]).select("mat_code", _r("first_value"), _r("last_value"), "n_steps", _r("change_pct", 3))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).dropna(subset=["supplier_code"]).groupBy("supplier_code").agg(F.round(F.sum(_AMOUNT), 2).alias("amount"), F.count("*").alias("n_lines"), F.count_distinct("mat_code").alias("n_materials"))


def supplier_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return A.running_share(_suppliers(spark, sf), amount="amount", key="supplier_code")


def po_overview(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    one = lines.agg(
        F.count("*").alias("lines"), F.count_distinct("order_no").alias("orders"), F.count_distinct("supplier_code").alias("suppliers"), F.count_distinct("mat_code").alias("materials"),
        F.count_if(F.col("unit").isNull()).alias("lines_without_unit"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"),
    )
    return A.unpivoted(one)


def price_vs_same_day(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the day with the mean of that same day."""
    today = F.col("day") == F.lit(TODAY).cast("date")
    return A.against_mean(_lines(spark, sf).where(today), ["mat_code"], value=_PRICE, history=F.lit(True), current=F.lit(True)).select("row_id", "mat_code", _PRICE, _r("mean_value"), "n_history", _r("deviation_pct", 3))


def price_vs_history(spark: SparkSession, sf: str) -> DataFrame:
    """Lines from today on with the mean of all days before, and the band of the deviation."""
    today = F.lit(TODAY).cast("date")
    out = A.against_mean(_lines(spark, sf), ["mat_code"], value=_PRICE, history=F.col("day") < today, current=F.col("day") >= today)
    return out.select("row_id", "mat_code", _PRICE, _r("mean_value"), "n_history", _r("deviation_pct", 3), A.banded(F.round("deviation_pct", 3) + F.lit(0.0), [(50, "high"), (20, "medium")]).alias("band"))


def orphan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with its material's name and its stock; orphan if either table misses it."""
    lines = table(spark, sf, "po_line").select("row_id", "material_id", "mat_name").distinct()
    names = table(spark, sf, "material").select("material_id", F.col("name").alias("mat_name"), "landed_at")
    stock = _stock(spark, sf)
    return orphan_join(lines, (names, ["landed_at", "mat_name"]), (stock, ["available"]), on="material_id").select("row_id", "material_id", "mat_name", "available", F.col("_orphan").alias("orphan"))


def _stock(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "available_stock").where(~is_blank(F.col("material_id"))).distinct()
    return s.groupBy("material_id").agg(F.round(F.sum(F.coalesce("available_qty", F.lit(0.0))), 2).alias("available"))


def stock_total(spark: SparkSession, sf: str) -> DataFrame:
    """Stock per material, and the same as null where any part is unknown."""
    s = table(spark, sf, "available_stock").where(~is_blank(F.col("material_id")))
    return s.groupBy("material_id").agg(F.round(F.coalesce(F.sum("available_qty"), F.lit(0.0)), 2).alias("known"), F.round(A.total_or_null(F.col("available_qty")), 2).alias("total"))


def traded_without_record(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "po_line").where(~is_blank(F.col("material_id"))).select("material_id").distinct()
    records = table(spark, sf, "info_record").where(~is_blank(F.col("material_id"))).select("material_id")
    return lines.join(records, "material_id", "left_anti")


def sole_source(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "material").select("material_id")
    lines = table(spark, sf, "po_line").where(~is_blank(F.col("supplier_code")) & F.col("material_id").isNotNull())
    return A.source_state(ids, lines, id="material_id", source="supplier_code")


def top_spend(spark: SparkSession, sf: str) -> DataFrame:
    spend = _lines(spark, sf).where("material_id is not null").groupBy("material_id").agg(F.round(F.sum(_AMOUNT), 2).alias("spend"))
    return A.top(spend, 10, by="spend", key="material_id")


def top_spend_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The ten materials of most spend since a day, with stock, name and supplier state."""
    lines = _lines(spark, sf).where((F.col("day") >= F.lit(SINCE).cast("date")) & F.col("material_id").isNotNull())
    best = A.top(lines.groupBy("material_id").agg(F.round(F.sum(_AMOUNT), 2).alias("spend")), 10, by="spend", key="material_id")
    names = table(spark, sf, "material").select("material_id", "name", "landed_at")
    state = A.source_state(best, lines, id="material_id", source="supplier_code").select("material_id", "n_sources", "sole_source")
    out = orphan_join(best, (_stock(spark, sf), ["available"]), (names, ["landed_at", "name"]), (state, ["n_sources"]), on="material_id")
    return out.select("material_id", "spend", "available", "name", "n_sources", "sole_source", F.col("_orphan").alias("orphan"))


def top_materials_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """Of each supplier the three materials of most spend, and how many more it has."""
    spend = _lines(spark, sf).dropna(subset=["supplier_code", "mat_code"]).groupBy("supplier_code", "mat_code").agg(F.round(F.sum(_AMOUNT), 2).alias("spend"))
    return capped_sections(spend, "supplier_code", [F.col("spend").desc(), F.col("mat_code")], 3)


def rows_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three tables that are stacked; columns that a table lacks are null."""
    parts = [table(spark, sf, n).select("material_id", F.lit(n).alias("source"), *extra) for n, extra in (("po_line", ["qty"]), ("info_record", ["unit_price"]), ("available_stock", ["available_qty"]))]
    return union_all(*parts).groupBy("source").agg(F.count("*").alias("n"), F.count("qty").alias("n_qty"), F.count("unit_price").alias("n_price"), F.count("available_qty").alias("n_stock"))


def spend_two_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier totals from lines and from orders, and whether they agree."""
    lines = _lines(spark, sf).dropna(subset=["supplier_code"])
    a = lines.groupBy("supplier_code").agg(F.round(F.sum(_AMOUNT), 2).alias("amount"))
    orders = lines.groupBy("supplier_code", "order_no").agg(F.sum(_AMOUNT).alias("amount"))
    b = orders.groupBy("supplier_code").agg(F.round(F.sum("amount"), 2).alias("amount"))
    return recomputed(a, b, ["supplier_code"], "amount", 0.05).select("supplier_code", "value_a", "agrees")


def open_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Open quantity of a line: what was ordered, less what of the order's lines is in stock; null where nothing was ordered."""
    lines = table(spark, sf, "po_line").select("row_id", "material_id", "qty").distinct()
    stock = _stock(spark, sf)
    return lines.join(stock, "material_id", "left").select("row_id", "qty", F.round(open_quantity(F.lit(None).cast("double"), F.col("qty"), F.col("available")), 8).alias("open_qty"))


_L = f"""
WITH l AS (SELECT *, coalesce({duck_day("order_time")}, {duck_day("create_time")}) AS day FROM po_line WHERE total_ex_tax > 0)
"""
_SPREAD = """
, s AS (SELECT mat_code, supplier_code, avg(price_ex_tax) AS a, sum(total_ex_tax) AS t FROM {src} WHERE mat_code IS NOT NULL AND supplier_code IS NOT NULL GROUP BY ALL),
g AS (SELECT mat_code, count(DISTINCT supplier_code) AS n_sources, min(a) AS low, max(a) AS high, array_to_string(list_sort(list(DISTINCT supplier_code)), ' | ') AS sources, sum(t) AS total_amount FROM s GROUP BY mat_code HAVING count(DISTINCT supplier_code) >= 2)
"""
_PCT = "CASE WHEN {a} > 0 THEN ({b} - {a}) / {a} * 100 ELSE 0 END"
_TREND = """
, f AS (SELECT mat_code FROM l WHERE mat_code IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT mat_code, strftime(day, '%Y-%m') AS month, avg(price_ex_tax) AS avg_price, sum(total_ex_tax) AS amount, sum(qty) AS qty FROM l SEMI JOIN f USING (mat_code) WHERE day IS NOT NULL GROUP BY ALL)
"""
_STOCK = "(SELECT material_id, round(sum(coalesce(available_qty, 0)), 2) AS available FROM (SELECT DISTINCT * FROM available_stock) WHERE trim(coalesce(material_id, '')) <> '' GROUP BY 1)"
_NAMES = "(SELECT material_id, arg_max(name, (landed_at, name)) AS name FROM material GROUP BY 1)"
_T, _S = f"DATE '{TODAY}'", f"DATE '{SINCE}'"

SQL = {
    "po_stats": _L + """SELECT mat_code, mat_name, supplier_code, round(avg(price_ex_tax), 10) AS avg_price, min(price_ex_tax) AS min_price, max(price_ex_tax) AS max_price,
      round(sum(total_ex_tax), 2) AS total_amount, round(coalesce(sum(qty), 0), 2) AS total_qty, count(total_ex_tax) AS n_lines
      FROM l WHERE mat_code IS NOT NULL AND mat_name IS NOT NULL AND supplier_code IS NOT NULL GROUP BY ALL""",
    "price_spread": _L + _SPREAD.format(src="l") + f"SELECT mat_code, n_sources, round(low, 10) AS low, round(high, 10) AS high, sources, round(total_amount, 2) AS total_amount, round(high - low, 10) AS range, round({_PCT.format(a='low', b='high')}, 10) AS spread_pct FROM g",
    "price_spread_category": _L + _SPREAD.format(src="(SELECT * FROM l WHERE contains(mat_category, '材'))") + f"SELECT mat_code, n_sources, round(low, 10) AS low, round(high, 10) AS high, round({_PCT.format(a='low', b='high')}, 10) AS spread_pct FROM g",
    "repeat_purchase": _L + """SELECT mat_code, count(*) AS n, round(sum(total_ex_tax), 2) AS total_amount, round(coalesce(sum(qty), 0), 2) AS total_qty, round(avg(price_ex_tax), 10) AS avg_price, count(DISTINCT supplier_code) AS n_sources,
      strftime(min(day), '%Y-%m-%d') AS first_date, strftime(max(day), '%Y-%m-%d') AS last_date FROM l WHERE mat_code IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""",
    "repeat_purchase_category": _L + "SELECT mat_code, count(*) AS n, round(sum(total_ex_tax), 2) AS total_amount, count(DISTINCT supplier_code) AS n_sources FROM l WHERE mat_category = '线材' AND mat_code IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "price_trend_monthly": _L + _TREND + "SELECT mat_code, month, round(avg_price, 10) AS avg_price, round(amount, 2) AS amount, round(qty, 2) AS qty FROM m",
    "price_trend_change": _L + _TREND + f""", c AS (SELECT mat_code, arg_min(avg_price, month) AS x, arg_max(avg_price, month) AS y, count(*) AS n_steps FROM m WHERE avg_price IS NOT NULL GROUP BY 1)
      SELECT mat_code, round(x, 10) AS first_value, round(y, 10) AS last_value, n_steps, round({_PCT.format(a='x', b='y')}, 3) + 0.0 AS change_pct FROM c""",
    "supplier_ranking": _L + """, s AS (SELECT supplier_code, round(sum(total_ex_tax), 2) AS amount, count(*) AS n_lines, count(DISTINCT mat_code) AS n_materials FROM l WHERE supplier_code IS NOT NULL GROUP BY 1),
      p AS (SELECT *, round(amount / sum(amount) OVER () * 100, 2) AS share_pct FROM s)
      SELECT *, round(sum(share_pct) OVER (ORDER BY amount DESC, supplier_code ROWS UNBOUNDED PRECEDING), 2) AS running_pct, row_number() OVER (ORDER BY amount DESC, supplier_code) AS rank FROM p""",
    "po_overview": _L + """, o AS (SELECT count(*)::VARCHAR AS lines, count(DISTINCT order_no)::VARCHAR AS orders, count(DISTINCT supplier_code)::VARCHAR AS suppliers, count(DISTINCT mat_code)::VARCHAR AS materials,
      count(*) FILTER (unit IS NULL)::VARCHAR AS lines_without_unit, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM l)
      SELECT metric, value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE value)""",
    "price_vs_same_day": _L + f""", t AS (SELECT * FROM l WHERE day = {_T}), h AS (SELECT mat_code, avg(price_ex_tax) AS m, count(*) AS n FROM t WHERE price_ex_tax IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
      SELECT row_id, mat_code, price_ex_tax, round(m, 10) AS mean_value, n AS n_history, round({_PCT.format(a='m', b='price_ex_tax')}, 3) + 0.0 AS deviation_pct FROM t JOIN h USING (mat_code)""",
    "price_vs_history": _L + f""", h AS (SELECT mat_code, avg(price_ex_tax) AS m, count(*) AS n FROM l WHERE day < {_T} AND price_ex_tax IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
      d AS (SELECT row_id, mat_code, price_ex_tax, round(m, 10) AS mean_value, n AS n_history, round({_PCT.format(a='m', b='price_ex_tax')}, 3) + 0.0 AS deviation_pct FROM l JOIN h USING (mat_code) WHERE day >= {_T})
      SELECT *, CASE WHEN abs(deviation_pct) >= 50 THEN 'high' WHEN abs(deviation_pct) >= 20 THEN 'medium' END AS band FROM d""",
    "orphan_lines": f"""SELECT row_id, l.material_id, CASE WHEN m.material_id IS NOT NULL THEN m.name ELSE l.mat_name END AS mat_name, s.available, m.material_id IS NULL OR s.material_id IS NULL AS orphan
      FROM (SELECT DISTINCT row_id, material_id, mat_name FROM po_line) l LEFT JOIN {_NAMES} m USING (material_id) LEFT JOIN {_STOCK} s USING (material_id)""",
    "stock_total": """SELECT material_id, round(coalesce(sum(available_qty), 0), 2) AS known, CASE WHEN count(available_qty) = count(*) THEN round(sum(available_qty), 2) END AS total
      FROM available_stock WHERE trim(coalesce(material_id, '')) <> '' GROUP BY 1""",
    "traded_without_record": "SELECT DISTINCT material_id FROM po_line WHERE trim(coalesce(material_id, '')) <> '' AND material_id NOT IN (SELECT material_id FROM info_record WHERE material_id IS NOT NULL)",
    "sole_source": """WITH f AS (SELECT material_id, list_sort(list(DISTINCT supplier_code)) AS s FROM po_line WHERE trim(coalesce(supplier_code, '')) <> '' AND material_id IS NOT NULL GROUP BY 1)
      SELECT material_id, coalesce(len(s), 0) AS n_sources, coalesce(len(s), 0) = 1 AS sole_source, coalesce(len(s), 0) = 0 AS no_source, coalesce(array_to_string(s, '|'), '') AS sources
      FROM (SELECT DISTINCT material_id FROM material) LEFT JOIN f USING (material_id)""",
    "top_spend": _L + "SELECT material_id, round(sum(total_ex_tax), 2) AS spend FROM l WHERE material_id IS NOT NULL GROUP BY 1 ORDER BY spend DESC, material_id LIMIT 10",
    "top_spend_profile": _L + f""", w AS (SELECT * FROM l WHERE day >= {_S} AND material_id IS NOT NULL), b AS (SELECT material_id, round(sum(total_ex_tax), 2) AS spend FROM w GROUP BY 1 ORDER BY spend DESC, material_id LIMIT 10),
      n AS (SELECT material_id, count(DISTINCT supplier_code) AS n_sources FROM w GROUP BY 1)
      SELECT material_id, spend, available, name, n_sources, n_sources = 1 AS sole_source, s.material_id IS NULL OR m.material_id IS NULL AS orphan
      FROM b JOIN n USING (material_id) LEFT JOIN {_STOCK} s USING (material_id) LEFT JOIN {_NAMES} m USING (material_id)""",
    "top_materials_by_supplier": _L + """, s AS (SELECT supplier_code, mat_code, round(sum(total_ex_tax), 2) AS spend FROM l WHERE supplier_code IS NOT NULL AND mat_code IS NOT NULL GROUP BY ALL)
      SELECT supplier_code, mat_code, spend, row_number() OVER w AS position, greatest(count(*) OVER (PARTITION BY supplier_code) - 3, 0) AS n_more FROM s WINDOW w AS (PARTITION BY supplier_code ORDER BY spend DESC, mat_code) QUALIFY row_number() OVER w <= 3""",
    "rows_by_source": """SELECT 'po_line' AS source, count(*) AS n, count(qty) AS n_qty, 0 AS n_price, 0 AS n_stock FROM po_line UNION ALL SELECT 'info_record', count(*), 0, count(unit_price), 0 FROM info_record
      UNION ALL SELECT 'available_stock', count(*), 0, 0, count(available_qty) FROM available_stock""",
    "spend_two_ways": _L + "SELECT supplier_code, round(sum(total_ex_tax), 2) AS value_a, true AS agrees FROM l WHERE supplier_code IS NOT NULL GROUP BY 1",
    "open_quantities": f"""SELECT row_id, qty, CASE WHEN qty IS NULL THEN NULL ELSE round(greatest(0, qty - coalesce(available, 0)), 4) END AS open_qty
      FROM (SELECT DISTINCT row_id, material_id, qty FROM po_line) LEFT JOIN {_STOCK} USING (material_id)""",
}

QUERIES = {f.__name__: f for f in (po_stats, price_spread, price_spread_category, repeat_purchase, repeat_purchase_category, price_trend_monthly, price_trend_change, supplier_ranking, po_overview, price_vs_same_day, price_vs_history, orphan_lines, stock_total, traded_without_record, sole_source, top_spend, top_spend_profile, top_materials_by_supplier, rows_by_source, spend_two_ways, open_quantities)}
