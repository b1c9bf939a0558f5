"""Fields out of free text: references, amounts, labelled values, histograms, pasted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_day
from plumbline.functions.numbers import first_number, price_in_text, strict_number
from plumbline.functions.tables import StockRows, TableRows
from plumbline.functions.text import first_match, is_blank, labelled, labelled_counts, named_value
from plumbline.operators.aggregates import histogram
from plumbline.operators.checks import row_findings
from plumbline.sources.tables import table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(~is_blank(F.col("text"))).select("doc_id", "text", "source")


def order_references(spark: SparkSession, sf: str) -> DataFrame:
    """The first order number of a text, and how many it names."""
    refs = F.regexp_extract_all("text", F.lit(r"(PO[0-9]{7})"), 1)
    return _texts(spark, sf).select("doc_id", first_match([(F.col("text"), r"(PO[0-9]{7})")]).alias("first_order"), F.size(refs).alias("n_orders"), F.size(F.array_distinct(refs)).alias("n_distinct"))


def amounts_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """The first amount with a currency word, and the first number at all."""
    return _texts(spark, sf).select("doc_id", price_in_text(F.col("text")).alias("amount"), first_number(F.regexp_extract("text", r"([0-9][0-9,.]*)", 1)).alias("number"))


def labelled_values(spark: SparkSession, sf: str) -> DataFrame:
    """What follows a label on its line, and the numbers behind some words."""
    counts = labelled_counts(F.col("text"), ["单号", "数量", "交期"])
    return _texts(spark, sf).select("doc_id", labelled(F.col("text"), "Re", "注").alias("subject"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(counts)))).alias("counts"))


def year_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Years that orders of a month name with their counts, written as text and read back."""
    lines = table(spark, sf, "po_line").groupBy(F.date_format(parse_day(F.col("create_time")), "yyyy").alias("year")).agg(F.count("*").alias("n")).where("year is not null")
    text = lines.agg(F.array_join(F.array_sort(F.collect_list(F.concat("year", F.lit("("), F.col("n").cast("string"), F.lit(")")))), "、").alias("text"))
    return text.select(F.explode(histogram(F.col("text"), r"(\d{4})\((\d+)\)")).alias("h")).select(F.col("h.key").alias("year"), "h.n")


def form_values(spark: SparkSession, sf: str) -> DataFrame:
    """The value of a named field of a form, from an array of name and value."""
    form = F.array(F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").alias("value")), F.struct(F.lit("type").alias("name"), F.col("event_type").alias("value")))
    return table(spark, sf, "events").select("event_id", named_value(form, "k").alias("k"), named_value(form, "type").alias("type"), named_value(form, "none").alias("missing"))


def _cell(form: str, number: Column) -> Column:
    """A number as a table cell; null is an empty one."""
    return F.when(number.isNull(), "").otherwise(F.format_string(form, number))


def _orders_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a pasted table: a header, a line per row, and a totals line; what is null is an empty cell."""
    lines = table(spark, sf, "po_line").select("order_no", "row_id", "mat_code", "qty", "price_ex_tax", "total_ex_tax").distinct()
    row = F.concat_ws("\t", F.coalesce("mat_code", F.lit("")), F.lit("个"), *[_cell("%.4f", F.col(c)) for c in ("qty", "price_ex_tax", "total_ex_tax")])
    rows = lines.groupBy("order_no").agg(F.array_sort(F.collect_list(F.struct("row_id", row.alias("t")))).alias("r"))
    return rows.select("order_no", F.concat(F.lit("名称\t单位\t数量\t单价（元）\t金额\n"), F.array_join(F.col("r.t"), "\n"), F.lit("\n合计：见上\n")).alias("text"))


def pasted_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of pasted tables, missing numbers as null; a line without a name counts as a line but is no row (``parse_table``)."""
    t = _orders_as_text(spark, sf)
    return t.lateralJoin(TableRows(F.col("text").outer())).select("order_no", "line", "name", "unit", "qty", "price", "amount")


def _counts_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """The stock of each plant as pasted stock counts, one for every hundred material numbers, with a totals line; every tenth row's difference is misstated by one.

    A null quantity leaves its cells empty, negative ones stay; rows without plant have sheets of their own, named without plant.
    """
    s = table(spark, sf, "available_stock").where(~is_blank(F.col("material_id"))).select("row_id", F.concat(F.coalesce("plant_no", F.lit("")), F.lit("/"), F.substring("material_id", 1, 8)).alias("sheet"), "material_id", F.round("available_qty", 1).alias("q")).distinct()
    n = lambda c: _cell("%.1f", c)
    diff = F.when(F.col("row_id") % 10 == 0, 1.0).otherwise(0.0)
    row = F.concat_ws("\t", "material_id", F.lit("x"), n(F.col("q")), n(F.lit(5.0)), n(F.lit(2.0)), n(F.col("q") + 3), n(F.col("q") + 3), n(diff))
    rows = s.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row_id", row.alias("t")))).alias("r"), n(F.sum("q")).alias("opening"))
    head = F.lit("盘点表\n物料编码\t名称\t期初数量\t入库数量\t出库数量\t账面数量\t实盘数量\t差异数量\n")
    return rows.select("sheet", F.concat(head, F.array_join(F.col("r.t"), "\n"), F.lit("\n合计\t\t"), "opening").alias("text"))


def stock_count_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of pasted stock counts that lack a quantity (P1), or whose book or difference quantity does not follow from the others (P0)."""
    rows = _counts_as_text(spark, sf).lateralJoin(StockRows(F.col("text").outer())).where("not is_total")
    book = F.col("opening") + F.col("in_qty") - F.col("out_qty")
    equations = [("book", book, F.col("book_qty"), 0.005), ("difference", F.col("actual_qty") - F.col("book_qty"), F.col("diff_qty"), 0.005)]
    return row_findings(rows, row=F.concat_ws("/", "sheet", "code"), required=["opening", "book_qty", "actual_qty"], equations=equations).groupBy("level", "category", "row_ref").agg(F.count("*").alias("n"))


def stock_count_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Stated total and sum of the opening quantities of each pasted stock count; null where no row has one."""
    rows = _counts_as_text(spark, sf).lateralJoin(StockRows(F.col("text").outer()))
    return rows.groupBy("sheet").agg(F.round(F.sum(F.when(~F.col("is_total"), F.col("opening"))), 1).alias("summed"), F.round(F.max(F.when(F.col("is_total"), F.col("opening"))), 1).alias("stated"))


def strict_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of the master that are one number and nothing else."""
    return table(spark, sf, "material").select("code", "price").distinct().select("code", strict_number(F.col("price")).alias("number")).where("number is not null")


_D = r"(SELECT doc_id, text FROM documents WHERE regexp_replace(text, '[\s\x{85}\x{A0}\x{AD}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]', '', 'g') <> '')"
SQL = {
    "order_references": f"""SELECT doc_id, nullif(regexp_extract(text, 'PO[0-9]{{7}}'), '') AS first_order, len(regexp_extract_all(text, 'PO[0-9]{{7}}')) AS n_orders, len(list_distinct(regexp_extract_all(text, 'PO[0-9]{{7}}'))) AS n_distinct FROM {_D}""",
    "amounts_in_text": rf"""SELECT doc_id, try_cast(nullif(regexp_extract(text, '(\d+(?:\.\d+)?)\s*(?:元|块|¥|￥)', 1), '') AS DOUBLE) AS amount,
      floor(try_cast(regexp_extract(replace(regexp_extract(text, '([0-9][0-9,.]*)', 1), ',', ''), '\d+(?:\.\d+)?') AS DOUBLE) * 100 + 0.5) / 100 AS number FROM {_D}""",
    "year_histogram": "SELECT left(create_time, 4) AS year, count(*) AS n FROM po_line WHERE regexp_matches(create_time, '^[0-9]{4}') GROUP BY 1",
    "form_values": "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS type, NULL AS missing FROM events",
    "pasted_tables": """WITH l AS (SELECT DISTINCT order_no, row_id, mat_code, qty, price_ex_tax, total_ex_tax FROM po_line WHERE order_no IS NOT NULL AND mat_code IS NOT NULL AND qty IS NOT NULL AND price_ex_tax IS NOT NULL AND total_ex_tax IS NOT NULL AND qty >= 1 AND price_ex_tax >= 0.01)
      SELECT order_no, CAST(1 + row_number() OVER (PARTITION BY order_no ORDER BY row_id, mat_code) AS INT) AS line, mat_code AS name, '个' AS unit, CAST(printf('%.4f', qty) AS DOUBLE) AS qty, CAST(printf('%.4f', price_ex_tax) AS DOUBLE) AS price, CAST(printf('%.4f', total_ex_tax) AS DOUBLE) AS amount FROM l""",
    "stock_count_findings": """SELECT 'P0' AS level, 'difference' AS category, plant_no || '/' || left(material_id, 8) || '/' || material_id AS row_ref, count(*) AS n
      FROM (SELECT DISTINCT row_id, plant_no, material_id, round(available_qty, 1) AS q FROM available_stock WHERE trim(coalesce(material_id, '')) <> '' AND available_qty >= 0 AND plant_no IS NOT NULL) WHERE row_id % 10 = 0 GROUP BY ALL""",
    "stock_count_totals": """SELECT plant_no || '/' || left(material_id, 8) AS sheet, round(sum(q), 1) AS summed, round(sum(q), 1) AS stated
      FROM (SELECT DISTINCT row_id, plant_no, material_id, round(available_qty, 1) AS q FROM available_stock WHERE trim(coalesce(material_id, '')) <> '' AND available_qty >= 0 AND plant_no IS NOT NULL) GROUP BY 1""",
    "strict_numbers": r"SELECT code, CAST(replace(trim(price), ',', '') AS DOUBLE) AS number FROM (SELECT DISTINCT code, price FROM material) WHERE regexp_full_match(trim(price), '[-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?')",
}
QUERIES = {f.__name__: f for f in (order_references, amounts_in_text, labelled_values, year_histogram, form_values, pasted_tables, stock_count_findings, stock_count_totals, strict_numbers)}
