"""Further reports over the same tables: thresholds, numbering, packs, sheets, quotes, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_day, year_before
from plumbline.functions.numbers import parse_number, pct_change, price_stats, prices_in_text
from plumbline.functions.packs import BARE, CONTAINERS, NARROW, PATTERNS, WIDE, pack_spec
from plumbline.functions.tables import StockRows, TableRows
from plumbline.functions.text import company_name, is_blank, is_unfilled, keyword_flag, masked_secret, money_text
from plumbline.operators import aggregates as A
from plumbline.operators.checks import row_findings, totals_check_by, unreadable_cells
from plumbline.operators.joins import first_per_key
from plumbline.operators.sets import chunked, quantity_column
from plumbline.operators.windows import numbered_within
from plumbline.plans import spend
from plumbline.plans.duck import day as duck_day
from plumbline.plans.duck import unfilled
from plumbline.sources.tables import table

#: Words of the components whose prices ``component_prices`` lists; a parameter.
COMPONENTS = ["断路器", "端子", "电缆", "led", "cable"]


def wide_spreads(spark: SparkSession, sf: str) -> DataFrame:
    """How many materials have a price spread at all, of 20 % and of 50 %."""
    return A.counts_above(spend.price_spread(spark, sf), "spread_pct", [20, 50])


def frequent_materials(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred materials of most spend among those bought at least three times."""
    lines = table(spark, sf, "po_line").where("total_ex_tax > 0 and mat_code is not null")
    often = lines.groupBy("mat_code").agg(F.count("*").alias("n"), F.round(F.sum("total_ex_tax"), 2).alias("amount")).where("n >= 3")
    return A.top(often, 100, by="amount", key="mat_code")


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The purchase lines of each material numbered in the order of their days, undated ones first."""
    lines = table(spark, sf, "po_line").where("mat_code is not null").select("row_id", "mat_code", F.coalesce(parse_day(F.col("order_time")), parse_day(F.col("create_time"))).alias("day")).distinct()
    return numbered_within(lines, ["mat_code"], [F.col("day").asc_nulls_first(), F.col("row_id")]).select("row_id", "mat_code", "n")


def pack_specs(spark: SparkSession, sf: str) -> DataFrame:
    """What a pack holds by description or name, where either says anything of packs."""
    m = table(spark, sf, "material").select("code", "name", "mat_desc").distinct().withColumn("s", pack_spec(F.col("mat_desc"), F.col("name")))
    return m.where("s is not null").select("code", "s.qty", "s.container", "s.source", "s.confidence").distinct()


def piece_materials(spark: SparkSession, sf: str) -> DataFrame:
    """Materials whose first price record is in pieces."""
    r = table(spark, sf, "info_record").where(~is_blank(F.col("material_id"))).select("material_id", "record_id", "landed_at", "material_unit").distinct()
    return first_per_key(r, ["material_id"], ["landed_at", "record_id", "material_unit"]).where("upper(trim(material_unit)) = 'PCS'").select("material_id")


def quantity_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The quantity column of each table that has one."""
    found = [(n, quantity_column(table(spark, sf, n))) for n in ("po_line", "available_stock", "info_record", "lineitem")]
    return spark.createDataFrame([x for x in found if x[1]], "table_name string, column_name string")


def id_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The material numbers in stock, eighty to a chunk."""
    return chunked(table(spark, sf, "available_stock"), "material_id", 80).groupBy("chunk").agg(F.count("*").alias("n"), F.min("material_id").alias("first_id"), F.max("material_id").alias("last_id"))


def last_year_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and spend per month of the twelve months before today."""
    today = F.lit(spend.TODAY).cast("date")
    lines = table(spark, sf, "po_line").where("total_ex_tax > 0").select("total_ex_tax", F.coalesce(parse_day(F.col("order_time")), parse_day(F.col("create_time"))).alias("day"))
    recent = lines.where((F.col("day") >= year_before(today)) & (F.col("day") < today))
    return recent.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("total_ex_tax"), 2).alias("amount"))


def component_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Materials that are components by their name or description, with a price above zero."""
    m = table(spark, sf, "material").select("code", "name", "mat_desc", parse_number(F.col("price")).alias("price")).distinct()
    return m.where((F.col("price") > 0) & keyword_flag(F.concat_ws(" ", "name", "mat_desc"), COMPONENTS, [])).select("code", "price").distinct()


def unreadable_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of the master that are no number: not filled, or filled with something else."""
    m = table(spark, sf, "material").select("code", "price").distinct()
    return unreadable_cells(m, row="code", columns=["price"], blank=is_unfilled, number=parse_number).distinct()


def sole_source_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Spend on each material that a single supplier delivers."""
    lines = table(spark, sf, "po_line").where(~is_blank(F.col("supplier_code")) & F.col("material_id").isNotNull() & (F.col("total_ex_tax") > 0))
    # One row per material and supplier before anything is gathered, so a hot material is added up on the map side.
    each = lines.groupBy("material_id", "supplier_code").agg(F.sum("total_ex_tax").alias("spend"))
    return each.groupBy("material_id").agg(F.count("*").alias("n"), F.first("supplier_code").alias("supplier_code"), F.round(F.sum("spend"), 2).alias("spend")).where("n = 1").drop("n")


def company_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier_ref").select("supplier_code", company_name(F.col("supplier_name")).alias("short_name"))


def masked_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Spend per supplier as text, the supplier's code masked; a supplier without a known amount has a dash."""
    s = table(spark, sf, "po_line").where("supplier_code is not null").groupBy("supplier_code").agg(F.round(F.sum("total_ex_tax"), 2).alias("amount"))
    return s.select(masked_secret(F.col("supplier_code"), 3).alias("supplier"), money_text(F.col("amount")).alias("amount"))


def text_price_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per text with amounts: their number, mean, least and greatest, by how much the mean is above the least, and whether by 20 %."""
    d = table(spark, sf, "documents").select("doc_id", "text").distinct().withColumn("s", price_stats(prices_in_text(F.col("text")))).where("s.n > 0")
    above = F.round(pct_change(F.col("s.low"), F.col("s.mean")), 6)
    return d.select("doc_id", "s.n", F.round("s.mean", 6).alias("mean"), "s.low", "s.high", above.alias("pct"), (above >= 20).alias("flag"))


def _whole(c: str) -> Column:
    """A number in hundredths, so that it prints the same everywhere; null is an empty cell."""
    return F.coalesce(F.floor(F.col(c) * 100).cast("long").cast("string"), F.lit(""))


def _quote_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase line as a quote of its own, by pipes, tabs, commas, wide spaces with a header, or single spaces without; empty cells only where they can stand."""
    lines = table(spark, sf, "po_line").where("mat_code is not null").select("row_id", "mat_code", "qty", "price_ex_tax", "total_ex_tax").distinct()
    cells = [F.col("mat_code"), F.lit("个"), *map(_whole, ("qty", "price_ex_tax", "total_ex_tax"))]
    whole = F.col("qty").isNotNull() & F.col("price_ex_tax").isNotNull() & F.col("total_ex_tax").isNotNull()
    kind = F.when(whole, F.col("row_id") % 5).otherwise(F.col("row_id") % 2)
    head = ["名称", "单位", "工程量", "单价(元)", "合价"]
    by = lambda sep, first="", last="": F.concat(F.lit(first + sep.join(head) + last + "\n"), F.lit(first), F.concat_ws(sep, *cells), F.lit(last))
    text = F.when(kind == 0, by(" | ", "| ", " |")).when(kind == 1, by("\t")).when(kind == 2, by("，")).when(kind == 3, by("   ")).otherwise(F.concat(F.lit("---\n12 "), F.concat_ws(" ", *cells)))
    return lines.select("row_id", text.alias("text"))


def mixed_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of quotes in five layouts."""
    return _quote_texts(spark, sf).lateralJoin(TableRows(F.col("text").outer())).select("row_id", "line", "name", "unit", "qty", "price", "amount")


#: Keys under which an item may state each field, the first that is there counts. Fixed values.
ITEM_KEYS = {"name": ("name", "项目名称", "名称", "item"), "qty": ("qty", "quantity", "数量"), "price": ("price", "unitPrice", "单价"), "amount": ("amount", "total", "合价")}


def read_items(rows: DataFrame, item: Column, position: Column) -> DataFrame:
    """``rows`` with name, qty, price and amount of a quote's item in JSON; items that state neither name nor number are left out.

    An item without name is called by its position; a field that is no number is null.
    """
    # Both explodes are barriers: the JSON is read once, and each text is one column when its number is parsed.
    read = rows.select("*", position.cast("string").alias("__at"), F.explode(F.array(F.from_json(item, "map<string,string>"))).alias("__m"))
    texts = F.struct(*[F.coalesce(*[F.col("__m")[k] for k in keys]).alias(field) for field, keys in ITEM_KEYS.items()])
    read = read.select("*", F.explode(F.array(texts)).alias("__t")).drop("__m")
    name = F.trim(F.coalesce("__t.name", F.lit("")))
    numbers = {field: parse_number(F.col(f"__t.{field}")) for field in ("qty", "price", "amount")}
    read = read.withColumns({"name": name, **numbers}).where((F.col("name") != "") | F.coalesce("qty", "price", "amount").isNotNull())
    return read.withColumn("name", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("第"), "__at", F.lit("项")))).drop("__at", "__t")


def quote_items(spark: SparkSession, sf: str) -> DataFrame:
    """Purchase lines as items of structured quotes under changing keys, read back."""
    lines = table(spark, sf, "po_line").select("row_id", "mat_code", *[F.floor(F.col(c) * 100).cast("long").alias(c) for c in ("qty", "price_ex_tax", "total_ex_tax")]).distinct()
    names = [("name", "qty", "price", "amount"), ("项目名称", "quantity", "unitPrice", "total"), ("item", "数量", "单价", "合价")]
    values = ("mat_code", "qty", "price_ex_tax", "total_ex_tax")
    as_json = [F.to_json(F.struct(*[F.col(v).alias(k) for v, k in zip(values, keys)])) for keys in names]
    item = F.when(F.col("row_id") % 3 == 0, as_json[0]).when(F.col("row_id") % 3 == 1, as_json[1]).otherwise(as_json[2])
    return read_items(lines.select("row_id", item.alias("item")), F.col("item"), F.lit(1)).select("row_id", "name", "qty", "price", "amount")


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Stock counts of whole numbers, by tabs, commas or spaces, with a misstated difference amount in every seventh row and a misstated opening total in every third sheet."""
    s = table(spark, sf, "available_stock").where(~is_blank(F.col("material_id")) & F.col("plant_no").isNotNull())
    s = s.select("row_id", F.concat("plant_no", F.lit("/"), F.substring("material_id", 1, 8)).alias("sheet"), "material_id", F.floor("available_qty").cast("long").alias("q")).distinct()
    diff = F.pmod(F.col("row_id"), F.lit(4)) - 1
    wrong = F.when(F.col("row_id") % 7 == 0, 5).otherwise(0)
    cells = F.array("material_id", F.lit("x"), F.lit("A1"), F.coalesce(F.col("q").cast("string"), F.lit("-")), diff.cast("string"), F.lit("20"), (diff * 20 + wrong).cast("string"))
    rows = s.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row_id", cells.alias("c")))).alias("r"), F.coalesce(F.sum("q"), F.lit(0)).alias("opening"))
    kind = F.pmod(F.crc32("sheet"), F.lit(3))
    sep = F.when(kind == 0, "\t").when(kind == 1, ",").otherwise(" ")
    head = F.array(*map(F.lit, ["物料编码", "名称", "库位", "期初数量", "差异数量", "单价", "差异金额"]))
    total = F.array(F.lit("合计"), F.lit("x"), F.lit("A1"), (F.col("opening") + F.when(kind == 0, 3).otherwise(0)).cast("string"))
    line = lambda cells: F.call_function("array_join", cells, sep)
    body = F.transform("r", lambda x: line(x["c"]))
    return rows.select("sheet", F.concat_ws("\n", F.lit("盘点表"), line(head), F.array_join(body, "\n"), line(total)).alias("text"))


def sheet_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of pasted stock counts, in the order of sheet, line and category: difference amounts that do not follow from quantity and price, totals that differ from the sum of known cells."""
    rows = _sheets(spark, sf).lateralJoin(StockRows(F.col("text").outer()))
    items = rows.where("not is_total").withColumn("place", F.concat_ws("#", "sheet", F.lpad(F.col("line").cast("string"), 6, "0")))
    wrong = row_findings(items, row=F.col("place"), required=[], equations=[("difference amount", F.col("diff_qty") * F.col("price"), F.col("diff_amount"), 0.01)])
    wrong = wrong.select(F.split("row_ref", "#")[0].alias("sheet"), F.split("row_ref", "#")[1].cast("int").alias("line"), "category")
    totals = totals_check_by(items, rows.where("is_total"), ["sheet"], ["opening", "diff_amount"], line="line")
    both = wrong.unionByName(totals.select("sheet", "line", F.concat(F.lit("total of "), F.col("column")).alias("category")))
    return both.orderBy("sheet", "line", "category")


_T = f"DATE '{spend.TODAY}'"
_L = f"(SELECT *, coalesce({duck_day('order_time')}, {duck_day('create_time')}) AS day FROM po_line)"
_WIDE = f"translate(coalesce({{c}}, ''), '{WIDE}', '{NARROW}')"


def _pack_sql() -> str:
    cases = []
    for source, c in (("desc", "d"), ("name", "n")):
        for pattern, q, k in PATTERNS:
            p = pattern.replace("\\", "\\")
            cases.append(f"WHEN try_cast(regexp_extract({c}, '{p}', {q}) AS DOUBLE) >= 2 THEN {{{{'qty': CAST(regexp_extract({c}, '{p}', {q}) AS DOUBLE), 'container': regexp_extract({c}, '{p}', {k}), 'source': '{source}', 'confidence': 'high'}}}}")
    for source, c in (("desc", "d"), ("name", "n")):
        at = f"list_min(list_transform(regexp_extract_all({c}, '{BARE}', 1), lambda x: strpos('{CONTAINERS}', x)))"
        cases.append(f"WHEN {at} IS NOT NULL THEN {{{{'qty': NULL, 'container': substr('{CONTAINERS}', {at}, 1), 'source': '{source}', 'confidence': 'low'}}}}")
    body = " ".join(cases).replace("{{", "{").replace("}}", "}")
    return f"""WITH m AS (SELECT DISTINCT code, {_WIDE.format(c='mat_desc')} AS d, {_WIDE.format(c='name')} AS n FROM material), s AS (SELECT code, CASE {body} END AS s FROM m)
      SELECT DISTINCT code, s.qty AS qty, s.container AS container, s.source AS source, s.confidence AS confidence FROM s WHERE s IS NOT NULL"""


_STOCK = "(SELECT DISTINCT row_id, plant_no || '/' || left(material_id, 8) AS sheet, material_id, CAST(floor(available_qty) AS BIGINT) AS q FROM available_stock WHERE trim(coalesce(material_id, '')) <> '' AND plant_no IS NOT NULL)"
_CENTS = "CAST(floor({c} * 100) AS BIGINT)"
SQL = {
    "wide_spreads": f"SELECT count(*) AS n, count(*) FILTER (spread_pct >= 20) AS at_least_20, count(*) FILTER (spread_pct >= 50) AS at_least_50 FROM ({spend.SQL['price_spread']})",
    "frequent_materials": "SELECT mat_code, count(*) AS n, round(sum(total_ex_tax), 2) AS amount FROM po_line WHERE total_ex_tax > 0 AND mat_code IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY amount DESC, mat_code LIMIT 100",
    "numbered_lines": f"SELECT row_id, mat_code, row_number() OVER (PARTITION BY mat_code ORDER BY day NULLS FIRST, row_id) AS n FROM (SELECT DISTINCT row_id, mat_code, day FROM {_L} WHERE mat_code IS NOT NULL)",
    "pack_specs": _pack_sql(),
    "piece_materials": "SELECT material_id FROM (SELECT material_id, material_unit AS u FROM info_record WHERE trim(coalesce(material_id, '')) <> '' QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY landed_at NULLS FIRST, record_id NULLS FIRST, material_unit NULLS FIRST) = 1) WHERE upper(trim(u)) = 'PCS'",
    "quantity_columns": "SELECT * FROM (VALUES ('po_line', 'qty'), ('available_stock', 'available_qty'), ('lineitem', 'l_quantity')) t(table_name, column_name)",
    "id_chunks": "WITH i AS (SELECT material_id, (row_number() OVER (ORDER BY material_id) - 1) // 80 + 1 AS chunk FROM (SELECT DISTINCT material_id FROM available_stock WHERE material_id IS NOT NULL)) SELECT chunk, count(*) AS n, min(material_id) AS first_id, max(material_id) AS last_id FROM i GROUP BY 1",
    "last_year_lines": f"SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, round(sum(total_ex_tax), 2) AS amount FROM {_L} WHERE total_ex_tax > 0 AND day >= {_T} - INTERVAL 12 MONTH AND day < {_T} GROUP BY 1",
    "component_prices": r"""SELECT DISTINCT code, p AS price FROM (SELECT code, lower(concat_ws(' ', name, mat_desc)) AS t, try_cast(regexp_replace(translate(price, '０１２３４５６７８９／－．，：＋￥　', '0123456789/-.,:+¥ '), '[¥$€元,\s]', '', 'g') AS DOUBLE) AS p FROM material)
      WHERE p > 0 AND (contains(t, '断路器') OR contains(t, '端子') OR contains(t, '电缆') OR contains(t, 'led') OR contains(t, 'cable'))""",
    "unreadable_prices": rf"""SELECT DISTINCT code, 'price' AS "column", state FROM (SELECT code, CASE WHEN {unfilled('price')} THEN 'blank'
      WHEN NOT regexp_full_match(regexp_replace(regexp_replace(translate(price, '０１２３４５６７８９／－．，：＋￥　', '0123456789/-.,:+¥ '), '[¥$€元,\s]', '', 'g'), '^\((.*)\)$', '-\1'), '[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?') THEN 'unparseable' END AS state FROM material) WHERE state IS NOT NULL""",
    "sole_source_spend": "SELECT material_id, min(supplier_code) AS supplier_code, round(sum(total_ex_tax), 2) AS spend FROM po_line WHERE trim(coalesce(supplier_code, '')) <> '' AND material_id IS NOT NULL AND total_ex_tax > 0 GROUP BY 1 HAVING count(DISTINCT supplier_code) = 1",
    "company_names": "SELECT supplier_code, trim(replace(replace(replace(replace(replace(replace(trim(coalesce(supplier_name, '')), '有限公司', ''), '(中国)', ''), '股份', ''), '有限责任公司', ''), '集团', ''), '公司', '')) AS short_name FROM supplier_ref",
    "masked_spend": """SELECT CASE WHEN length(supplier_code) > 6 THEN repeat('*', length(supplier_code) - 3) || right(supplier_code, 3) ELSE repeat('*', length(supplier_code)) END AS supplier,
      coalesce(format('{:,.2f}', round(sum(total_ex_tax), 2)), '—') AS amount FROM po_line WHERE supplier_code IS NOT NULL GROUP BY supplier_code""",
    "text_price_stats": r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*(?:元|块|¥|￥)', 1), lambda x: CAST(x AS DOUBLE)) AS p FROM d),
      s AS (SELECT doc_id, CAST(len(p) AS INT) AS n, list_sum(p) / len(p) AS m, list_min(p) AS low, list_max(p) AS high FROM p WHERE len(p) > 0), q AS (SELECT *, round(CASE WHEN low > 0 THEN (m - low) / low * 100 ELSE 0 END, 6) AS pct FROM s)
      SELECT doc_id, n, round(m, 6) AS mean, low, high, pct, pct >= 20 AS flag FROM q""",
    "mixed_quotes": f"""WITH l AS (SELECT DISTINCT row_id, mat_code, qty, price_ex_tax AS p, total_ex_tax AS t FROM po_line WHERE mat_code IS NOT NULL)
      SELECT row_id, 2 AS line, mat_code AS name, '个' AS unit, CAST({_CENTS.format(c='qty')} AS DOUBLE) AS qty, CAST({_CENTS.format(c='p')} AS DOUBLE) AS price, CAST({_CENTS.format(c='t')} AS DOUBLE) AS amount FROM l WHERE coalesce(qty, p, t) IS NOT NULL""",
    "quote_items": f"""WITH l AS (SELECT DISTINCT row_id, mat_code, {_CENTS.format(c='qty')} AS q, {_CENTS.format(c='price_ex_tax')} AS p, {_CENTS.format(c='total_ex_tax')} AS t FROM po_line)
      SELECT row_id, coalesce(nullif(trim(mat_code), ''), '第1项') AS name, CAST(q AS DOUBLE) AS qty, CAST(p AS DOUBLE) AS price, CAST(t AS DOUBLE) AS amount FROM l WHERE trim(coalesce(mat_code, '')) <> '' OR coalesce(q, p, t) IS NOT NULL""",
    # Which sheets misstate their total follows from a checksum that DuckDB lacks, so this one is tested on a fixture.
}
QUERIES = {f.__name__: f for f in (wide_spreads, frequent_materials, numbered_lines, pack_specs, piece_materials, quantity_columns, id_chunks, last_year_lines, component_prices, unreadable_prices, sole_source_spend, company_names, masked_spend, text_price_stats, mixed_quotes, quote_items, sheet_findings)}
