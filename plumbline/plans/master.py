"""Price records and the material master: effective prices, indexes, pairs, runs, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_day
from plumbline.functions.text import bare_form, is_blank, is_unfilled, keyword_flag, number_set, plain_form
from plumbline.operators import aggregates as A
from plumbline.operators import checks as C
from plumbline.operators import rules as R
from plumbline.operators.joins import block_classes, companions, first_filled, first_per_key, full_diff, longer_list, lookup_code, with_lines
from plumbline.operators.sets import character_overlap, clean_values, requested_and_found, symmetric_difference, union_distinct
from plumbline.operators.windows import greedy_pairs, latest_effective, merge_last, pair_labels, repeats_of_first
from plumbline.plans.duck import day as duck_day
from plumbline.session import cut_lineage
from plumbline.sources.tables import table

TODAY = "2025-06-30"
#: Words that select and reject materials in ``keyword_materials``; parameters.
INCLUDE, EXCLUDE = ["铜", "电缆", "kabel"], ["铜接线鼻"]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["record_id", "material_id", "supplier_id", "unit_price", "price_valid_from", "price_valid_to", "created_date", "landed_at"]
    r = table(spark, sf, "info_record").where(~is_blank(F.col("material_id"))).select(*columns).distinct()
    return r.withColumns({"valid_from": parse_day(F.col("price_valid_from")), "valid_to": parse_day(F.col("price_valid_to")), "created": parse_day(F.col("created_date"))})


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    return latest_effective(
        _records(spark, sf), ["material_id", "supplier_id"], price="unit_price", start=F.col("valid_from"), end=F.col("valid_to"), created=F.col("created"), today=F.lit(TODAY).cast("date"), tie="record_id"
    )


def latest_effective_price(spark: SparkSession, sf: str) -> DataFrame:
    return _effective(spark, sf).select("material_id", "supplier_id", "record_id", "unit_price")


def price_index(spark: SparkSession, sf: str) -> DataFrame:
    """Per material: records, effective records, least, exact median and greatest effective price, their ratio, the supplier of the highest."""
    records = _records(spark, sf).groupBy("material_id").agg(F.count("*").alias("n_records"))
    effective = cut_lineage(_effective(spark, sf).select("material_id", "record_id", "unit_price"))
    e = effective.groupBy("material_id").agg(
        F.count("*").alias("n_effective"), F.min("unit_price").alias("low"), F.max("unit_price").alias("high"), F.max_by("record_id", F.struct("unit_price", "record_id")).alias("highest_record")
    )
    e = e.join(A.exact_median(effective, ["material_id"], "unit_price"), "material_id")
    out = records.join(e, "material_id", "left").withColumn("n_effective", F.coalesce("n_effective", F.lit(0)))
    return out.select("material_id", "n_records", "n_effective", "low", F.round("median", 8).alias("median"), "high", F.round(F.try_divide("high", "low"), 8).alias("ratio"), "highest_record")


def no_effective_price(spark: SparkSession, sf: str) -> DataFrame:
    return price_index(spark, sf).where("n_effective = 0").select("material_id", "n_records")


def paid_against_record(spark: SparkSession, sf: str) -> DataFrame:
    """Exact median paid against exact median effective price, where the greater is at least three times the less."""
    lines = table(spark, sf, "po_line").where((F.col("price_ex_tax") > 0) & ~is_blank(F.col("material_id"))).select("material_id", "price_ex_tax", "total_ex_tax")
    spend = lines.groupBy("material_id").agg(F.round(F.sum("total_ex_tax"), 2).alias("spend"))
    paid = A.exact_median(lines, ["material_id"], "price_ex_tax", "paid").join(spend, "material_id")
    listed = A.exact_median(_effective(spark, sf), ["material_id"], "unit_price", "listed")
    both = paid.join(listed, "material_id").withColumn("ratio", F.round(F.greatest("paid", "listed") / F.least("paid", "listed"), 6))
    return both.where("ratio >= 3").select("material_id", F.round("paid", 8).alias("paid"), F.round("listed", 8).alias("listed"), "ratio", "spend", A.banded(F.col("ratio"), [(10, "high"), (3, "medium")]).alias("band"))


def quantity_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Per material: greatest quantity, share of round quantities, whether any is a multiple of 50."""
    q = table(spark, sf, "po_line").where(~is_blank(F.col("material_id")) & (F.col("qty") > 0))
    return q.groupBy("material_id").agg(
        F.max("qty").alias("max_qty"), F.round(F.avg(F.when((F.col("qty") >= 100) & (F.col("qty") % 100 == 0), 1.0).otherwise(0.0)), 8).alias("round_share"), F.bool_or((F.col("qty") >= 50) & (F.col("qty") % 50 == 0)).alias("any_pack")
    )


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first stock row per material and plant, in the order of row numbers."""
    s = table(spark, sf, "available_stock").distinct()
    return first_per_key(s, ["material_id", "plant_no"], ["row_id"]).select("row_id", "material_id", "plant_no", "available_qty")


def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    """The last stock row per material and plant, with the position of the first."""
    s = table(spark, sf, "available_stock").select("row_id", "material_id", "plant_no", "available_qty").distinct()
    return merge_last(s, ["material_id", "plant_no"], "row_id")


def later_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Stock rows whose material and plant occurred before, with the first row."""
    s = table(spark, sf, "available_stock").select("row_id", "material_id", "plant_no").distinct()
    return repeats_of_first(s, F.concat_ws("/", "material_id", "plant_no"), "row_id").select("row_id", "first_seen")


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines as nested items, and what the items say."""
    lines = table(spark, sf, "po_line").select("order_no", "row_id", "line_no", "total_ex_tax").distinct()
    headers = lines.select("order_no").distinct()
    nested = with_lines(headers, lines, header_id="order_no", line_ref="order_no")
    return nested.select("order_no", F.size("items").alias("n_items"), F.array_join(F.transform("items", lambda x: x["line_no"]), ",").alias("line_nos"), F.array_min(F.transform("items", lambda x: x["row_id"])).alias("first_row"))


def unit_names(spark: SparkSession, sf: str) -> DataFrame:
    """Unit codes of materials in one spelling by a code table; unknown and null codes stay."""
    codes = spark.createDataFrame([("PCE", "PCS", "个"), ("KGM", "KG", "公斤"), ("MTR", "M", "米")], "iso string, code string, local string")
    units = companions(table(spark, sf, "info_record").select("record_id", F.col("material_unit").alias("unit_no")).distinct())
    return lookup_code(units, "unit", codes, names=["iso", "code", "local"], target="iso")


def _described(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "material").select("code", "cat", "subcat", "name", "mat_desc", "manufacturer", "unit", "lead_time").distinct()


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised names, and the numbers of name and description."""
    d = _described(spark, sf)
    return d.select("code", plain_form(F.col("name")).alias("plain_name"), F.array_join(number_set(F.concat_ws(" ", "mat_desc", "name")), ",").alias("numbers"))


def bare_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf).select("code", bare_form(F.col("mat_desc")).alias("bare_desc"))


def same_name_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of codes with equal category, name, numbers and bare description: each code's class and number of partners."""
    numbers = F.array_join(number_set(F.concat_ws(" ", "mat_desc", "name")), ",")
    return block_classes(_described(spark, sf), block=[F.col("cat"), F.col("subcat"), plain_form(F.col("name")), bare_form(F.col("mat_desc")), numbers], key="code")


def same_desc_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of codes with equal category and bare description, and of each code how many partners have another name."""
    return block_classes(_described(spark, sf), block=[F.col("cat"), F.col("subcat"), bare_form(F.col("mat_desc"))], key="code", differ=plain_form(F.col("name")))


def same_text_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of codes with equal category and description as written, and of each how many partners have another name."""
    d = _described(spark, sf)
    return block_classes(d, block=[F.col("cat"), F.col("subcat"), F.col("mat_desc")], key="code", differ=F.coalesce("name", F.lit("")))


def one_to_one_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Materials paired by equal name, each once; the rest by equal description."""
    d = _described(spark, sf).groupBy("code").agg(F.min("name").alias("name"), F.min("mat_desc").alias("mat_desc"))
    return greedy_pairs(d, [[F.col("name")], [F.col("mat_desc")]], key="code")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The two rows of each pair as one row."""
    p = table(spark, sf, "dup_pair").where("pair_no is not null")
    side = lambda s: p.where(F.col("mark").startswith(s)).groupBy("pair_no").agg(F.min(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("code", "name", "mat_desc", "cat")])).alias(s.lower()))
    return side("A").join(side("B"), "pair_no")


def pair_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs side by side, numbered, with the fields that differ."""
    fields = ("code", "name", "mat_desc", "cat")
    differing = F.array_compact(F.array(*[F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.lit(f)) for f in fields]))
    return pair_labels(_pairs(spark, sf), [F.col("pair_no")]).select("n", "label_a", "label_b", F.col("a.code").alias("code_a"), F.col("b.code").alias("code_b"), F.array_join(differing, ",").alias("differing"))


def pair_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why the two sides of a pair are not the same thing: the first rule of a chain on their texts."""
    p = _pairs(spark, sf)
    a, b = (F.concat_ws(" ", f"{s}.mat_desc", f"{s}.name") for s in "ab")
    chain = [
        ("code missing", R.one_side_empty(F.col("a.code"), F.col("b.code"))),
        ("category", R.both_differ(F.col("a.cat"), F.col("b.cat"))),
        ("colour", R.word_sets_differ(a, b, ["红", "黑", "白", "黄绿", "灰"])),
        ("thread", R.tokens_differ(a, b, r"M(\d+)")),
        ("size", R.tokens_differ(a, b, r"(\d+[x*]\d+)", ordered=True)),
        ("inner/outer", R.opposed(a, b, "内", "外")),
        ("shielded", R.one_side_only(a, b, ["屏蔽"])),
    ]
    return p.select("pair_no", R.first_reason(chain).alias("reason"))


def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Matching-blocks ratio of the normalised descriptions and overlap of the Chinese characters of the names."""
    p = _pairs(spark, sf)
    return p.select("pair_no", F.round(R.similarity(plain_form(F.col("a.mat_desc")), plain_form(F.col("b.mat_desc"))), 6).alias("ratio"), F.round(character_overlap(F.col("a.name"), F.col("b.name")), 6).alias("overlap"))


def run_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of the first and the last export: resolved, added, unresolved; with their counts."""
    s = table(spark, sf, "material_snapshot").select("snapshot_date", F.upper(F.trim("code")).alias("code"))
    # One row: the days of the first and of the last export.
    ends = F.broadcast(s.agg(F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last")))
    old, new = (s.join(ends.select(F.col(e).alias("snapshot_date")), "snapshot_date", "left_semi") for e in ("first", "last"))
    return full_diff(old, new, ["code"])


def run_diff_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by initial and state, with subtotals of each and of all."""
    d = run_diff(spark, sf).withColumn("initial", F.substring("code", 1, 1))
    return d.rollup("initial", "state").agg(F.count("*").alias("n"))


def all_material_ids(spark: SparkSession, sf: str) -> DataFrame:
    return union_distinct(*[table(spark, sf, n).select("material_id") for n in ("material", "info_record", "po_line", "available_stock")])


def requested_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Of the materials of each order, those that are in stock, in the order of the request; and those of one side only."""
    lines = table(spark, sf, "po_line").groupBy("order_no").agg(F.array_sort(F.collect_set("material_id")).alias("requested"))
    stocked = table(spark, sf, "po_line").join(table(spark, sf, "available_stock").select("material_id").distinct(), "material_id", "left_semi").groupBy("order_no").agg(F.collect_set("material_id").alias("found"))
    both = lines.join(stocked, "order_no", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    r = clean_values(F.col("requested"))
    return both.select("order_no", F.array_join(requested_and_found(r, F.col("found")), ",").alias("matched"), F.array_join(symmetric_difference(r, F.col("found")), ",").alias("one_side"))


def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's material name from the master, else from the line; and the longer of two lists of its units."""
    m = table(spark, sf, "material").groupBy("material_id").agg(F.min("manufacturer").alias("maker"), F.array_sort(F.collect_set("unit")).alias("units"))
    p = table(spark, sf, "po_line").where("material_id is not null").groupBy("material_id").agg(F.min("manufacturer").alias("line_maker"), F.array_sort(F.collect_set("unit")).alias("line_units"))
    return m.join(p, "material_id").select("material_id", first_filled(F.col("maker"), F.col("line_maker")).alias("maker"), F.array_join(longer_list(F.col("units"), F.col("line_units")), ",").alias("units"))


def keyword_materials(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf).select("code", keyword_flag(F.concat_ws(" ", "name", "mat_desc"), INCLUDE, EXCLUDE).alias("wanted"))


def _line_findings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "po_line").select("row_id", "qty", "price_ex_tax", "tax_rate", "total_ex_tax", "total_inc_tax").distinct()
    amount: Column = F.col("qty") * F.col("price_ex_tax")
    taxed: Column = F.col("total_ex_tax") * (1 + F.col("tax_rate"))
    return C.row_findings(lines, row=F.col("row_id"), required=["qty", "price_ex_tax", "total_ex_tax"], equations=[("amount", amount, F.col("total_ex_tax"), 0.05), ("tax", taxed, F.col("total_inc_tax"), 0.05)])


def line_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that lack a number, or whose amounts do not follow from quantity, price and tax."""
    return _line_findings(spark, sf).select("level", "category", "row_ref")


def line_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return C.summary(_line_findings(spark, sf))


def blank_cells(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "material").select("code", "manufacturer", "unit", "lead_time", "price").distinct()
    return C.blank_cells(m, row="code", columns=["manufacturer", "unit", "lead_time", "price"], blank=is_unfilled).distinct()


_R = f"""
WITH r AS (SELECT DISTINCT record_id, material_id, supplier_id, unit_price, landed_at, {duck_day("price_valid_from")} AS f, {duck_day("price_valid_to")} AS t, {duck_day("created_date")} AS c FROM info_record WHERE trim(coalesce(material_id, '')) <> ''),
e AS (SELECT * FROM r WHERE unit_price > 0 AND (f IS NULL OR f <= DATE '{TODAY}') AND (t IS NULL OR t >= DATE '{TODAY}')
  QUALIFY row_number() OVER (PARTITION BY material_id, supplier_id ORDER BY coalesce(c, f, DATE '0001-01-01') DESC, record_id DESC) = 1)
"""
_INDEX = """, i AS (SELECT material_id, count(*) AS n_effective, min(unit_price) AS low, median(unit_price) AS median, max(unit_price) AS high, arg_max(record_id, (unit_price, record_id)) AS highest_record FROM e GROUP BY 1),
n AS (SELECT material_id, count(*) AS n_records FROM r GROUP BY 1)"""
_PLAIN = "translate(trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g')), '（），：×—φø', '(),:x-ΦΦ')"
#: A point between digits is marked first; as every mark needs a digit on both sides, two passes find those that share one.
_BARE = r"regexp_replace(regexp_replace(regexp_replace(" + _PLAIN.format(c="mat_desc") + r", '(\d)\.(\d)', '\1DOT\2', 'g'), '(\d)\.(\d)', '\1DOT\2', 'g'), '[\s\p{Z}\x{1c}-\x{1f}\x{85}\-_/\\(),;:.，：；、。{}\[\]<>]', '', 'g')"
_NUMS = r"list_sort(list_distinct(regexp_extract_all(concat_ws(' ', mat_desc, name), '\d+(?:\.\d+)?')))"

SQL = {
    "latest_effective_price": _R + "SELECT material_id, supplier_id, record_id, unit_price FROM e",
    "price_index": _R + _INDEX + "SELECT material_id, n_records, coalesce(n_effective, 0) AS n_effective, low, round(median, 8) AS median, high, round(high / low, 8) AS ratio, highest_record FROM n LEFT JOIN i USING (material_id)",
    "no_effective_price": _R + _INDEX + "SELECT material_id, n_records FROM n ANTI JOIN i USING (material_id)",
    "paid_against_record": _R + """, p AS (SELECT material_id, median(price_ex_tax) AS paid, round(sum(total_ex_tax), 2) AS spend FROM po_line WHERE price_ex_tax > 0 AND trim(coalesce(material_id, '')) <> '' GROUP BY 1),
      l AS (SELECT material_id, median(unit_price) AS listed FROM e GROUP BY 1), b AS (SELECT *, round(greatest(paid, listed) / least(paid, listed), 6) AS ratio FROM p JOIN l USING (material_id))
      SELECT material_id, round(paid, 8) AS paid, round(listed, 8) AS listed, ratio, spend, CASE WHEN ratio >= 10 THEN 'high' ELSE 'medium' END AS band FROM b WHERE ratio >= 3""",
    "quantity_signal": "SELECT material_id, max(qty) AS max_qty, round(avg(CASE WHEN qty >= 100 AND qty % 100 = 0 THEN 1.0 ELSE 0.0 END), 8) AS round_share, bool_or(qty >= 50 AND qty % 50 = 0) AS any_pack FROM po_line WHERE trim(coalesce(material_id, '')) <> '' AND qty > 0 GROUP BY 1",
    "dedup_first": "SELECT row_id, material_id, plant_no, available_qty FROM (SELECT DISTINCT * FROM available_stock) QUALIFY row_number() OVER (PARTITION BY material_id, plant_no ORDER BY row_id) = 1",
    "dedup_last": "SELECT row_id, material_id, plant_no, available_qty, min(row_id) OVER (PARTITION BY material_id, plant_no) AS first_position FROM (SELECT DISTINCT * FROM available_stock) QUALIFY row_number() OVER (PARTITION BY material_id, plant_no ORDER BY row_id DESC) = 1",
    "later_repeats": "WITH s AS (SELECT DISTINCT row_id, concat_ws('/', material_id, plant_no) AS k FROM available_stock) SELECT row_id, first_seen FROM (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS first_seen FROM s WHERE k <> '') WHERE row_id > first_seen",
    "order_items": "WITH l AS (SELECT DISTINCT order_no, row_id, line_no, total_ex_tax FROM po_line) SELECT order_no, count(row_id) AS n_items, coalesce(string_agg(line_no, ',' ORDER BY row_id), '') AS line_nos, min(row_id) AS first_row FROM l GROUP BY 1",
    "unit_names": "SELECT DISTINCT record_id, material_unit AS unit_no, CASE WHEN material_unit IN ('PCE', 'PCS', '个') THEN 'PCE' WHEN material_unit IN ('KGM', 'KG', '公斤') THEN 'KGM' WHEN material_unit IN ('MTR', 'M', '米') THEN 'MTR' ELSE material_unit END AS unit FROM info_record",
    "one_to_one_pairs": """WITH d AS (SELECT code, min(name) AS name, min(manufacturer) AS manufacturer, min(cat) AS cat FROM (SELECT DISTINCT * FROM material) WHERE subcat IS NOT NULL GROUP BY 1),
      p AS (SELECT code, name, manufacturer, (row_number() OVER (PARTITION BY name, manufacturer ORDER BY code) - 1) // 2 AS g FROM d WHERE name <> '' AND manufacturer <> ''),
      x AS (SELECT min(code) AS key_a, max(code) AS key_b, 1 AS pass FROM p GROUP BY name, manufacturer, g HAVING count(*) = 2),
      q AS (SELECT code, name, cat, (row_number() OVER (PARTITION BY name, cat ORDER BY code) - 1) // 2 AS g FROM d WHERE name <> '' AND cat <> '' AND code NOT IN (SELECT key_a FROM x UNION SELECT key_b FROM x))
      SELECT * FROM x UNION ALL SELECT min(code), max(code), 2 FROM q GROUP BY name, cat, g HAVING count(*) = 2""",
    "same_text_classes": """WITH d AS (SELECT DISTINCT cat, subcat, mat_desc, code, coalesce(name, '') AS v FROM material WHERE cat IS NOT NULL AND subcat IS NOT NULL AND mat_desc IS NOT NULL AND code IS NOT NULL),
      n AS (SELECT code AS key, min(code) OVER b AS class_key, count(*) OVER b - count(*) OVER (PARTITION BY cat, subcat, mat_desc, v) AS n_links FROM d WINDOW b AS (PARTITION BY cat, subcat, mat_desc))
      SELECT DISTINCT key, class_key, n_links FROM n WHERE n_links > 0""",
    "text_forms": f"SELECT DISTINCT code, {_PLAIN.format(c='name')} AS plain_name, array_to_string({_NUMS}, ',') AS numbers FROM (SELECT DISTINCT code, cat, subcat, name, mat_desc, manufacturer, unit, lead_time FROM material)",
    "bare_descriptions": f"SELECT code, {_BARE} AS bare_desc FROM (SELECT DISTINCT code, cat, subcat, name, mat_desc, manufacturer, unit, lead_time FROM material)",
    "same_name_classes": f"""WITH d AS (SELECT DISTINCT code, cat, subcat, {_PLAIN.format(c='name')} AS v, {_BARE} AS t, {_NUMS} AS n FROM material WHERE code IS NOT NULL AND cat IS NOT NULL AND subcat IS NOT NULL)
      SELECT DISTINCT code AS key, min(code) OVER b AS class_key, count(*) OVER b - 1 AS n_links FROM d WINDOW b AS (PARTITION BY cat, subcat, v, t, n) QUALIFY count(*) OVER b > 1""",
    "same_desc_classes": f"""WITH d AS (SELECT DISTINCT code, cat, subcat, {_BARE} AS t, {_PLAIN.format(c='name')} AS v FROM material WHERE cat IS NOT NULL AND subcat IS NOT NULL AND code IS NOT NULL),
      n AS (SELECT code AS key, min(code) OVER b AS class_key, count(*) OVER b - count(*) OVER (PARTITION BY cat, subcat, t, v) AS n_links FROM d WINDOW b AS (PARTITION BY cat, subcat, t))
      SELECT DISTINCT key, class_key, n_links FROM n WHERE n_links > 0""",
    "pair_sheet": """WITH p AS (SELECT pair_no, left(mark, 1) AS s, min((coalesce(code, ''), coalesce(name, ''), coalesce(mat_desc, ''), coalesce(cat, ''))) AS x FROM dup_pair WHERE pair_no IS NOT NULL GROUP BY ALL),
      j AS (SELECT a.pair_no, a.x AS a, b.x AS b, row_number() OVER (ORDER BY a.pair_no) AS n FROM p a JOIN p b ON a.pair_no = b.pair_no AND a.s = 'A' AND b.s = 'B')
      SELECT n, 'A-' || n AS label_a, 'B-' || n AS label_b, a[1] AS code_a, b[1] AS code_b,
        concat_ws(',', CASE WHEN a[1] <> b[1] THEN 'code' END, CASE WHEN a[2] <> b[2] THEN 'name' END, CASE WHEN a[3] <> b[3] THEN 'mat_desc' END, CASE WHEN a[4] <> b[4] THEN 'cat' END) AS differing FROM j""",
    "pair_reasons": r"""WITH p AS (SELECT pair_no, left(mark, 1) AS s, min((coalesce(code, ''), coalesce(name, ''), coalesce(mat_desc, ''), coalesce(cat, ''))) AS x FROM dup_pair WHERE pair_no IS NOT NULL GROUP BY ALL),
      j AS (SELECT a.pair_no, a.x[1] AS ca, b.x[1] AS cb, a.x[4] AS ka, b.x[4] AS kb, a.x[3] || ' ' || a.x[2] AS a, b.x[3] || ' ' || b.x[2] AS b FROM p a JOIN p b ON a.pair_no = b.pair_no AND a.s = 'A' AND b.s = 'B'),
      w AS (SELECT *, list_filter(['红', '黑', '白', '黄绿', '灰'], lambda x: contains(a, x)) AS wa, list_filter(['红', '黑', '白', '黄绿', '灰'], lambda x: contains(b, x)) AS wb,
        list_sort(list_distinct(regexp_extract_all(a, 'M(\d+)', 1))) AS ma, list_sort(list_distinct(regexp_extract_all(b, 'M(\d+)', 1))) AS mb, regexp_extract_all(a, '(\d+[x*]\d+)', 1) AS sa, regexp_extract_all(b, '(\d+[x*]\d+)', 1) AS sb FROM j)
      SELECT pair_no, CASE WHEN (ca = '') <> (cb = '') THEN 'code missing' WHEN ka <> '' AND kb <> '' AND ka <> kb THEN 'category' WHEN len(wa) > 0 AND len(wb) > 0 AND wa <> wb THEN 'colour' WHEN len(ma) > 0 AND len(mb) > 0 AND ma <> mb THEN 'thread'
        WHEN len(sa) > 0 AND len(sb) > 0 AND sa <> sb THEN 'size' WHEN (contains(a, '内') AND contains(b, '外')) OR (contains(a, '外') AND contains(b, '内')) THEN 'inner/outer' WHEN contains(a, '屏蔽') <> contains(b, '屏蔽') THEN 'shielded' END AS reason FROM w""",
    "requested_ids": """WITH r AS (SELECT order_no, list_sort(list(DISTINCT material_id)) AS q FROM po_line WHERE material_id <> '' AND material_id <> 'undefined' GROUP BY 1),
      f AS (SELECT order_no, coalesce(list_sort(list(DISTINCT material_id) FILTER (material_id IN (SELECT material_id FROM available_stock))), []) AS f FROM po_line WHERE material_id <> 'undefined' GROUP BY 1),
      o AS (SELECT DISTINCT order_no FROM po_line), j AS (SELECT o.order_no, coalesce(q, []) AS q, coalesce(f, []) AS f FROM o LEFT JOIN r ON o.order_no IS NOT DISTINCT FROM r.order_no LEFT JOIN f ON o.order_no = f.order_no)
      SELECT order_no, CASE WHEN len(q) >= 2 AND len(list_filter(q, lambda x: list_contains(f, x))) > 0 THEN array_to_string(list_filter(q, lambda x: list_contains(f, x)), ',') END AS matched, array_to_string(list_filter(q, lambda x: NOT list_contains(f, x)), ',') AS one_side FROM j""",
    "merged_records": """WITH m AS (SELECT material_id, min(manufacturer) AS k, coalesce(list_sort(list(DISTINCT unit) FILTER (unit IS NOT NULL)), []) AS u FROM material GROUP BY 1),
      p AS (SELECT material_id, min(manufacturer) AS k, coalesce(list_sort(list(DISTINCT unit) FILTER (unit IS NOT NULL)), []) AS u FROM po_line WHERE material_id IS NOT NULL GROUP BY 1)
      SELECT material_id, coalesce(nullif(m.k, ''), nullif(p.k, '')) AS maker, array_to_string(CASE WHEN len(m.u) >= len(p.u) THEN m.u ELSE p.u END, ',') AS units FROM m JOIN p USING (material_id)""",
    "run_diff": """WITH s AS (SELECT DISTINCT snapshot_date AS d, upper(trim(code)) AS code FROM material_snapshot), o AS (SELECT code FROM s WHERE d = '2026-01-05'), n AS (SELECT code FROM s WHERE d = '2026-03-02')
      SELECT coalesce(o.code, n.code) AS code, CASE WHEN n.code IS NULL THEN 'resolved' WHEN o.code IS NULL THEN 'added' ELSE 'unresolved' END AS state FROM o FULL JOIN n ON o.code = n.code""",
    "all_material_ids": "SELECT material_id FROM material UNION SELECT material_id FROM info_record UNION SELECT material_id FROM po_line UNION SELECT material_id FROM available_stock",
    "keyword_materials": "SELECT code, CASE WHEN contains(t, '铜接线鼻') THEN false ELSE contains(t, '铜') OR contains(t, '电缆') OR contains(t, 'kabel') END AS wanted FROM (SELECT DISTINCT code, lower(concat_ws(' ', name, mat_desc)) AS t, cat, subcat, name, mat_desc, manufacturer, unit, lead_time FROM material)",
    "line_findings": """WITH l AS (SELECT DISTINCT row_id, qty, price_ex_tax, tax_rate, total_ex_tax, total_inc_tax FROM po_line), m AS (SELECT *, qty IS NULL OR price_ex_tax IS NULL OR total_ex_tax IS NULL AS lacks FROM l)
      SELECT 'P1' AS level, 'missing' AS category, row_id::VARCHAR AS row_ref FROM m WHERE lacks UNION ALL SELECT 'P0', 'amount', row_id::VARCHAR FROM m WHERE NOT lacks AND abs(qty * price_ex_tax - total_ex_tax) > 0.05
      UNION ALL SELECT 'P0', 'tax', row_id::VARCHAR FROM m WHERE NOT lacks AND abs(total_ex_tax * (1 + tax_rate) - total_inc_tax) > 0.05""",
    "blank_cells": """SELECT DISTINCT code, "column" FROM (UNPIVOT (SELECT code, coalesce(manufacturer, '') AS manufacturer, coalesce(unit, '') AS unit, coalesce(lead_time, '') AS lead_time, coalesce(price, '') AS price FROM material) ON manufacturer, unit, lead_time, price INTO NAME "column" VALUE v)
      WHERE lower(trim(v)) IN ('', '-', '--', '/', '?', 'n/a', 'tbd', '无', '未知', '待定', '面议')""",
}
SQL["run_diff_totals"] = f"SELECT left(code, 1) AS initial, state, count(*) AS n FROM ({SQL['run_diff']}) GROUP BY ROLLUP (left(code, 1), state)"
SQL["line_verdict"] = f"SELECT count(*) FILTER (level = 'P0') AS p0, count(*) FILTER (level = 'P1') AS p1, 0 AS p2, CASE WHEN count(*) FILTER (level = 'P0') > 0 THEN 'mismatch' WHEN count(*) > 0 THEN 'incomplete' ELSE 'consistent' END AS verdict FROM ({SQL['line_findings']})"

QUERIES = {f.__name__: f for f in (latest_effective_price, price_index, no_effective_price, paid_against_record, quantity_signal, dedup_first, dedup_last, later_repeats, order_items, unit_names, text_forms, bare_descriptions, same_name_classes, same_desc_classes, same_text_classes, one_to_one_pairs, pair_sheet, pair_reasons, pair_similarity, run_diff, run_diff_totals, all_material_ids, requested_ids, merged_records, keyword_materials, line_findings, line_verdict, blank_cells)}
