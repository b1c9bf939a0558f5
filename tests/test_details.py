"""Further reports and the functions under them, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.dates import year_before
from plumbline.functions.packs import pack_spec
from plumbline.functions.tables import parse_stock, parse_table, role_of, split_row, tail_numbers
from plumbline.functions.text import bare_form, company_name, masked_secret, money_text
from plumbline.functions.numbers import first_number, price_stats, prices_in_text
from plumbline.operators import aggregates as A
from plumbline.operators.checks import totals_check, totals_check_by
from plumbline.operators.sets import chunked, quantity_column
from plumbline.operators.windows import numbered_within
from plumbline.plans import details


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_signs_that_tell_sizes_apart(spark):
    df = spark.createDataFrame([("2*40",), ("240",), ("3+1P",), ("31P",), ("2.5",), ("25",), ("a-b_c/d",), (None,)], "s string")
    got = [r[0] for r in one(df, bare_form(F.col("s")))]
    assert got == ["2*40", "240", "3+1p", "31p", "2DOT5", "25", "abcd", ""]


@pytest.mark.parametrize(
    ("desc", "name", "want"),
    [
        ("自锁式尼龙扎带 YM5*300黑（国标）250根/包", "扎带300", (250.0, "包", "desc", "high")), ("某物料 100PCS/包", None, (100.0, "包", "desc", "high")), ("某物料 ５００只／袋", "", (500.0, "袋", "desc", "high")),
        ("螺丝 每盒200个", "X", (200.0, "盒", "desc", "high")), ("1000个一包", None, (1000.0, "包", "desc", "high")), ("黑", "100米/卷", (100.0, "卷", "name", "high")), ("1个/包 元/盒", None, (None, "包", "desc", "low")),
        ("YM5*300黑（国标）", "型材", None), ("长10mm针型端子 0.5mm²", "端子", None), (None, None, None),
    ],
)
def test_pack_spec(spark, desc, name, want):
    df = spark.createDataFrame([(desc, name)], "d string, n string")
    got = one(df, pack_spec(F.col("d"), F.col("n")))[0][0]
    assert (got and tuple(got)) == want


def test_exact_median(spark):
    rows = [("a", v) for v in (3.0, 1.0, 2.0)] + [("b", v) for v in (4.0, 1.0, 1.0, 8.0)] + [("c", None), ("d", 5.0)] + [("e", float(i % 10)) for i in range(1000)]
    got = dict(one(A.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), "k", "median"))
    assert got == {"a": 2.0, "b": 2.5, "d": 5.0, "e": 4.5}
    assert A.exact_median(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_numbered_within_a_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) k", "id").unionByName(spark.range(5).selectExpr("cast(null as string) k", "id"))
    got = {(r.k, r.id): r.n for r in numbered_within(df, ["k"], [F.col("id")]).collect()}
    want = {}
    for k, i in sorted({("hot" if i % 3 == 0 else f"k{i % 7}", i) for i in range(3000)}) + [(None, i) for i in range(5)]:
        want[(k, i)] = 1 + sum(1 for x in want if x[0] == k)
    assert got == want


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (80, [80]), (81, [80, 1]), (160, [80, 80])])
def test_chunks(spark, n, sizes):
    ids = spark.range(n).selectExpr("format_string('%05d', id) i").unionByName(spark.range(1).selectExpr("cast(null as string) i"))
    got = {r.chunk: r.n for r in chunked(ids, "i").groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert got == {i + 1: s for i, s in enumerate(sizes)}


def test_small_values(spark):
    df = spark.createDataFrame([("安陆电气有限公司", "abcdefghij", 1234.5), (" 北集团 ", "abc", None), (None, None, 0.0)], "n string, s string, v double")
    assert one(df, company_name(F.col("n")), masked_secret(F.col("s")), money_text(F.col("v"))) == [("安陆电气", "******ghij", "1,234.50"), ("北", "***", "—"), ("", None, "0.00")]
    assert str(one(spark.range(1), year_before(F.lit("2024-02-29").cast("date")))[0][0]) == "2023-02-28"
    texts = spark.createDataFrame([("报价 3元 或 5.5 块", "1.5万"), ("无", "10万件3"), (None, "2万元")], "t string, m string")
    assert [tuple(r[0]) for r in one(texts, price_stats(prices_in_text(F.col("t"))))] == [(2, 4.25, 3.0, 5.5), (0, None, None, None), (0, None, None, None)]
    assert [r[0] for r in one(texts, first_number(F.col("m")))] == [15000.0, 10.0, 20000.0]
    assert quantity_column(spark.createDataFrame([], "qty string, num int, order_qty double")) == "num" and quantity_column(spark.createDataFrame([], "open_qty double")) == "open_qty" and quantity_column(spark.createDataFrame([], "a int")) is None
    assert [tuple(r) for r in A.counts_above(spark.createDataFrame([(1.0,), (20.0,), (None,), (60.0,)], "v double"), "v", [20, 50]).collect()] == [(4, 2, 1)]


def test_rows_of_quotes():
    assert tail_numbers("M1 8 10 2.5 25".split()) is None and tail_numbers("M1 个 8 10 2.5".split()) == {"name": "M1", "unit": "个", "qty": 8.0, "price": 10.0, "amount": 2.5}
    assert tail_numbers("bolt heavy 2 3".split())["name"] == "bolt heavy" and tail_numbers("bolt heavy 2 3".split())["unit"] is None
    assert split_row("name, spec 3 5", at_least=3) == ["name,", "spec", "3", "5"] and split_row("a,b,c", at_least=3) == ["a", "b", "c"]
    text = "序号|名称|工程量|综合单价（元）|合价\n1|钢筋，HRB400|10|1,000|10,000\n---\n合计面积 3 5\n以下空白\n2|模板||3|\n"
    assert list(parse_table(text)) == [(2, "钢筋，HRB400", None, 10.0, 1000.0, 10000.0), (6, "模板", None, None, 3.0, None)]
    assert list(parse_table("12 bolt 个 2 3 6\nx 1\nbolt 1 2 3 4")) == [(1, "bolt", "个", 2.0, 3.0, 6.0)]


def test_columns_without_a_role():
    assert role_of("入库日期") is None and role_of("仓库名称") is None and role_of("盘点人") is None and role_of("期初数量") == "opening"
    rows = list(parse_stock("物料编码,入库日期,名称,期初数量,差异数量\nA,2024-01-01,x,5,-1\n"))
    assert rows[0][2:5] == ("A", "x", 5.0)


def test_totals(spark):
    rows = spark.createDataFrame([("s", 1.0, 2.0), ("s", 2.0, None), ("t", 1.0, 1.0), ("u", 0.1, 0.2), ("u", 0.2, 0.1)], "k string, a double, b double")
    totals = spark.createDataFrame([("s", 9, 4.0, 9.0), ("s", 10, 3.0, 2.0), ("t", 3, 1.0, None), ("u", 3, 0.3, 0.4)], "k string, line int, a double, b double")
    got = {tuple(r) for r in totals_check_by(rows, totals, ["k"], ["a", "b"], line="line").collect()}
    assert got == {("s", 9, "a", 3.0, 4.0), ("u", 3, "b", 0.3, 0.4)}
    assert [tuple(r) for r in totals_check(rows.where("k = 'u'"), totals.where("k = 'u'"), ["a", "b"]).collect()][0][0] == "b"


def test_items_under_any_key(spark):
    items = ['{"name": "钢筋", "qty": 10, "price": "1,000"}', '{"项目名称": "模板", "quantity": null, "合价": "5元"}', '{"数量": 3}', '{"note": 1}', "[]", "nonsense", None]
    df = spark.createDataFrame(list(enumerate(items, 1)), "n int, j string").withColumn("name", F.lit("clash")).drop("name")
    got = [tuple(r) for r in details.read_items(df, F.col("j"), F.col("n")).orderBy("n").select("n", "name", "qty", "price", "amount").collect()]
    assert got == [(1, "钢筋", 10.0, 1000.0, None), (2, "模板", None, None, 5.0), (3, "第3项", 3.0, None, None)]


def test_sheet_findings(spark, tmp_path):
    rows = [(i, f"MAT00000{i % 3}X", f"p{i // 10 % 4}", float(i) if i % 11 else None) for i in range(60)]
    rows += rows[:5] + [(90, None, "p0", 1.0), (91, "MAT000000X", None, 1.0)]
    spark.createDataFrame(rows, "row_id long, material_id string, plant_no string, available_qty double").write.parquet(f"{tmp_path}/available_stock.parquet")
    got = [tuple(r) for r in details.sheet_findings(spark, str(tmp_path)).collect()]
    import zlib

    sheets = {}
    for r in sorted(set(rows), key=lambda r: r[0]):
        if r[1] and r[2]:
            sheets.setdefault(f"{r[2]}/{r[1][:8]}", []).append(r)
    want = []
    for sheet, lines in sheets.items():
        want += [(sheet, 3 + i, "difference amount") for i, r in enumerate(lines) if r[0] % 7 == 0]
        if zlib.crc32(sheet.encode()) % 3 == 0 and all(r[3] is not None for r in lines):
            want.append((sheet, 3 + len(lines), "total of opening"))
    assert got == sorted(want) and len(want) > 5


def test_blank_or_unparseable(spark):
    from plumbline.functions.numbers import parse_number
    from plumbline.functions.text import is_unfilled
    from plumbline.operators.checks import unreadable_cells

    df = spark.createDataFrame([("a", "1,5", None), ("b", "面议", "x"), ("c", " ", "3天"), ("d", "¥2", "4")], "code string, p string, q string").withColumns({"cell": F.lit(1), "state": F.lit(2)})
    got = {tuple(r) for r in unreadable_cells(df, row="code", columns=["p", "q"], blank=is_unfilled, number=parse_number).collect()}
    assert got == {("a", "q", "blank"), ("b", "p", "blank"), ("b", "q", "unparseable"), ("c", "p", "blank"), ("c", "q", "unparseable")}
