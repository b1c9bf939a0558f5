"""Reference outcomes of the relational operators, on small fixtures with nulls, ties and repeats."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.numbers import first_number, open_quantity, parse_number, pct_change, price_in_text, round2, strict_number
from plumbline.functions import records
from plumbline.functions.dates import zone_millis
from plumbline.functions.register import register
from plumbline.functions.tables import amount, header_of, parse_stock, parse_table, role_of, split_row, tail_numbers
from plumbline.functions.text import bare_form, first_match, keyword_flag, labelled, labelled_counts, named_value, number_set, plain_form
from plumbline.operators import aggregates as A
from plumbline.operators import checks as C
from plumbline.operators import rules as R
from plumbline.operators import sets as S
from plumbline.operators import windows as W
from plumbline.operators.joins import block_classes, first_filled, first_per_key, full_diff, longer_list, lookup_code, orphan_join, recomputed, with_lines


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_orphan_join(spark):
    a = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3), (None, 4), ("m1", 5)], "material_id string, amt int")
    b = spark.createDataFrame([("m1", "old", 1), ("m1", "new", 2), (None, "null", 1)], "material_id string, name string, o int")
    c = spark.createDataFrame([("m1", 9, 1), ("m2", None, 1)], "material_id string, amt int, o int")
    got = sorted(values(orphan_join(a, (b, ["o"]), on="material_id"), "amt", "name", "_orphan"))
    assert got == [(1, "new", False), (2, None, True), (3, None, True), (4, "null", False), (5, "new", False)]
    got = {r.name: r for r in orphan_join(a.where("amt < 3"), (b, ["o"]), (c, ["o"]), on="material_id").collect()}
    assert got["new"].amt == 9 and not got["new"]._orphan and got[None].amt is None and got[None]._orphan
    assert orphan_join(a.limit(0), (b, ["o"]), on="material_id").count() == 0
    assert orphan_join(a, (b.limit(0), ["o"]), on="material_id").where("_orphan").count() == 5


def test_dedup(spark):
    rows = spark.createDataFrame([("m1", "p1", 1), ("m1", "p1", 2), ("m1", "p2", 3), (None, "p1", 4), (None, "p1", 5)], "material_id string, plant_no string, v int")
    assert sorted(values(first_per_key(rows, ["material_id", "plant_no"], ["v"]), "v")) == [(1,), (3,), (4,)]
    assert sorted(values(W.merge_last(rows, ["material_id", "plant_no"], "v"), "v", "first_position")) == [(2, 1), (3, 3), (5, 4)]
    assert sorted(values(W.repeats_of_first(rows, F.col("material_id"), "v"), "v", "first_seen")) == [(2, 1), (3, 1)]


def test_sole_source(spark):
    lines = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("b", "s1"), ("b", "s2"), ("c", None)], "material_id string, supplier_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "material_id string")
    got = {r.material_id: (r.n_sources, r.sole_source, r.no_source, r.sources) for r in A.source_state(ids, lines, id="material_id", source="supplier_id").collect()}
    assert got == {"a": (1, True, False, "s1"), "b": (2, False, False, "s1|s2"), "c": (0, False, True, ""), "d": (0, False, True, "")}


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("1234",), ("12,34",), ("约3.256万元",), ("x",), (None,), ("(5)",)], "s string")
    got = values(df, strict_number(F.col("s")), first_number(F.col("s")), parse_number(F.col("s")))
    assert [g[0] for g in got] == [1234.5, 1234.0, None, None, None, None, None]
    assert [g[1] for g in got] == [1234.5, 1234.0, 1234.0, 32560.0, None, None, 5.0]
    assert got[6][2] == -5.0
    q = spark.createDataFrame([(None, 10.0, 3.0), (0.0, 10.0, 3.0), (None, 3.0, 10.0), (None, 5.0, None), (None, None, 1.0)], "k double, o double, d double")
    assert [r[0] for r in values(q, open_quantity(F.col("k"), F.col("o"), F.col("d")))] == [7.0, 0.0, 0.0, 5.0, None]
    one = spark.range(1)
    assert values(one, round2(F.lit(2.675)), pct_change(F.lit(0.0), F.lit(5.0)), pct_change(F.lit(4.0), F.lit(5.0)), price_in_text(F.lit("报价 12.5 元/个")))[0] == (pytest.approx(2.68), 0.0, 25.0, 12.5)


def test_text_forms(spark):
    df = spark.createDataFrame([(" Ａ型（M8，×2） 2.5 mm ",), (None,)], "s string")
    assert [r[0] for r in values(df, plain_form(F.col("s")))] == ["ａ型(m8,x2) 2.5 mm", ""]
    assert [r[0] for r in values(df, bare_form(F.col("s")))] == ["ａ型m8x22DOT5mm", ""]
    assert values(df, number_set(F.col("s")))[0][0] == ["2", "2.5", "8"]
    t = spark.createDataFrame([("法定代表人：  王 五\n数量: 12 单号（3）",)], "s string")
    assert values(t, labelled(F.col("s"), "法定代表人"), labelled_counts(F.col("s"), ["数量", "单号", "无"]))[0] == ("王 五", {"数量": 12, "单号": 3})
    assert values(t, first_match([(F.lit("PR1x"), r"(PR[0-9]{2})"), (F.col("s"), r"(\d\d)")]), keyword_flag(F.col("s"), ["数量"], ["单号"]), keyword_flag(F.col("s"), ["数量"], []))[0] == ("12", False, True)
    form = F.array(F.struct(F.lit("a").alias("name"), F.lit("1").alias("value")))
    assert values(spark.range(1), named_value(form, "a"), named_value(form, "b"))[0] == ("1", None)


def test_lookup_and_lines(spark):
    codes = spark.createDataFrame([("CNY", "CNY", "156"), ("USD", "USD", "840")], "currency_code string, iso string, no string")
    df = spark.createDataFrame([("156",), ("CNY",), ("xx",), (None,), ("",)], "c string")
    assert sorted(values(lookup_code(df, "c", codes, names=["currency_code", "iso", "no"], target="currency_code"), "c"), key=str) == [("",), ("CNY",), ("CNY",), ("xx",), (None,)]
    h = spark.createDataFrame([("1",), ("2",)], "id string")
    lines = spark.createDataFrame([("1", "b"), ("1", "a"), (None, "c")], "po_id string, m string")
    assert {r.id: [x.m for x in r["items"]] for r in with_lines(h, lines, header_id="id", line_ref="po_id").collect()} == {"1": ["a", "b"], "2": []}


def test_pairs_and_runs(spark):
    m = spark.createDataFrame([("1", "x", "d"), ("2", "x", "d"), ("3", "x", "e"), ("4", "y", "d"), ("5", None, "d"), ("2", "x", "d")], "code string, name string, dsc string")
    assert sorted(values(block_classes(m, block=[F.col("name"), F.col("dsc")], key="code"), "key", "class_key", "n_links")) == [("1", "1", 1), ("2", "1", 1)]
    assert sorted(values(block_classes(m, block=[F.col("dsc")], key="code", differ=F.coalesce("name", F.lit(""))), "key", "class_key", "n_links")) == [("1", "1", 2), ("2", "1", 2), ("4", "1", 3), ("5", "1", 3)]
    assert block_classes(m.limit(0), block=[F.col("dsc")], key="code").count() == 0
    assert sorted(values(W.greedy_pairs(m.distinct(), [[F.col("name")], [F.col("dsc")]], key="code"), "key_a", "key_b", "pass")) == [("1", "2", 1), ("4", "5", 2)]
    a, b = spark.createDataFrame([("p",), ("q",)], "k string"), spark.createDataFrame([("q",), ("r",)], "k string")
    assert dict(values(full_diff(a, b, ["k"]), "k", "state")) == {"p": "resolved", "q": "unresolved", "r": "added"}
    x = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    y = spark.createDataFrame([("a", 1.005), ("b", 3.0), ("c", 1.0)], "k string, v double")
    assert dict(values(recomputed(x, y, ["k"], "v"), "k", "agrees")) == {"a": True, "b": False, "c": False}
    p = spark.createDataFrame([(i,) for i in range(12)], "i int")
    assert values(W.pair_labels(p, [F.col("i")]).where("n = 3"), "label_a", "label_b") == [("A-3", "B-3")]


def test_sections_and_shares(spark):
    df = spark.createDataFrame([("s", i) for i in range(5)] + [("t", 1)], "section string, v int")
    got = values(W.capped_sections(df, "section", [F.col("v").desc()], 2), "section", "v", "position", "n_more")
    assert sorted(got) == [("s", 3, 2, 3), ("s", 4, 1, 3), ("t", 1, 1, 0)]
    r = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 20.0)], "k string, amount double")
    assert [(x.k, x.running_pct, x["rank"]) for x in A.running_share(r, amount="amount", key="k").orderBy("rank").collect()] == [("a", 50.0, 1), ("b", 80.0, 2), ("c", 100.0, 3)]
    part = spark.createDataFrame([(3,), (3,)], "n int"), spark.createDataFrame([(3,), (None,)], "n int")
    assert [p.agg(A.total_or_null(F.col("n"))).head()[0] for p in part] == [6, None]


def test_sets(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    got = values(one, S.requested_and_found(arr("c", "a", "b"), arr("b", "c")), S.requested_and_found(arr("a"), arr("a")), S.symmetric_difference(arr("a", "b"), arr("b", "c")), S.clean_values(F.array(F.lit(""), F.lit("x"), F.lit("undefined"), F.lit(None))), S.character_overlap(F.lit("铜排甲"), F.lit("铜排")), S.character_overlap(F.lit("abc"), F.lit("铜")))[0]
    assert got == (["c", "b"], None, ["a", "c"], ["x"], 1.0, None)
    assert first_and_longer(spark) == [("b", ["1", "2"])]


def first_and_longer(spark):
    df = spark.createDataFrame([("", "b", ["1"], ["1", "2"])], "x string, y string, p array<string>, q array<string>")
    return values(df, first_filled(F.col("x"), F.col("y")), longer_list(F.col("p"), F.col("q")))


def test_checks(spark):
    rows = spark.createDataFrame([(1, 50.0, 400.0, 19000.0), (2, None, 3.0, 9.0), (3, 2.0, 3.0, 6.0)], "line int, qty double, price double, amount double")
    f = C.row_findings(rows, row=F.col("line"), required=["qty", "price", "amount"], equations=[("amount", F.col("qty") * F.col("price"), F.col("amount"), 0.01)])
    assert sorted(values(f, "level", "category", "row_ref")) == [("P0", "amount", "1"), ("P1", "missing", "2")]
    assert values(C.summary(f), "p0", "p1", "verdict") == [(1, 1, "mismatch")]
    assert values(C.summary(f.limit(0)), "verdict") == [("consistent",)]
    t = spark.createDataFrame([(52.0, 6.0)], "qty double, price double")
    assert values(C.totals_check(rows.where("line <> 2"), t, ["qty", "price"]), "column", "summed") == [("price", 403.0)]
    assert C.totals_check(rows, t.select("qty"), ["qty"]).count() == 0


def test_rules(spark):
    df = spark.createDataFrame([("M8 红 内", "M10 红 外", "x", ""), ("M8 红", "M8 黑", "x", "y"), ("M8", "M8", "x", "x"), (None, "a", None, None)], "a string, b string, ma string, mb string")
    a, b = F.col("a"), F.col("b")
    chain = [("maker missing", R.one_side_empty(F.col("ma"), F.col("mb"))), ("alias", R.both_differ(F.col("ma"), F.col("mb"), [("x", "y")])), ("colour", R.word_sets_differ(a, b, ["红", "黑"])), ("inner", R.opposed(a, b, "内", "外")), ("thread", R.tokens_differ(a, b, r"M(\d+)")), ("only", R.one_side_only(a, b, ["屏蔽"]))]
    assert [r[0] for r in values(df, R.first_reason(chain))] == ["maker missing", "colour", None, None]
    assert [r[0] for r in values(df, R.first_reason(chain[3:]))] == ["inner", None, None, None]
    assert values(df.limit(3), R.similarity(a, b))[2][0] == 1.0


def test_tables():
    assert split_row("| a | | b |") == ["a", "", "b"] and split_row("a\tb\t") == ["a", "b"] and split_row("a,1,234,b") == ["a", "1,234", "b"] and split_row("a  b c") == ["a", "b c"] and split_row("a b") == ["a", "b"] and split_row(" ") == []
    assert header_of(["名称", "单价（元）", "数量"]) == {"name": 0, "price": 1, "qty": 2} and header_of(["名称", "数量"]) is None
    assert tail_numbers(["1.", "bolt", "个", "50", "2.5", "125"]) == {"name": "bolt", "unit": "个", "qty": 50.0, "price": 2.5, "amount": 125.0} and tail_numbers(["x", "1"]) is None
    text = "名称\t单位\t数量\t单价\t金额\nbolt\t个\t50\t400\t19,000\n\n合计\t19000\nnut\t\t\t3\t9\n"
    assert list(parse_table(text)) == [(2, "bolt", "个", 50.0, 400.0, 19000.0), (5, "nut", "", None, 3.0, 9.0)]
    assert list(parse_table(None)) == [] and list(parse_table("bolt 个 2 3 6")) == [(1, "bolt", "个", 2.0, 3.0, 6.0)]


def test_stock_counts():
    text = "盘点\n编码\t名称\t期初\t入库\t出库\t账面\t实盘\t差异\t单价\t差异金额\nA\tx\t100\t50\t30\t120\t118\t(2)\t¥25\t-50\n合计\t\t100\n"
    rows = list(parse_stock(text))
    assert rows[0] == (3, False, "A", "x", 100.0, 50.0, 30.0, 120.0, 118.0, -2.0, 25.0, None, -50.0) and rows[1][:2] == (4, True)
    assert role_of("入库金额") == "in_amount" and role_of("?") is None and amount("1,234元") == 1234.0 and amount("x") is None and list(parse_stock(None)) == []


def test_records(spark):
    df = spark.createDataFrame([("原告甲公司 （2024）京01民终123号、(2023)沪02执45号 （2024）京01民终123号",), ("被告甲公司",), (None,)], "t string")
    assert values(df, records.case_numbers(F.col("t")))[0][0] == ["（2024）京01民终123号", "(2023)沪02执45号"]
    n = F.get(records.case_numbers(F.col("t")), 0)
    assert values(df.limit(1), records.case_year(n), records.case_kind(n))[0] == (2024, "civil")
    counts = records.role_counts(F.col("t"), F.lit("甲公司"))
    assert tuple(df.agg(*[c.alias(k) for k, c in counts.items()]).head()) == (2, 1, 1)
    assert values(df.limit(1), records.search_keywords(F.lit("甲"), ["诉讼", "判决"]), records.picked_titles(F.lit("2024年年度报告"), "年度报告", "摘要"), records.picked_titles(F.lit("年度报告摘要"), "年度报告", "摘要"))[0] == (["甲", "甲 诉讼", "甲 判决"], True, False)


def test_registered_functions(spark):
    register(spark)
    assert spark.sql("select text_similarity('ab', 'ab') s, to_canonical_unit(2.0, 'ft').value v").head()[:] == (1.0, pytest.approx(0.6096))
    assert spark.sql("select name, qty from table_rows('bolt 个 2 3 6')").head()[:] == ("bolt", 2.0)


def test_wall_clock(spark):
    df = spark.createDataFrame([("2024-01-01 08:00:00",), ("2024-01-01 08:00",), ("1704067200000",), ("x",), (None,)], "s string")
    assert [r[0] for r in values(df, zone_millis(F.col("s")))] == [1704067200000] * 3 + [None, None]
