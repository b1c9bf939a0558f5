"""Units, periods, orphans and snapshots against brute force on small fixtures."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_day, time_of_day
from plumbline.functions.measures import parse_unit, plain, price_basis
from plumbline.functions.numbers import parse_number
from plumbline.functions.text import is_unfilled
from plumbline.operators import orphans
from plumbline.operators.intervals import DisjointIntervals, coverage, price_coverage
from plumbline.operators.orphans import material_orphans, orphan_references, probe
from plumbline.operators.snapshots import material_changes
from plumbline.operators.units import price_per_common_unit, same_price_classes, same_price_pairs, to_canonical

INFO = "record_id long, material_id string, supplier_id string, unit_price double, material_unit string, material_desc string"


def test_parse_day(spark):
    cases = {
        "16.07.2024": "2024-07-16", "2024-7-5": "2024-07-05", "2024/05/03": "2024-05-03", "2024年5月3日": "2024-05-03", "20240503": "2024-05-03",
        "2024-09-07T00:00:00": "2024-09-07", "2024-09-07 08:01:02": "2024-09-07", "45292": "2024-01-01", " 2024-01-02 ": "2024-01-02", "２０２４-０１-０２": "2024-01-02",
        "2023-02-30": None, "31.04.2024": None, "2024-13-01": None, "-": None, "": None, "长期": None, "20241399": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string").select("s", F.date_format(parse_day(F.col("s")), "yyyy-MM-dd").alias("d"))
    assert {r.s: r.d for r in df.collect()} == cases | {None: None}


def test_small_functions(spark):
    df = spark.createDataFrame([("¥1,804.00", "2024-01-02 3:04:05"), ("(5)", "x"), ("０．３７元", None), ("面议", ""), (None, "2024-01-02")], "n string, t string")
    got = df.select(parse_number(F.col("n")).alias("n"), time_of_day(F.col("t")).alias("t"), is_unfilled(F.col("n")).alias("u")).collect()
    assert [r.n for r in got] == [1804.0, -5.0, 0.37, None, None]
    assert [r.t for r in got] == ["03:04:05", "", "", "", ""]
    assert [r.u for r in got] == [False, False, False, True, True]


@pytest.mark.parametrize(
    ("unit", "desc", "scale", "dim"),
    [
        ("PCS", "", 1, 0), ("ＫＰＣＳ", None, 1000, 0), ("打", "500颗/袋", 12, 0), ("千克", "", 1, 2), ("千只", "", 1000, 0), ("百米", "", 100, 1), ("斤", "", 0.5, 2), ("MT", "", 1000, 2),
        ("FT", "", 0.3048, 1), ("箱", "A2-70,100颗/盒", 100, 0), ("BOX", "每盒50片", 50, 0), ("桶", "1桶=2kg", 2, 2), ("卷", "100 m per roll", 100, 1), ("见描述", "按百公斤报价", 100, 2),
        ("EA", "单价为每1000只价", 1000, 0), ("M", "（单价／千米）", 1000, 1), ("-", "price per 1,000 pieces", 1000, 0), ("PCS", "unit price is for dozen", 12, 0), ("", "元/万个", 10000, 0),
        ("kg", "9.2W/m·K", 1, 2), ("个", "200个/包;quoted per bag", 200, 0),
    ],
)
def test_price_basis(unit, desc, scale, dim):
    got = price_basis(unit, desc)
    assert got[0] == pytest.approx(scale) and got[1].index(1) == dim and sum(got[1]) == 1


@pytest.mark.parametrize(("unit", "desc"), [("箱", "4*80 镀锡"), ("", "500颗/袋"), (None, None), ("-", ""), ("见描述", "5kg/桶"), ("?", "W/m·K"), ("m2", "")])
def test_unknown_basis(unit, desc):
    assert price_basis(unit, desc) is None


@pytest.mark.parametrize(
    ("unit", "desc", "scale"),
    [
        ("盒", "x 每盒50片A", 50), ("箱", "20只/箱A", 20), ("箱", "50只一箱A", 50), ("袋", "每包500颗A 计价单位：袋", 500), ("bag", "50 pcs/bagA", 50), ("见描述", "50 pcs per bagA；price per bag", 50), ("盘", "每盘200mA", 200),
        ("箱", "1箱=2盒,1盒=3包,1包=4袋,1袋=5管,1管=6罐,1罐=7片", 5040),
    ],
)
def test_basis_before_a_letter_and_deeply_nested(unit, desc, scale):
    assert price_basis(unit, desc)[0] == pytest.approx(scale)


@pytest.mark.parametrize(("unit", "desc"), [("bag", "50 pcs/baga"), ("bag", "50 pcsa/bag"), ("箱", "1箱=2盒,1盒=3箱")])
def test_longer_words_and_circles_are_no_basis(unit, desc):
    assert price_basis(unit, desc) is None


def test_unit_expressions(spark):
    assert parse_unit("w/m·k").dim == (0, 1, 1, -3, 0, -1)
    assert parse_unit("mm²").scale == pytest.approx(1e-6)
    assert plain("ｍｍ²​") == "mm²"
    df = spark.createDataFrame([(20.0, "℃"), (3.0, "ft"), (1.0, "nonsense"), (None, "m"), (2.0, None)], "v double, u string")
    got = [r.x.value for r in df.select(to_canonical(F.col("v"), F.col("u")).alias("x")).collect()]
    assert got[0] == pytest.approx(293.15) and got[1] == pytest.approx(0.9144) and got[2:] == [None, None, None]


def test_same_prices(spark):
    rows = [
        (1, "M1", "S1", 2.0, "PCS", ""), (2, "M1", "S1", 24.0, "打", ""), (2, "M1", "S1", 24.0, "打", ""), (3, "M1", "S1", 2.0004, "个", ""), (4, "M1", "S1", 24.5, "DZ", ""), (5, "M1", "S2", 24.0, "DZ", ""),
        (6, "M1", "S1", 2000.0, "KG", ""), (7, "M1", "S1", 0.0, "PCS", ""), (8, " ", "S1", 24.0, "DZ", ""), (9, "M1", None, 24.0, "DZ", ""), (10, "M1", "S1", None, "DZ", ""), (11, "M1", "S1", 200.0, "箱", "100只/箱"), (12, "M1", "S1", 200.0, "箱", ""), (None, "M1", "S1", 2.0, "箱", "1箱=1只"),
    ]
    df = spark.createDataFrame(rows, INFO).withColumn("common_unit", F.lit("clash"))
    got = {tuple(r) for r in same_price_pairs(df).collect()}
    assert got == {(1, 2), (1, 11), (2, 3), (2, 11), (3, 11)}
    assert same_price_pairs(df.limit(0)).count() == 0
    assert price_per_common_unit(df).count() == len(rows)
    members, links = same_price_classes(df)
    assert members.count() == 7 and links.count() == 5  # without the records 7 to 10, 12 and the one without id; repeats once


def test_same_prices_brute(spark):
    rnd = random.Random(7)
    units = {"PCS": 1, "DZ": 12, "百个": 100, "KPCS": 1000}
    rows = []
    for i in range(400):
        u = rnd.choice(list(units))
        rows.append((i, f"M{rnd.randint(0, 3)}", "S", rnd.choice([1.0, 1.0005, 1.0011, 1.003, 2.0]) * units[u], u, None))
    near = lambda a, b: abs(a - b) <= 0.001 * max(a, b)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and near(a[3] / units[a[4]], b[3] / units[b[4]]) and not near(a[3], b[3])}
    assert {tuple(r) for r in same_price_pairs(spark.createDataFrame(rows, INFO)).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(-2, 12))))
def test_intervals_by_days(spans):
    state, days = DisjointIntervals(), set()
    for a, n in spans:
        state.insert(a, a + n)
        days |= set(range(a, a + n + 1))
    assert {d for s, e in zip(state.starts, state.ends) for d in range(s, e + 1)} == days
    assert all(e + 1 < s for e, s in zip(state.ends, state.starts[1:]))
    gaps = {d for s, e in state.gaps() for d in range(s, e + 1)}
    assert gaps == (set(range(min(days), max(days) + 1)) - days if days else set())


def test_coverage(spark):
    rows = [("M1", "S1", "2024-01-01", "2024-01-10"), ("M1", "S1", "11.01.2024", "2024/01/20"), ("M1", "S1", "2024-02-01", "长期"), ("M1", "S1", "2024-02-09", "2024-02-01"), ("M1", "S1", "2024-01-01", "2024-01-10"),
            ("M2", "S1", None, "2024-01-01"), ("M2", "S1", "2024-01-03", None), ("M3", "S1", "", ""), (None, "S1", "2024-01-01", "2024-01-01"), ("M1", " ", "2024-01-01", "2024-01-01")]
    df = spark.createDataFrame(rows, "material_id string, supplier_id string, price_valid_from string, price_valid_to string").withColumns({"kind": F.lit(1), "lo": F.lit("x")})
    got = {(r.material_id, r.kind, str(r.first_day), str(r.last_day)) for r in price_coverage(df).collect()}
    assert got == {
        ("M1", "period", "2024-01-01", "2024-01-20"), ("M1", "gap", "2024-01-21", "2024-01-31"), ("M1", "period", "2024-02-01", "None"),
        ("M2", "period", "None", "2024-01-01"), ("M2", "gap", "2024-01-02", "2024-01-02"), ("M2", "period", "2024-01-03", "None"), ("M3", "period", "None", "None"),
    }
    assert price_coverage(df.limit(0)).count() == 0


def test_coverage_of_a_hot_entity(spark):
    df = spark.range(20_000).selectExpr("'k' a", "'s' b", "date_add(date'2000-01-01', cast(pmod(id * 7919, 10000) as int)) f").withColumn("t", F.col("f"))
    df = df.where("f <> date'2005-05-05'")
    got = coverage(df, key1="a", key2="b", start=F.col("f"), end=F.col("t")).where("kind = 'gap'").collect()
    assert [(str(r.first_day), str(r.last_day)) for r in got] == [("2005-05-05", "2005-05-05")]


def test_probe_brute():
    rnd = random.Random(3)
    p = [(rnd.randint(0, 5), a := rnd.randint(0, 50), a + rnd.randint(1, 20)) for _ in range(60)]
    r = [(rnd.randint(0, 6), rnd.randint(0, 80)) for _ in range(500)]
    import numpy as np

    got = probe(*(np.array(x) for x in zip(*p)), *(np.array(x) for x in zip(*r)))
    assert got.tolist() == [any(c == k and s <= t < e for c, s, e in p) for k, t in r]


def test_orphans(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    parents = spark.createDataFrame([("a", d(5), d(10)), ("a", d(12), None), ("a", d(5), d(10)), ("b", d(1), None), ("c", None, None), (None, d(1), None), (" ", d(1), None)], "k string, lo timestamp_ntz, hi timestamp_ntz")
    refs = spark.createDataFrame(
        [("t", 1, "a", d(4)), ("t", 2, "a", d(5)), ("t", 3, "a", d(10)), ("t", 4, "a", d(12)), ("t", 5, "b", d(2)), ("t", 5, "b", d(2)), ("t", 6, "c", d(2)), ("t", 7, "z", d(2)), ("t", 8, None, d(2)), ("t", 9, " ", d(2)), ("t", 10, "b", None)],
        "source string, row_id long, k string, at timestamp_ntz",
    )
    assert sorted(r.row_id for r in orphan_references(parents, refs).collect()) == [1, 3, 6, 7, 10]
    assert orphan_references(parents, refs.limit(0)).count() == 0
    assert orphan_references(parents.limit(0), refs).count() == 9


def test_orphans_with_a_hot_key(spark):
    parents = spark.sql("select 'hot' k, timestamp_ntz'2024-01-02 00:00:00' lo, cast(null as timestamp_ntz) hi union all select concat('k', id), timestamp_ntz'2024-01-01 00:00:00', null from range(50)")
    refs = spark.sql("select 't' source, id row_id, if(id % 3 = 0, 'hot', concat('k', id % 100)) k, timestamp_ntz'2024-01-01 12:00:00' at from range(9000)")
    got = {r.row_id for r in orphan_references(parents, refs).collect()}
    assert got == {i for i in range(9000) if i % 3 == 0 or i % 100 >= 50}


def test_hot_references_are_spread(spark):
    """A key with a third of all references has as many salts as it has shares, and no task more than a few shares."""
    refs = spark.sql("select 't' source, id row_id, if(id % 3 = 0, 'hot', concat('k', id)) k, timestamp_ntz'2024-01-01 12:00:00' at from range(30000)")
    for partitions in (4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            share = 30_000 // (4 * partitions)
            assert [(r.k, r.salts) for r in orphans._hot_keys(refs, 30_000).collect()] == [("hot", -(-10_000 // share))]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    parents = spark.sql("select 'hot' k, timestamp_ntz'2024-01-01 00:00:00' lo, cast(null as timestamp_ntz) hi")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in orphan_references(parents, refs).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        hits = spark.sql("select 'x' source, id row_id, 'none' k, timestamp_ntz'2024-01-01 12:00:00' at from range(30000)")
        hot = [r.n for r in orphan_references(parents, hits).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and sum(hot) == 30_000 and len(hot) == 4 and max(hot) < 12_000


def test_orphan_months(spark):
    t = dt.datetime(2024, 3, 31, 23, 59)
    material = spark.createDataFrame([("a", t, None)], "material_id string, landed_at timestamp_ntz, deleted_at timestamp_ntz")
    lines = spark.createDataFrame([(1, "b", t), (1, "b", t), (2, "a", t)], "row_id long, material_id string, landed_at timestamp_ntz").withColumn("k", F.lit(0))
    assert [tuple(r) for r in material_orphans(material, {"po_line": (lines, "row_id")}).collect()] == [("po_line", "2024-03", 1)]


SNAPSHOT = "snapshot_date string, code string, name string, mat_desc string, cat string, manufacturer string, unit string, lead_time string, price string, modifier string, modify_date string"


def test_snapshots(spark):
    def row(s, code, name="n", price="1.50", modified="2024-01-01", unit=None):
        return (s, code, name, "d", "c", "m", unit, "7", price, "x", modified)

    rows = [
        row("2026-01-01", "a"), row("2026-01-08", " A\t", price="1.5000", unit=""), row("2026-01-20", "A", price="1.6"),
        row("2026-01-01", "B"), row("2026-01-20", "b"),
        row("2026-01-08", "C", name="old", modified="2024/01/01"), row("2026-01-08", "C", name="new", modified="2024/01/02"), row("2026-01-20", "C", name="new"),
        row("2026-01-20", "D"), row("2026-01-20", "D"), row(None, "E"), row("2026-01-20", None), row("2026-01-20", " "),
    ]
    df = spark.createDataFrame(rows, SNAPSHOT).withColumns({"h": F.lit(1), "i": F.lit(2)})
    got = {tuple(r) for r in material_changes(df).collect()}
    assert got == {("2026-01-20", "A", "changed"), ("2026-01-08", "B", "removed"), ("2026-01-20", "B", "added"), ("2026-01-08", "C", "added"), ("2026-01-20", "D", "added")}
    assert material_changes(df.limit(0)).count() == 0
    assert material_changes(df.where("snapshot_date = '2026-01-01'")).count() == 0
