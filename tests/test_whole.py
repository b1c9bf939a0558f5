"""Queries and operators against rows that earlier versions left out."""

import collections

import pytest


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_pasted_tables_hold_every_line(spark, folder):
    from plumbline.plans.texts import pasted_tables

    schema = "order_no string, row_id long, mat_code string, qty double, price_ex_tax double, total_ex_tax double"
    lines = [("o", 1, "a", 2.0, 3.0, 6.0), ("o", 1, "a", 2.0, 3.0, 6.0), ("o", 2, "b", None, 4.0, 8.0), ("o", 3, None, 1.0, 1.0, 1.0), ("o", 4, "c", 0.5, 0.004, 0.002), ("o", 5, "d", 1.0, None, None), ("o", 6, "e", -1.0, 2.0, -2.0), ("p", 7, "f", None, None, None)]
    got = rows_of(pasted_tables(spark, folder(po_line=(lines, schema))))
    want = [("a", 2, 2.0, 3.0, 6.0), ("b", 3, None, 4.0, 8.0), ("c", 5, 0.5, 0.004, 0.002), ("d", 6, 1.0, None, None), ("e", 7, -1.0, 2.0, -2.0)]
    # Line 4 has no name and order p no number: lines, but no rows of a table.
    assert got == collections.Counter(("o", line, name, "个", qty, price, amount) for name, line, qty, price, amount in want)


STOCK = (
    [(1, "M0000001x1", "p", 5.0), (1, "M0000001x1", "p", 5.0), (2, "M0000001x2", "p", -2.5), (3, "M0000001x3", "p", None), (10, "M0000001x4", "p", -1.0), (20, "M0000001x5", None, None), (30, "M0000001x6", None, 4.0), (4, "M0000002x1", "q", None), (5, " ", "p", 1.0)],
    "row_id long, material_id string, plant_no string, available_qty double",
)


def test_stock_counts_hold_every_quantity(spark, folder):
    from plumbline.plans.texts import stock_count_findings, stock_count_totals

    sf = folder(available_stock=STOCK)
    findings = [("P1", "missing", "p/M0000001/M0000001x3"), ("P0", "difference", "p/M0000001/M0000001x4"), ("P1", "missing", "/M0000001/M0000001x5"), ("P0", "difference", "/M0000001/M0000001x6"), ("P1", "missing", "q/M0000002/M0000002x1")]
    assert rows_of(stock_count_findings(spark, sf)) == collections.Counter((*f, 1) for f in findings)
    assert rows_of(stock_count_totals(spark, sf)) == collections.Counter([("p/M0000001", 1.5, 1.5), ("/M0000001", 4.0, 4.0), ("q/M0000002", None, None)])


def test_all_landed_pages_are_read(spark, tmp_path):
    from plumbline.sources.paged import PagedJson, _PageReader

    for n in range(1003):
        (tmp_path / f"page-{n}.json").write_text('{"items": [%s]}' % ("" if n == 1 else n))
    assert len(_PageReader({"path": str(tmp_path)}).partitions()) == 1003
    spark.dataSource.register(PagedJson)
    read = lambda k: [(r.page, r.item, r.truncated) for r in spark.read.format("paged_json").option("maxPages", k).load(str(tmp_path)).orderBy("page").collect()]
    assert read(1) == [(0, "0", True)] and read(2) == [(0, "0", False), (1, None, True)]
    assert not any(p.truncated for p in _PageReader({"path": str(tmp_path), "maxPages": "1003"}).partitions())


def test_cursor_is_followed_to_its_end(spark):
    from plumbline.sources.paged import scan_cursor

    def fetch(cursor):
        n = int(cursor or 0)
        return [] if n == 1 else [{"n": n}], str(n + 1) if n < 1004 else None

    got = scan_cursor(spark, fetch)
    assert got.count() == 1004 and got.where("truncated").count() == 0
    cut = lambda k: [tuple(r) for r in scan_cursor(spark, fetch, max_calls=k).collect()]
    assert cut(1) == [(0, '{"n": 0}', True)] and cut(2) == [(0, '{"n": 0}', False), (1, None, True)]
    assert scan_cursor(spark, fetch, max_calls=1005).where("truncated").count() == 0


def test_tree_is_followed_to_its_end(spark):
    from plumbline.sources.catalog import descendants

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string")
    root = spark.createDataFrame([("a",)], "r string")
    assert descendants(edges, root, max_depth=3).count() == 4
    with pytest.raises(ValueError, match="below depth 2"):
        descendants(edges, root, max_depth=2)


def test_pairs_by_name_then_description(spark, folder):
    from plumbline.plans.master import one_to_one_pairs

    schema = "code string, cat string, subcat string, name string, mat_desc string, manufacturer string, unit string, lead_time string"
    rows = [("1", "x", None, "n", "d", "m", "u", "l"), ("2", "y", "s", "n", "e", "k", "u", "l"), ("3", "x", "s", "n", "f", "m", "u", "l"), ("4", "y", "s", "o", "f", "k", "u", "l"), ("5", "y", "s", "p", "g", "k", "u", "l")]
    assert rows_of(one_to_one_pairs(spark, folder(material=(rows, schema)))) == collections.Counter([("1", "2", 1), ("3", "4", 2)])
