"""Paged scans, catalog, files, sinks and streams."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators.sets import limited, union_selected
from plumbline.runner import cut, run_script
from plumbline.sources import catalog, files, paged, sinks
from plumbline.streaming.intervals import coverage_stream
from plumbline.streaming.reminders import commit_after_send, reminder_stream
from plumbline.streaming.slices import once, sliced_counts


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ({"content": [1, 2], "totalElements": 5, "last": False}, ([1, 2], 5, True)), ({"records": [1], "total": 0}, ([1], None, False)), ({"items": [1, 2]}, ([1, 2], None, True)), ([1, 2, 3], ([1, 2, 3], None, True)),
        ({"a": 1}, ([{"a": 1}], None, False)), (None, ([], None, False)), ({"list": [], "total": True}, ([], None, False)), ({"content": [1, 2], "last": True}, ([1, 2], None, False)),
    ],
)
def test_normalize(raw, want):
    p = paged.normalize(raw, 2)
    assert (p.items, p.total, p.has_next) == want


def test_scan_pages(spark):
    def fetch(page, size):
        return {"content": [{"id": page * size + i} for i in range(size if page < 5 else 1)], "last": page >= 5}

    rows, truncated = paged.scan_pages(spark, fetch, size=3, wave=4)
    assert rows.count() == 16 and not truncated
    rows, truncated = paged.scan_pages(spark, fetch, size=3, max_pages=2)
    assert rows.count() == 6 and truncated


def test_scan_slices(spark):
    times = sorted([5, 6, 7, 8, 9, 10, 11, 12, 99, 100, 101, 199] * 1)

    def fetch(a, b):
        return [{"id": t} for t in times if a <= t < b][:4]

    got = paged.scan_slices(spark, fetch, 0, 200, slice_ms=100, overlap_ms=10, full=4).collect()
    assert sorted(int(r.id) for r in got) == times and not any(r.incomplete for r in got)
    crowded = paged.scan_slices(spark, lambda a, b: [{"id": i} for i in range(4)], 0, 100, slice_ms=100, full=4, max_depth=1).collect()
    assert len(crowded) == 4 and all(r.incomplete for r in crowded)
    assert paged.scan_slices(spark, fetch, 0, 0).count() == 0


def test_cursor_and_details(spark):
    pages = {None: ([{"a": 1}], "x"), "x": ([{"a": 2}, {"a": 3}], None)}
    assert paged.scan_cursor(spark, lambda c: pages[c]).count() == 3

    def fetch(key):
        if key == "b":
            raise KeyError("gone")
        return {"id": key}

    ids = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = {r.id: (r.item, r.error) for r in paged.fetch_details(ids, fetch, id="k").collect()}
    assert got == {"a": ('{"id": "a"}', None), "b": (None, "KeyError: 'gone'")}


def test_landed_pages(spark, tmp_path):
    for n, ids in enumerate([[1, 2], [2, 3]]):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"items": [{"id": i, "page": n} for i in ids]}))
    (tmp_path / "other.txt").write_text("x")
    spark.dataSource.register(paged.PagedJson)
    df = spark.read.format("paged_json").load(str(tmp_path))
    assert df.count() == 4
    merged = paged.merged_chunks(df).select("key", F.get_json_object("item", "$.page").alias("p")).collect()
    assert {r.key: r.p for r in merged} == {"1": "0", "2": "1", "3": "1"}
    assert spark.read.format("paged_json").option("maxPages", "1").load(str(tmp_path)).count() == 2


def test_catalog(spark, tmp_path):
    assert len(catalog.ENTITIES) == 78
    spark.createDataFrame([("M1", "p1", "2024-01-01"), ("M2", "p2", "2024-02-01"), ("M3", "p1", None)], "material_no string, plant string, day string").write.parquet(f"{tmp_path}/md_material.parquet")
    scan = lambda **f: sorted(r.material_no for r in catalog.scan(spark, str(tmp_path), "md.material", f).collect())
    assert scan() == ["M1", "M2", "M3"] and scan(plant="p1") == ["M1", "M3"] and scan(plants=["p1", "p2"], from_day="2024-01-01", to_day="2024-01-31") == ["M1"] and scan(plant=None) == ["M1", "M2", "M3"]
    assert catalog.get(spark, str(tmp_path), "md.material", "material_no", "M2").count() == 1
    with pytest.raises(ValueError, match="unknown filter"):
        scan(nonsense=1)
    catalog.check_filter("md.material", {"field_ab": 1}, [])
    for entity, bad in (("md.exchange_rate", {}), ("mm.bom", {}), ("wm.stock", {"material_id": 1, "material_ids": [2]})):
        with pytest.raises(ValueError):
            catalog.check_filter(entity, bad, ["material_id", "material_ids"])
    with pytest.raises(KeyError):
        catalog.check_filter("no.such", {}, [])


def test_tree(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    got = {(r.node, r.depth) for r in catalog.descendants(edges, spark.createDataFrame([("a",)], "r string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_files(spark, tmp_path):
    for i, n in enumerate(["a-2024-01-01.csv", "a-2024-02-01.csv", "a-v2.csv"]):
        (tmp_path / n).write_text(" 订单号 ,物料编码,含税单价,数量,日期\nPO1,M1,2.5,3,2024-02-01\nX1,M1,2.5,3,2024-02-01\nPO2,,1,1,2024-02-01\nPO3,M2,0,1,2024-02-01\nPO4,M2,abc,1,2024-02-01\n")
        os.utime(tmp_path / n, (i, i))
    path = files.latest_file(str(tmp_path), r"^a-", "v2")
    assert path.endswith("a-2024-02-01.csv") and files.date_in_name(path) == "2024-02-01" and files.date_in_name("x") == "unknown" and files.latest_file(str(tmp_path), "zz") is None
    rules = [("po", ["订单"]), ("material_id", ["物料"]), ("price", ["单价"]), ("qty", ["数量"]), ("order_date", ["日期"]), ("none", ["无"])]
    df = files.read_export(spark, path, rules, extra={"factory": "f1"})
    rows = files.purchase_rows(df, day="2024-02-01").collect()
    assert [(r.po, r.price, r.factory, r.none) for r in rows] == [("PO1", 2.5, "f1", None)]
    assert files.purchase_rows(df, day="2024-02-01", positive_price=False).count() == 2
    assert files.renamed(spark.createDataFrame([(1,)], " a  int"), {"a": "b", "zz": "y"}).columns == ["b"]


def test_sinks(spark, tmp_path):
    t = str(tmp_path)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, at_ms long")
    sinks.upsert(spark, f"{t}/s", df, "id", "at_ms")
    sinks.upsert(spark, f"{t}/s", spark.createDataFrame([("a", 5), ("c", 1), ("b", 0)], "id string, at_ms long"), "id", "at_ms")
    assert {tuple(r) for r in sinks.state(spark, f"{t}/s").collect()} == {("a", 5), ("b", 2), ("c", 1)} and sinks.state(spark, f"{t}/none") is None
    sinks.write_tables({"x": df}, t)
    sinks.write_summary(df, f"{t}/y")
    sinks.append_log(df, f"{t}/log")
    sinks.append_log(df, f"{t}/log")
    assert spark.read.parquet(f"{t}/x").count() == 2 and spark.read.json(f"{t}/y").count() == 2 and sinks.newest(spark.read.parquet(f"{t}/log"), "at_ms", 3).count() == 3
    lines = sinks.report_lines(df.withColumn("s", F.lit("s")), "s", F.col("id"), [F.col("id")], 1).orderBy("position").collect()
    assert [r.line for r in lines] == ["a", "and 1 more"]
    page = sinks.html_report(sinks.report_lines(df.withColumn("s", F.lit("<s>")), "s", F.col("id"), [F.col("id")], 1), "s", "T")
    assert page == "<h1>T</h1>\n<h2>&lt;s&gt;</h2>\n<p>a</p>\n<p>and 1 more</p>"
    assert [r.flag for r in sinks.flagged(df, {"big": F.col("at_ms") > 1}).orderBy("id").collect()] == [None, "big"]


def test_runner(tmp_path):
    assert run_script("print('hi')")["stdout"] == "hi\n"
    assert run_script("import time; time.sleep(5)", timeout_s=0.5)["timed_out"]
    for _ in range(3):
        run_script("1/0", audit=str(tmp_path), keep=2)
    assert len(list(tmp_path.glob("run-*.json"))) == 2 and json.loads(sorted(tmp_path.glob("run-*.json"))[0].read_text())["exit_code"] == 1
    assert cut("é".encode() * 3, 3) == ("é", True)


def stream_of(spark, tmp_path, name, df, batches=1):
    path = f"{tmp_path}/{name}"
    df.repartition(batches).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_stream_of_slices(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12, 5)
    e = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (2, t + dt.timedelta(hours=1), "x")], "id int, ts timestamp, kind string")
    assert run_stream(once(stream_of(spark, tmp_path, "e", e), id="id", ts="ts"), "once", "append").count() == 2
    got = run_stream(sliced_counts(stream_of(spark, tmp_path, "f", e), ts="ts", by="kind"), "sliced", "complete").collect()
    assert sorted(r.n for r in got) == [2, 3]


def test_stream_of_periods(spark, tmp_path):
    spans = spark.createDataFrame([("a", "s", 1, 3), ("a", "s", 8, 9), ("a", "s", 4, 5), ("b", "s", 1, 1)], "k1 string, k2 string, lo int, hi int")
    got = run_stream(coverage_stream(stream_of(spark, tmp_path, "p", spans, 3)), "periods", "update")
    rows = {tuple(r) for r in got.collect()}
    assert {("a", "s", "period", 1, 5), ("a", "s", "gap", 6, 7), ("a", "s", "period", 8, 9), ("b", "s", "period", 1, 1)} <= rows


def test_stream_of_reminders(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(hours=7)), ("a", t + dt.timedelta(hours=8)), ("b", t)], "id string, ts timestamp")
    got = run_stream(reminder_stream(stream_of(spark, tmp_path, "r", items), id="id", ts="ts"), "reminders_out", "append")
    assert sorted(r.id for r in got.collect()) == ["a", "a", "b"]
    sent = []
    commit_after_send(f"{tmp_path}/state", lambda rows: sent.extend(rows.collect()))(got, 0)
    assert len(sent) == 3 and sinks.state(spark, f"{tmp_path}/state").count() == 2
    with pytest.raises(ZeroDivisionError):
        commit_after_send(f"{tmp_path}/fails", lambda rows: 1 / 0)(got, 0)
    assert sinks.state(spark, f"{tmp_path}/fails") is None


def test_envelopes_and_whole_lists():
    assert paged.envelope({"content": None}, 2) == paged.Page([], None, False) and paged.envelope([1, 2], 2) == paged.Page([], None, False)
    assert paged.envelope({"items": [1, 2]}, 2) == paged.Page([1, 2], None, True)
    assert paged.whole([1, 2], 2) == paged.Page([1, 2], 2, False) and paged.whole({"items": [1]}) == paged.Page([1], 1, False)
    assert paged.whole({"a": 1}) == paged.Page([{"a": 1}], 1, False) and paged.whole(None) == paged.Page([], 0, False) == paged.whole(3)


def test_retry():
    calls = []

    def fetch(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("away")
        return x

    assert paged.Retrying(fetch, wait=0)(7) == 7 and len(calls) == 3
    with pytest.raises(OSError):
        paged.Retrying(_fails, attempts=2, wait=0)(1)


def _fails(*_):
    raise OSError("away")


def test_services_by_kind(spark):
    def fetch(r):
        if r.entity == "md.company_code":  # ignores paging: read once all the same
            return [{"id": i} for i in range(100)]
        page = r.body["page"] if r.body and "page" in r.body else int(r.params["page"])
        rows = [{"id": 10 * page + i, "asked": [sorted(r.params), sorted(r.body or {}), r.module, r.headers]} for i in range(10)]
        return {"content": rows if page < 3 else None}

    def scan(entity, **kw):
        df, truncated = catalog.scan_service(spark, entity, fetch, size=10, **kw)
        got = [json.loads(r.item) for r in df.orderBy("page", "ordinal").collect()]
        return [g["id"] for g in got], got[0].get("asked"), truncated

    assert scan("md.company_code") == (list(range(100)), None, False)
    assert scan("md.plant", filters={"code": "a", "name": None}, columns=["code", "name"]) == (list(range(30)), [["code", "page", "size"], [], None, None], False)
    assert scan("mm.rfq", filters={"code": "a"}, columns=["code"]) == (list(range(30)), [["page", "size"], ["code"], None, None], False)
    assert scan("pp.demand_supply", filters={"code": "a"}, columns=["code"]) == (list(range(30)), [[], ["code", "page", "size"], None, None], False)
    assert scan("fn.fapiao", module="ar", company="c1")[1] == [["page", "size"], [], "ar", {"company": "c1"}]
    assert scan("fn.fapiao", module="ap")[1][3] is None
    assert scan("md.plant", max_pages=2) == (list(range(20)), [["page", "size"], [], None, None], True)
    assert scan("md.plant", path="below")[1][0] == ["page", "path", "size"]
    period = {"from_posting_period_id": "p1", "to_posting_period_id": "p2"}
    columns = ["posting_period_id"]
    assert scan("fn.payment_receipt", module="ap", filters=period, columns=columns)[0] == list(range(30))
    for bad in ({"module": None, "filters": period}, {"module": "xx", "filters": period}, {"module": "ar", "filters": {"from_posting_period_id": "p1"}}, {"module": "ar", "filters": {"to_posting_period_id": "p1"}}, {"module": "ar"}):
        with pytest.raises(ValueError):
            catalog.scan_service(spark, "fn.payment_receipt", _fails, columns=columns, **bad)
    with pytest.raises(ValueError):
        catalog.scan_service(spark, "md.plant", _fails, module="ar")
    with pytest.raises(KeyError):
        catalog.scan_service(spark, "md.nothing", _fails)


def test_declared_filters():
    catalog.check_filter("md.plant", {"from_code": 1, "codes": [1]}, ["code"])
    catalog.declare("md.plant", ["code", "from_day"], [r"x_\d"])
    try:
        catalog.check_filter("md.plant", {"code": 1, "from_day": 2, "x_1": 3}, ["code"])
        for bad in ("from_code", "codes", "to_day", "x_", "name"):
            with pytest.raises(ValueError, match=bad):
                catalog.check_filter("md.plant", {"code": 1, bad: 1}, ["code", "name"])
        catalog.check_filter("md.plant", {}, [])
        with pytest.raises(KeyError):
            catalog.declare("md.nothing", [])
    finally:
        catalog.undeclare("md.plant")


def test_enriched(spark):
    def items(key):
        if key == "2":
            raise ValueError("broken")
        return [] if key == "3" else [{"n": key}]

    def broken(key):
        raise OSError("away")

    headers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (1, "d"), (None, "e")], "id int, name string")
    got = {r.name: (r.items, r.items_error, r.notes, r.notes_error) for r in paged.enriched(headers, {"items": items, "notes": broken}, id="id").collect()}
    away = "OSError: away"
    assert got == {"a": ('[{"n": "1"}]', None, None, away), "b": (None, "ValueError: broken", None, away), "c": ("[]", None, None, away), "d": ('[{"n": "1"}]', None, None, away), "e": (None, None, None, None)}


def test_positions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,z\nM1,n1,线材\n,n2,线材\nM3,n3,成品柜\nM4,n4,\n")
    df = files.read_positions(spark, str(tmp_path / "p.csv"), {"code": 0, "cat": 2, "far": 9}, first="code", exclude={"cat": ["成品柜", "外购成套"]})
    assert {tuple(r) for r in df.collect()} == {("M1", "线材", None), ("M4", None, None)}


def test_state_by_buckets(spark, tmp_path):
    t = f"{tmp_path}/s"
    schema = "id string, at_ms long"
    whole = spark.range(500).selectExpr("cast(id as string) id", "id at_ms")
    sinks.upsert(spark, t, whole, "id", "at_ms")
    for n in range(3):
        path = sinks.upsert(spark, t, spark.createDataFrame([("7", 1000 + n), (None, n)], schema), "id", "at_ms")
        assert len(os.listdir(path)) <= 4  # two buckets, besides the marks of the writer
    got = {r.id: r.at_ms for r in sinks.state(spark, t).collect()}
    assert got == {str(i): i for i in range(500)} | {"7": 1002, None: 2}
    bucket = next(b for b in os.listdir(path) if b.startswith("bucket="))
    assert sum(os.path.isdir(f"{t}/data/{v}/{bucket}") for v in os.listdir(f"{t}/data")) == 2  # the current one and the one before
    sinks.upsert(spark, t, spark.createDataFrame([], schema), "id", "at_ms")
    assert sinks.state(spark, t).count() == 501
    sinks.upsert(spark, f"{t}2", spark.createDataFrame([], schema), "id", "at_ms")
    assert sinks.state(spark, f"{t}2") is None


def test_temporary_tables(spark):
    from plumbline.session import cut_lineage, temporary_tables

    with temporary_tables(spark):
        df = cut_lineage(spark.range(3))
        folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
        assert df.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_spread_runs_nothing(spark):
    from plumbline.session import spread

    grouped = spark.range(100).groupBy("id").count()
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert spread(grouped).count() == 100
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) <= before + 3
    assert spread(spark.createDataFrame([], "a int")).count() == 0


def test_selected_sources(spark):
    read = []

    def source(n):
        return lambda: read.append(n) or spark.range(n).withColumn("n", F.lit(n))

    modes = {"full": ["a", "b"], "basic": ["a"]}
    got = union_selected("basic", modes, {"a": source(2), "b": source(3)})
    assert got.count() == 2 and read == [2] and {r.source for r in got.collect()} == {"a"}
    assert union_selected("full", modes, {"a": source(2), "b": source(3)}).count() == 5
    with pytest.raises(ValueError):
        union_selected("x", modes, {})
    rows, more = limited(spark.range(5), 3, [F.col("id")])
    assert [r.id for r in rows.collect()] == [0, 1, 2] and more and not limited(spark.range(3), 3, [F.col("id")])[1]
