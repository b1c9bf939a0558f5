"""The core queries without SQL over the smallest tables, whole, against brute force."""

import collections
import json
import os
import re
from difflib import SequenceMatcher

import pytest

import __spark_entry__ as entry
from plumbline.functions.measures import DIMENSIONS, price_basis

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES = entry.queries()


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def table(spark, name, *columns):
    return {tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()}


def test_p2_found(spark):
    near = lambda a, b: abs(a - b) <= 0.001 * max(a, b)
    groups = {}
    for i, m, s, p, u, d in table(spark, "info_record", "record_id", "material_id", "supplier_id", "unit_price", "material_unit", "material_desc"):
        basis = price_basis(u, d)
        if (m or "").strip() and (s or "").strip() and p and p > 0 and basis:
            groups.setdefault((m, s, basis[1]), set()).add((i, p, p / basis[0]))
    want = {(a[0], b[0]) for g in groups.values() for a in g for b in g if a[0] < b[0] and near(a[2], b[2]) and not near(a[1], b[1])}
    assert rows_of(QUERIES["p2_found"](spark, SF)) == collections.Counter(want) and want


def test_p2_common_prices(spark):
    got = rows_of(QUERIES["p2_common_prices"](spark, SF).select("record_id", "unit_price", "common_unit", "unit_scale", "common_price"))
    want = collections.Counter()
    for r in spark.read.parquet(f"{SF}/info_record.parquet").collect():
        b = price_basis(r.material_unit, r.material_desc)
        want[(r.record_id, r.unit_price, b and DIMENSIONS[b[1].index(1)], b and b[0], b and r.unit_price is not None and r.unit_price / b[0] if b and r.unit_price is not None else None)] += 1
    assert got == want


def test_pair_similarity(spark):
    rows = {}
    for n, mark, *fields in table(spark, "dup_pair", "pair_no", "mark", "code", "name", "mat_desc", "cat"):
        if n is not None and mark and mark[0] in "AB":
            rows.setdefault((n, mark[0]), set()).add(tuple(f or "" for f in fields))
    plain = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s.lower()).strip(" ").translate(str.maketrans("（），：×—φø", "(),:x-ΦΦ"))
    want = collections.Counter()
    for n in {n for n, _ in rows}:
        if (n, "A") in rows and (n, "B") in rows:
            a, b = min(rows[n, "A"]), min(rows[n, "B"])
            x, y = (set(re.findall("[一-鿿]", s[1])) for s in (a, b))
            least = min(len(x), len(y))
            want[(n, round(SequenceMatcher(None, plain(a[2]), plain(b[2])).ratio(), 6), round(len(x & y) / least, 6) if least else None)] += 1
    assert rows_of(QUERIES["pair_similarity"](spark, SF)) == want and want


def test_labelled_values(spark):
    want = collections.Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if not (r.text or "").strip("​­﻿ \t\r\n　 "):
            continue
        subject = None
        for label in ("Re", "注"):
            m = re.search(rf"(?m){label}[ \t\n\x0b\f\r]*[:：]?[ \t]*([^\r\n]*)", r.text)
            hit = re.sub(r"[ \t\n\x0b\f\r]+", " ", m[1]).strip(" ") if m else ""
            subject = subject if subject is not None else hit if 3 <= len(hit) <= 499 else None
        counts = {}
        for label in ("单号", "数量", "交期"):
            m = re.search(rf"{label}[ \t\n\x0b\f\r]*[:：(（]?[ \t\n\x0b\f\r]*([0-9]+)", r.text)
            if m and int(m[1]) < 2**31:
                counts[label] = int(m[1])
        want[(r.doc_id, subject, json.dumps(counts, sort_keys=True))] += 1
    got = collections.Counter((r.doc_id, r.subject, json.dumps(json.loads(r.counts), sort_keys=True)) for r in QUERIES["labelled_values"](spark, SF).collect())
    assert got == want and want


def test_every_query_is_checked():
    """Each query has SQL, or a test of its own that names it."""
    here = os.path.dirname(__file__)
    files = [os.path.join(d, f) for d, _, names in os.walk(here) for f in names if f.endswith(".py") and f != "test_entry.py"]
    tests = "".join(open(f, encoding="utf-8").read() for f in files)
    assert [n for n in QUERIES if n not in entry.oracle_sql() and f"def test_{n}" not in tests] == []
