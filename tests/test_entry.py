"""Every query with SQL against DuckDB, and the others for their form, on the smallest tables."""

import collections
import datetime as dt
import decimal
import glob
import importlib.util
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(float(f"{v:.9g}"))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = collections.Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = collections.Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_core_needs_no_llm_subpackage():
    code = "import sys; sys.modules['plumbline.llm'] = None; import importlib; import plumbline.plans.problems, plumbline.plans.spend, plumbline.plans.master; print('ok')"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert done.stdout.strip() == "ok", done.stderr
    if importlib.util.find_spec("plumbline.llm") is None:
        assert not any(n.startswith(("p1_", "p4_", "p8_")) for n in QUERIES)


def test_all_core_queries_without_the_llm_subpackage():
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['plumbline.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith(('p1_', 'p4_', 'p7_', 'p8_', 'p9_', 'p10_'))])"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    llm = [n for n in QUERIES if n.startswith(("p1_", "p4_", "p7_", "p8_", "p9_", "p10_"))]
    n, m, left = done.stdout.strip().split(" ", 2)
    assert (int(n), left) == (len(QUERIES) - len(llm), "[]") and int(m) == len(set(SQL) - set(llm)), done.stderr
