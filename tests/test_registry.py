"""The registered queries against their SQL, and the shape of their plans."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from tapeloom.driver.tables import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = Counter(tuple(plain(v) for v in r) for r in df.collect())
    if name not in entry.oracle_sql():
        assert rows
        return
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    assert rows == Counter(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_indicators_share_one_shuffle(spark):
    text = plan(spark, "adx_wilder")
    # one for the daily aggregate, one for the symbol windows
    assert text.count("Exchange hashpartitioning") == 2 and text.count("+- Sort [") == 1


@pytest.mark.parametrize("name", ["technical_score", "fundamental_score", "fuse_profiles", "walk_forward", "classify_rules", "filing_dedup_two_layer", "view_signals"])
def test_hot_paths_hold_no_python_and_no_cartesian(spark, name):
    text = plan(spark, name)
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct"):
        assert word not in text


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "large_deal_net")
    assert "l_tax" not in text.split("ReadSchema")[1].split("\n")[0] and "PushedFilters: [IsNotNull(l_quantity)" in text


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "symbol"
