"""Every registered query against its DuckDB oracle (sf0.001), and the
driver contract."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from vitals.plans.queries import REGISTRY
from vitals.sources.tables import TABLES

from .conftest import SF_SMALL

# the queries of the optional subpackage have tests of their own
QUERIES = {k: v for k, v in E.queries().items() if k in REGISTRY}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in REGISTRY}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "z_score" in df.columns


def test_every_query_has_a_builder():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 50


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows, cols = df.collect(), df.columns
    cur = duck.execute(ORACLE[name])
    orows, ocols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    got = Counter(tuple(_norm(v) for v in r) for r in rows)
    want = Counter(tuple(_norm(r[i]) for i in idx) for r in orows)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
