"""The registered queries that SQL can express, against DuckDB."""

from collections import Counter

import duckdb
import pytest

from tests.conftest import SF_SMALL
from vitals.llm.queries import REGISTRY
from vitals.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_matches_sql(spark, duck, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, SF_SMALL)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert Counter(map(tuple, df.collect())) == want
