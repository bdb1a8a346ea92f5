"""Every registered query against its DuckDB oracle on the smallest driver tables,
and free of cartesian products and row-at-a-time Python in its physical plan."""

import os

import duckdb
import pytest

from test_plans import SLOW_PATHS
from tools.oracle_check import TABLES, rows
from transitreach.catalog.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_small}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("key", sorted(k for k, (_, sql) in QUERIES.items() if sql is not None))
def test_matches_oracle(spark, sf_small, con, key):
    fn, sql = QUERIES[key]
    df = fn(spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in SLOW_PATHS if p in plan], plan
    got_cols, got = rows(df.toPandas())
    want_cols, want = rows(con.execute(sql).df())
    assert got_cols == want_cols
    assert len(got) == len(want)
    assert got == want
