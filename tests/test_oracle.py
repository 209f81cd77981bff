"""Every registered query against its DuckDB oracle on the smallest test scale
(the driver repeats this at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from reachkit.plans.catalog import QUERIES as CORE
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, rows_of

QUERIES = {k: f for k, f in entry.queries().items() if k in CORE}
ORACLE = {k: sql for k, sql in entry.oracle_sql().items() if k in CORE}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, df.collect()) == rows_of(dcols, res.fetchall())


def test_every_query_has_oracle_or_is_a_fit():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == ["fit_segment", "flow_exploded", "flow_segment", "flow_uniform"]


@pytest.mark.parametrize("name", ["fit_total", "fit_segment", "flow_segment"])
def test_non_sql_queries_run(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert len(rows) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"timestamp", "reach_inc", "impression_inc", "reach", "impression"}
    rows = df.collect()
    assert rows and max(r["impression"] for r in rows) > 0
