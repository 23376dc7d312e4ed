"""Registered queries against another engine on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from salescope.fixtures import TABLES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "monthly_revenue", "inventory_analysis", "clean_sales", "dq_issues", "attach_returns", "lag_features",
    "select_features", "signals", "pricing_scenarios", "recommendation", "forecast_all_products", "map_alias",
    "describe_numeric", "outcome_report",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 12 and [r["year_month"] for r in rows] == sorted(r["year_month"] for r in rows)


def test_every_sql_belongs_to_a_query(duck):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
