"""Queries over all series, rows and columns of their tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from salescope.fixtures import TABLES, view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["date_spine_all", "daily_features_all", "src_parquet_all", "column_profile_all", "describe_numeric_all"])
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_rolling_tells_every_day_of_all_series(spark, duck):
    test_same_rows(spark, duck, "daily_rolling")
    rolled, days = entry.queries()["daily_rolling"](spark, SF), entry.queries()["date_spine_all"](spark, SF)
    assert set(rolled.columns) == {"series_id", "date", "mean_7", "std_7", "mean_14", "std_14", "mean_28", "std_28"}
    assert rolled.select("series_id", "date").exceptAll(days.select("series_id", "date")).isEmpty() and rolled.count() == days.count()


def test_profiles_take_all_columns(spark):
    raw, sales = view(spark, SF, "raw_sales"), view(spark, SF, "sales")
    assert {r.field for r in entry.queries()["column_profile_all"](spark, SF).collect()} == set(raw.columns)
    numbers = {c for c, t in sales.dtypes if t in ("int", "bigint", "double")}
    assert {r.field for r in entry.queries()["describe_numeric_all"](spark, SF).collect()} == numbers


def test_models_are_fitted_at_the_defaults(monkeypatch):
    from salescope.catalog import forecast, models

    seen = []
    monkeypatch.setattr(models, "_prepared", lambda spark, sf: ("train", "test", ["a"], None))
    monkeypatch.setattr(models.ops, "predictions", lambda trained, test: None)
    monkeypatch.setattr(models.ops, "compare_models", lambda rows: None)
    monkeypatch.setattr(models.ops, "fit_band", lambda rows: None)
    monkeypatch.setattr(models.ops, "top_features", lambda weights: None)
    for name in ("train_forest", "train_bagged", "train_boosted", "train_all"):
        monkeypatch.setattr(models.ops, name, lambda *args, **more: seen.append((args, more)) or models.ops.Trained(None, {}))
    for name in ("random_forest", "bagged_trees_alt", "boosted_trees", "train_all", "top_features"):
        entry.queries()[name](None, SF)
    assert seen == [(("train", ["a"]), {})] * 5
    seen.clear()
    monkeypatch.setattr(forecast, "view", lambda *args: None)
    monkeypatch.setattr(forecast.S, "daily_demand", lambda sales, overall=True, products=True: ("series", overall, products))
    monkeypatch.setattr(forecast.S, "numbered_days", lambda observed, latest=None: (*observed, latest))
    monkeypatch.setattr(forecast.fc, "forecast_daily_demand", lambda *args: seen.append(args) or ("summary", "days"))
    for name in ("forecast", "recursive_forecast"):
        entry.queries()[name](None, SF)
    assert seen == [(("series", True, True, None), 30)] * 2
