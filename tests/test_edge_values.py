"""Infinities, NaN, missing keys and equal rows: each has one defined result."""

import math

import pytest
from pyspark.sql import functions as F

from salescope.functions.numeric import exact_avg, exact_sum
from salescope.operators import contracts, forecast, series
from salescope.operators.analytics import historical_roas
from salescope.operators.features import lag_features, rolling_features
from salescope.operators.profile import describe_numeric
from salescope.plans.quantiles import exact_medians
from salescope.plans.session import shared_folder
from salescope.sources.readers import suffix_of


def test_sums_with_values_beyond_integers(frame):
    df = frame("k int, v double", [
        (1, 0.1), (1, 0.2), (1, None), (2, math.inf), (2, 1.0), (3, math.inf), (3, -math.inf), (4, math.nan), (4, 2.0),
        (5, 1e300), (5, 1.0), (6, None),
    ])
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(exact_sum("v").alias("s"), exact_avg("v").alias("m")).collect()}
    assert got[1] == (0.3, 0.15) and got[2][0] == math.inf and math.isnan(got[3][0]) and math.isnan(got[4][0])
    assert got[5][0] == 1e300 and got[6] == (None, None)


def test_nan_is_no_value(frame):
    df = frame("v double, n int", [(math.nan, 1), (5.0, 2), (6.0, None)])
    assert exact_medians(df, ["v"]).first()[0] == 5.5
    row = {r.field: r for r in describe_numeric(df, ["v", "n"]).collect()}["v"]
    assert (row["count"], row["mean"], row.p50, row["max"]) == (2, 5.5, 5.5, 6.0)


def test_paths_of_several_formats_fail():
    assert suffix_of(["a.csv", "b.CSV"]) == "csv"
    with pytest.raises(ValueError):
        suffix_of(["a.csv", "b.json"])


def test_lines_without_a_product_have_no_history(sales):
    df = sales.withColumn("product_id", F.when(F.col("product_id") == "P001", F.col("product_id")))
    lost = rolling_features(lag_features(df)).where("product_id is null").collect()
    assert len(lost) == 200 and all(r.quantity_lag_1 is None for r in lost)
    names = lost[0].asDict()
    assert all(r[c] is None for r in lost for c in names if "_rolling_mean_" in c)
    assert all(r[c] == 0.0 for r in lost for c in names if "_rolling_std_" in c)


def test_no_spend_gives_zeros(sales):
    rows = historical_roas(sales.withColumn("marketing_spend", F.lit(0.0)).withColumn("revenue", F.lit(1.0))).collect()
    assert [(r.category, r.roas, r.total_revenue, r.data_points) for r in rows] == [(None, 0.0, 0.0, 0)]


def test_equal_proposals_are_decisions_of_their_own(spark, sales):
    proposals = spark.createDataFrame([("P001", 100.0, 105.0)] * 3, "product_id string, current_price double, proposed_price double")
    made = contracts.run_decisions(prepared(sales), {contracts.PRICING: proposals})
    assert len({r.decision_id for r in made.select("decision_id").collect()}) == 3


def prepared(sales):
    from salescope.operators.cleaning import clean_sales

    return clean_sales(sales)


def test_short_series_alone_give_error_rows(sales):
    few = series.daily_series(prepared(sales.limit(40)))
    summary, days = forecast.forecast_daily_demand(few, 5)
    assert {r.status for r in summary.collect()} == {"error"} and days.count() == 0


def test_scratch_lies_in_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
