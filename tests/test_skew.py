"""Plans for hot keys give the same rows as the plain ones, and stay balanced."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from salescope.functions.numeric import exact_avg, exact_sum
from salescope.operators import features
from salescope.plans import quantiles, skew


@pytest.fixture
def lines(spark):
    """One product holds half of all rows; one order key is shared by a third."""
    rnd = random.Random(5)
    rows = [("hot" if i % 2 else f"p{i % 40}", rnd.randrange(60), f"o{rnd.randrange(10**6)}", i, rnd.randrange(50))
            for i in range(4000)]
    return spark.createDataFrame(rows, "product_id string, date int, order_id string, line_id bigint, quantity int")


@pytest.mark.parametrize("share,floor", [(1e-4, 10**6), (0.0, 0), (0.0, 200)])
def test_lookback_in_blocks_equals_one_window(lines, share, floor):
    got = features.history_features(lines, share=share, floor=floor)
    w = Window.partitionBy("product_id").orderBy("date", "order_id", "line_id", "quantity")
    both = {**features._lags("quantity", features.LAGS)(w), **features._rolling("quantity", features.WINDOWS)(w)}
    want = lines.withColumns(both)
    assert got.count() == 4000
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_hot_rows_spread_over_blocks(spark, lines):
    cut = lines.where("product_id = 'hot'").repartitionByRange(4, "product_id", "date", "order_id")
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_lookback_without_group(lines):
    got = features.lag_features(lines.drop("product_id"))
    w = Window.orderBy("date", "order_id", "line_id", "quantity")
    want = lines.drop("product_id").withColumns(features._lags("quantity", features.LAGS)(w))
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_rolling_mean_literal(spark):
    df = spark.createDataFrame([("A", i, q) for i, q in enumerate([1, 3, 5, 7])], "product_id string, date int, quantity int")
    out = features.rolling_features(df, windows=(2,)).orderBy("date").collect()
    assert [r["quantity_rolling_mean_2"] for r in out] == [None, 1, 2, 4]


@pytest.mark.parametrize("floor", [10**6, 100])
def test_lookup_join_keeps_all_rows(spark, lines, floor):
    left = lines.withColumn("product_id", F.when(F.col("line_id") % 5 != 0, F.col("product_id")))
    right = left.where("product_id is not null and product_id <> 'p4'").groupBy("product_id").agg(F.max("quantity").alias("m"))
    got = skew.lookup_join(left, right, "product_id", share=0.0, floor=floor)
    want = left.join(right, "product_id", "left")
    assert got.count() == 4000
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_hot_keys_are_bounded(lines):
    hot = skew.hot_keys(lines, "product_id", share=0.1, floor=10)
    assert [r["product_id"] for r in hot.collect()] == ["hot"]


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 50, 1001])
def test_small_quantiles_are_exact(spark, n):
    values = [float((i * 7919) % 103) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = quantiles.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    for i, p in enumerate((0, 25, 50, 75, 100)):
        assert r[f"q{i}"] == pytest.approx(np.percentile(values, p), abs=1e-12)


@pytest.mark.parametrize("fineness", [1, 65536])
@pytest.mark.parametrize("shape", ["spread", "ties", "outliers"])
def test_quantiles_are_exact_for_any_buckets(spark, shape, fineness):
    rnd = np.random.default_rng(3)
    values = {"spread": rnd.normal(size=20000), "ties": rnd.integers(0, 9, 20000).astype(float),
              "outliers": np.concatenate([rnd.normal(size=19990), [1e12] * 10])}[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    r = quantiles.exact_quantiles(df, ["v"], [0.25, 0.5, 0.9], fineness=fineness).first()
    for i, p in enumerate((25, 50, 90)):
        assert r[f"q{i}"] == pytest.approx(np.percentile(values, p), rel=1e-12)
    assert r["n"] == 20000


@pytest.mark.parametrize("shape", ["cents", "two_heaps", "negative", "huge", "infinite"])
def test_close_values_spread_over_parts(spark, shape):
    """Values that share one bucket of the fixed scale: the last count holds a small share of them, and the quantiles are exact."""
    rnd = np.random.default_rng(4)
    values = {
        "cents": 1e9 + rnd.integers(0, 100_000, 20_000) / 100, "two_heaps": np.where(rnd.random(20_000) < 0.6, 1e9, 1e9 + 1) + rnd.random(20_000) * 1e-4,
        "negative": -1e9 - rnd.random(20_000), "huge": rnd.normal(size=20_000) * 1e307,
        "infinite": np.concatenate([rnd.random(19_000), [np.inf] * 600, [-np.inf] * 400]),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    r = quantiles.exact_quantiles(df, ["v"], [0.25, 0.5, 0.9]).first()
    for i, p in enumerate((25, 50, 90)):
        assert r[f"q{i}"] == pytest.approx(np.percentile(values, p), rel=1e-15)
    last = quantiles._counts_around(df, ["v"], lambda n: [F.floor(n / 2)], quantiles.FINENESS).count()
    assert last <= 40


def test_value_at_rank(spark):
    df = spark.range(5000).select(((F.col("id") * 7) % 5000).alias("k")).repartition(5)
    for fineness in (1, 65536):
        got = quantiles.value_at(df, "k", lambda n: F.floor(n * F.lit(0.8)), fineness).first()["value"]
        assert got == 4000


def test_exact_sum_ignores_order(spark):
    values = [0.1] * 1000 + [1e12, -1e12, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    sums = {df.repartition(k).agg(exact_sum("v")).first()[0] for k in (1, 3, 7)}
    assert sums == {102.675}
    assert df.where("v > 5e12").agg(exact_avg("v")).first()[0] is None
