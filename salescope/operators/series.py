"""Daily demand series: building, features, folds, the weekly baseline and its scores."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.session import ship_package
from ..schema import require
from .past_days import RUN, look_back

# Look-backs in days, the least history, and the fold rule.
LAG_DAYS = (1, 7, 14, 28)
ROLLING_DAYS = (7, 14, 28)
MEMORY = 28
LEAST_HISTORY = 70
LEAST_TRAINING = 7
WEEK = 7
FOLDS = 3
HORIZON_RANGE = (7, 28)
HORIZON_PART = 12
BACKTEST_DAYS = (FOLDS + 1) * HORIZON_RANGE[1]
YEAR_DAYS = 365.25

OVERALL = "All Products"
PAST = (*(f"lag_{k}" for k in LAG_DAYS), *(f for k in ROLLING_DAYS for f in (f"mean_{k}", f"std_{k}")))
FEATURES = ("day_of_week", "week_sin", "week_cos", "month_sin", "month_cos", "trend_days", *PAST)


def _whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def _by_day() -> WindowSpec:
    return _whole().orderBy("date")


def daily_demand(df: DataFrame, overall: bool = True, products: bool = True) -> DataFrame:
    """Units per series and observed day.

    With both kinds of series the order lines are read once: the product days, which
    are far fewer, are then counted a second time under the overall name.
    """
    require(df, ["date", "quantity"], "Forecasting")
    dated = df.where(F.col("date").isNotNull() & F.col("quantity").isNotNull())
    units = F.sum("quantity").cast("double").alias("quantity")
    if not products:
        return dated.groupBy("date").agg(units).select(F.lit(OVERALL).alias("series_id"), "date", "quantity")
    require(df, ["product_id"], "Product forecasting")
    product = F.col("product_id").cast("string").alias("series_id")
    if not overall:
        return dated.where(F.col("product_id").isNotNull()).groupBy(product, "date").agg(units)
    days = dated.groupBy(product, "date").agg(units)
    names = F.explode(F.array_compact(F.array("series_id", F.lit(OVERALL)))).alias("series_id")
    return days.select(names, "date", "quantity").groupBy("series_id", "date").agg(F.sum("quantity").alias("quantity"))


def fill_days(observed: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last of a series, zero where nothing sold."""
    return numbered_days(observed).select("series_id", "date", "quantity")


def daily_runs(observed: DataFrame, latest: int | None = None) -> DataFrame:
    """(series_id, date, quantity, day, days, empty): a day with its 0-based number in the series and the length of the series,
    and how many days without sales follow it.

    With ``latest`` only that many days at the end of each series are kept; their numbers are those in the whole series.
    First and last day give numbers and length, so no calendar table is joined and nothing is numbered after it is filled.
    Only observed days are sorted. A series lies in one partition, its days one after the other. The number of partitions is set
    here: few observed rows can become many days, so partitions merged by their size before that would leave cores idle after it.
    """
    parts = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    observed = observed.repartition(parts, "series_id")
    until = F.coalesce(F.date_sub(F.lead("date").over(_by_day()), 1), F.col("date"))
    spans = observed.withColumns({
        "until": until, "first": F.min("date").over(_whole()), "last": F.max("date").over(_whole())})
    begin = F.col("date") if latest is None else F.greatest("date", F.date_sub("last", latest - 1))
    spans = spans.where(F.col("until") >= begin).sortWithinPartitions("series_id", "date")
    return spans.select(
        "series_id", begin.alias("date"), F.when(begin == F.col("date"), F.col("quantity")).otherwise(F.lit(0.0)).alias("quantity"),
        F.datediff(begin, "first").alias("day"), (F.datediff("last", "first") + 1).alias("days"),
        F.datediff("until", begin).alias("empty"))


def numbered_days(observed: DataFrame, latest: int | None = None) -> DataFrame:
    """Every calendar day of a series with its 0-based number and the length of the series, zero where nothing sold: the
    days that :func:`daily_runs` stand for."""
    days = daily_runs(observed, latest).select("*", F.explode(F.sequence(F.lit(0), F.col("empty"))).alias("after"))
    after = F.col("after")
    return days.select(
        "series_id", F.date_add("date", after).alias("date"), F.when(after == 0, F.col("quantity")).otherwise(F.lit(0.0)).alias("quantity"),
        (F.col("day") + after).alias("day"), "days")


def daily_series(df: DataFrame, overall: bool = True, products: bool = True) -> DataFrame:
    return fill_days(daily_demand(df, overall, products))


def only_days(runs: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Runs of days (:func:`daily_runs`) of which only the days that pass ``test`` are wanted: :func:`daily_features` gives no others."""
    return runs.withColumn("wanted", F.filter(F.sequence(F.lit(0), F.col("empty")), lambda after: test(F.date_add("date", after))))


def cycle(d: Column) -> dict[str, Column]:
    """Weekday and yearly cycle of a day."""
    week = F.lit(2 * pi) * F.weekday(d) / F.lit(float(WEEK))
    year = F.lit(2 * pi) * (F.dayofyear(d) - 1) / F.lit(YEAR_DAYS)
    return {
        "day_of_week": F.weekday(d), "week_sin": F.sin(week), "week_cos": F.cos(week),
        "month_sin": F.sin(year), "month_cos": F.cos(year),
    }


def positions(series: DataFrame) -> DataFrame:
    """Adds the 0-based day number and the length of the series, where they aren't there yet."""
    if {"day", "days"} <= set(series.columns):
        return series
    return series.withColumns({
        "day": F.row_number().over(_by_day()) - 1, "days": F.count(F.lit(1)).over(_whole()).cast("int"),
    })


def daily_features(series: DataFrame, lags: tuple[int, ...] = LAG_DAYS, rolls: tuple[int, ...] = ROLLING_DAYS) -> DataFrame:
    """Model inputs per day from the days before it, in one pass over the days of a series one after the other.

    Days are dealt by series and sorted first. Runs of days (:func:`daily_runs`) stand in order and are filled up inside the
    pass, so that every calendar day comes out as well. Python columns can't be pruned: ``lags`` and ``rolls`` tell which are made.
    """
    runs = "empty" in series.columns
    past = [f for f in PAST if f in {f"lag_{k}" for k in lags} | {f"{s}_{k}" for s in ("mean", "std") for k in rolls}]
    numbered = positions(series if runs else series.repartition("series_id")).drop(*past)
    if not runs:
        numbered = numbered.sortWithinPartitions("series_id", "date")
    ship_package(series.sparkSession)
    kept = [f for f in numbered.schema.fields if f.name not in RUN]
    schema = StructType([*kept, *[StructField(f, DoubleType()) for f in past]])
    made = numbered.mapInArrow(look_back(MEMORY, lags, rolls, past, runs), schema)
    return made.withColumns({**cycle(F.col("date")), "trend_days": F.col("day")})


def training_rows(features: DataFrame) -> DataFrame:
    return features.where(F.col("day") >= MEMORY)


def horizon(days: Column) -> Column:
    low, high = HORIZON_RANGE
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(days / HORIZON_PART).cast("int")))


def rolling_origin_folds(series: DataFrame) -> DataFrame:
    """Three folds per series, the last one ending it; folds with too little training
    history are left out."""
    lengths = series.groupBy("series_id").agg(
        F.count(F.lit(1)).cast("int").alias("days"), F.min("date").alias("first_date"))
    folds = lengths.withColumns({"horizon": horizon(F.col("days")), "fold": F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))})
    out = folds.withColumn("origin", F.col("days") - (F.lit(FOLDS) - F.col("fold")) * F.col("horizon"))
    return out.where(F.col("origin") - MEMORY >= LEAST_TRAINING).withColumn(
        "start_date", F.expr("date_add(first_date, origin)")).drop("first_date")


def in_folds(numbered: DataFrame) -> DataFrame:
    """Days that lie in a validation fold, with ``fold``, ``origin`` and ``horizon``.

    Folds follow from the day number alone; nothing is joined.
    """
    h = horizon(F.col("days"))
    first = F.col("days") - FOLDS * F.col("horizon")
    out = numbered.withColumn("horizon", h).where(F.col("day") >= first)
    out = out.withColumn("fold", F.floor((F.col("day") - first) / F.col("horizon")).cast("int"))
    out = out.withColumn("origin", (first + F.col("fold") * F.col("horizon")).cast("int"))
    return out.where(F.col("origin") - MEMORY >= LEAST_TRAINING)


def naive_backtest(series: DataFrame) -> DataFrame:
    """(series_id, fold, date, actual, predicted) of the weekly baseline.

    A day of a fold repeats the last week before the fold, so it looks a whole number
    of weeks back: one, two, three or four. Earlier days than that are left out before any window.
    """
    numbered = positions(series)
    near = numbered.where(F.col("day") >= F.col("days") - BACKTEST_DAYS)
    back = {f"__w{k}": F.lag("quantity", WEEK * k).over(_by_day()) for k in range(1, HORIZON_RANGE[1] // WEEK + 1)}
    days = in_folds(near.withColumns(back))
    weeks = F.floor((F.col("day") - F.col("origin")) / WEEK) + 1
    value = F.lit(None).cast("double")
    for k in range(1, len(back) + 1):
        value = F.when(weeks == k, F.col(f"__w{k}")).otherwise(value)
    return days.select(
        "series_id", "fold", "date", F.col("quantity").alias("actual"),
        F.greatest(value, F.lit(0.0)).alias("predicted"),
    )


def last_days(series: DataFrame, n: int) -> DataFrame:
    """One row per series: its last ``n`` values in order, their mean, its length and its last day.

    Earlier days are left out before anything is gathered.
    """
    numbered = positions(series)
    near = numbered.where(F.col("day") >= F.col("days") - n)
    values = F.transform(F.sort_array(F.collect_list(F.struct("day", "quantity"))), lambda x: x["quantity"])
    return near.groupBy("series_id").agg(
        F.max("days").alias("days"), F.max("date").alias("last_date"), F.avg("quantity").alias("mean_quantity"),
        values.alias("recent"),
    )


def seasonal_naive(series: DataFrame, periods: int = 30) -> DataFrame:
    """(series_id, step, date, predicted): the last week over and over.

    A series shorter than a week is first filled up to a week with its mean.
    """
    step, days, recent = F.col("step"), F.col("days"), F.col("recent")
    ends = last_days(series, WEEK).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    place = days + step - 1
    repeated = F.get(recent, (step - 1) % WEEK)
    short = F.coalesce(F.get(recent, F.when(place >= WEEK, place % WEEK).otherwise(F.lit(WEEK))), F.col("mean_quantity"))
    value = F.when(days >= WEEK, F.greatest(repeated, F.lit(0.0))).otherwise(short)
    return ends.select("series_id", "step", F.date_add("last_date", step).alias("date"), value.alias("predicted"))


def scores(backtest: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute error and weighted absolute percentage error per group."""
    gap = F.abs(F.col("actual") - F.col("predicted"))
    whole = F.sum(F.abs("actual"))
    return backtest.groupBy(*keys).agg(
        F.avg(gap).alias("mae"),
        F.when(whole != 0, F.sum(gap) / whole).otherwise(F.lit(float("inf"))).alias("wape"),
    )


def history_tail(series: DataFrame, n: int = 90) -> DataFrame:
    return positions(series).where(F.col("day") >= F.col("days") - n).select(*series.columns)


def forecast_totals(forecast: DataFrame, *keys: str) -> DataFrame:
    p = "predicted"
    return forecast.groupBy(*keys).agg(
        (F.rint(F.sum(p) * 100.0) / 100.0).alias("total_predicted"),
        (F.rint(F.avg(p) * 100.0) / 100.0).alias("avg_daily_predicted"),
        (F.rint(F.max(p) * 100.0) / 100.0).alias("max_daily_predicted"),
        (F.rint(F.min(p) * 100.0) / 100.0).alias("min_daily_predicted"),
        F.count(F.lit(1)).alias("periods"),
    )
