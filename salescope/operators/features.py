"""Features of single order lines: calendar, history of the product, ratios."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio, round_even
from ..plans.numbering import numbered
from ..plans.quantiles import beside, value_at
from ..plans.session import written
from ..plans.skew import HOT_FLOOR, HOT_SHARE, lookback
from ..schema import has, numeric_columns, require

# Default look-backs in rows, and the columns no model may see because
# they name the row or are computed from the target.
LAGS = (1, 7, 14, 30)
WINDOWS = (7, 14, 30)
NOT_FEATURES = (
    "date", "order_id", "customer_id", "product_id", "product_name", "line_id",
    "revenue", "gross_profit", "profit_margin", "net_revenue", "cost", "net_price", "returned_revenue",
    "marketing_per_unit", "return_rate", "inventory_to_sales",
)
ENCODED = ("category", "region")
TEST_SHARE = 0.2
LEAST_ROWS = 50
TIE_BREAKERS = ("date", "order_id", "line_id", "quantity")


def calendar(date: str | Column = "date") -> dict[str, Column]:
    """Calendar fields of a day; Monday is weekday 0."""
    d = F.col(date) if isinstance(date, str) else date
    month = F.month(d)
    angle = F.lit(2 * pi) * month / F.lit(12.0)
    return {
        "year": F.year(d), "month": month, "day": F.dayofmonth(d), "day_of_week": F.weekday(d),
        "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "month_sin": round_even(F.sin(angle), 4), "month_cos": round_even(F.cos(angle), 4),
    }


def temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar()) if has(df, "date") else df


def _order(df: DataFrame) -> list[str]:
    return [c for c in TIE_BREAKERS if c in df.columns]


def _lags(target: str, lags):
    return lambda w: {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}


def _rolling(target: str, windows, std: bool = True, mean: bool = True):
    def outputs(w):
        out = {}
        for n in windows:
            frame = w.rowsBetween(-n, -1)
            if mean:
                out[f"{target}_rolling_mean_{n}"] = round_even(F.avg(target).over(frame), 2)
            if std:
                spread = F.coalesce(F.stddev_samp(target).over(frame), F.lit(0.0))
                out[f"{target}_rolling_std_{n}"] = round_even(spread, 2)
        return out

    return outputs


def _of_known(df: DataFrame, group: str, *args, **hot) -> DataFrame:
    """Look-back columns per group. Rows without a group have no history: nulls, and no deviation."""
    if not has(df, group):
        return lookback(df, None, *args, **hot)
    known = lookback(df.where(F.col(group).isNotNull()), group, *args, **hot)
    added = [f for f in known.schema.fields if f.name not in df.columns]
    none = {f.name: F.lit(0.0 if "_rolling_std_" in f.name else None).cast(f.dataType) for f in added}
    return known.unionByName(df.where(F.col(group).isNull()).withColumns(none))


def history_features(
    df: DataFrame, group: str = "product_id", target: str = "quantity", lags=LAGS, windows=WINDOWS,
    share: float = HOT_SHARE, floor: int = HOT_FLOOR,
) -> DataFrame:
    """Lags and rolling statistics of the earlier rows of the product, in one window pass."""
    both = lambda w: {**_lags(target, lags)(w), **_rolling(target, windows)(w)}
    rows = max([*lags, *windows])
    return _of_known(df, group, _order(df), rows, both, share=share, floor=floor)


def lag_features(df: DataFrame, group: str = "product_id", target: str = "quantity", lags=LAGS, **hot) -> DataFrame:
    return _of_known(df, group, _order(df), max(lags), _lags(target, lags), **hot)


def rolling_features(
    df: DataFrame, group: str = "product_id", target: str = "quantity", windows=WINDOWS,
    std: bool = True, mean: bool = True, **hot,
) -> DataFrame:
    outputs = _rolling(target, windows, std, mean)
    return _of_known(df, group, _order(df), max(windows), outputs, **hot)


def business_features(df: DataFrame) -> DataFrame:
    offers = {
        "price_to_cost_ratio": ("unit_price", "cost_per_unit", 2),
        "marketing_per_unit": ("marketing_spend", "quantity", 2),
        "return_rate": ("returns", "quantity", 4),
        "inventory_to_sales": ("inventory_units", "quantity", 2),
    }
    added = {
        name: round_even(ratio(n, d), digits)
        for name, (n, d, digits) in offers.items() if has(df, n, d)
    }
    return df.withColumns(added) if added else df


def ml_features(df: DataFrame) -> DataFrame:
    """All line features; rows without full history are dropped."""
    out = business_features(history_features(temporal_features(df)))
    return out.dropna(subset=[c for c in out.columns if "lag_" in c or "rolling_" in c])


def label_codes(df: DataFrame, columns) -> DataFrame:
    """(field, value, code): the distinct values of text columns numbered from 0 in their order, per column.

    Values are numbered over ranges, however many there are; nulls count as the text nan.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), _label(c).alias("value")) for c in columns])
    labels = df.select(F.explode(pairs).alias("x")).select("x.*").distinct()
    placed = numbered(labels, [F.col("field"), F.col("value")], "place", "labels")
    first = placed.groupBy("field").agg(F.min("place").alias("first"))
    return placed.join(first, "field").select("field", "value", (F.col("place") - F.col("first")).cast("int").alias("code"))


def _label(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def encode_categories(df: DataFrame, columns=ENCODED) -> DataFrame:
    """Codes by sorted value, one plan for lists of any length.

    The codes are read from a written table, so the planner knows their size: it copies short lists to all tasks and splits the
    rows of a hot value when it joins long ones.
    """
    names = [c for c in columns if has(df, c)]
    if not names:
        return df
    codes = written(label_codes(df, names), "label-codes")
    out = df
    for c in names:
        own = codes.where(F.col("field") == c).select(F.col("value").alias("__value"), F.col("code").alias(f"{c}_encoded"))
        out = out.withColumn("__value", _label(c)).join(own, "__value", "left").drop("__value")
    return out


def feature_names(df: DataFrame, target: str = "quantity") -> list[str]:
    """Numeric columns a model may use, in table order."""
    return [c for c in numeric_columns(df) if c != target and c not in NOT_FEATURES]


def select_features(df: DataFrame, target: str = "quantity", keep: tuple[str, ...] = (), least: bool = True) -> DataFrame:
    """Encoded, gap-free feature columns with the target (and ``keep`` columns).

    Fewer than fifty rows fail; counting stops at the fiftieth.
    """
    require(df, [target], "Model training")
    if least and df.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"Insufficient data for models: at least {LEAST_ROWS} rows are needed.")
    encoded = encode_categories(df)
    names = feature_names(encoded, target)
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    return encoded.select(*keep, *filled, target)


def chronological_split(df: DataFrame, date: str = "date", test_share: float = TEST_SHARE) -> DataFrame:
    """``is_test`` marks the latest fifth of the dates; a date is never divided.

    The cut-off is found among the distinct dates, so the window sees calendar days.
    """
    days = df.select(date).where(F.col(date).isNotNull()).distinct()
    held = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(test_share)))
    ranked = days.select(
        F.col(date).alias("cutoff"), F.row_number().over(Window.orderBy(F.desc(date))).alias("r"), held.alias("k"))
    cutoff = ranked.where(F.col("r") == F.col("k")).agg(F.max("cutoff").alias("cutoff"))
    marked = beside(df, cutoff)
    return marked.withColumn("is_test", F.coalesce(F.col(date) >= F.col("cutoff"), F.lit(False))).drop("cutoff")


def ordered_split(df: DataFrame, order: str, test_share: float = TEST_SHARE) -> DataFrame:
    """For tables without dates: the first rows along a unique numeric key train."""
    first_test = value_at(df, order, lambda n: F.floor(n * F.lit(1 - test_share)))
    return beside(df, first_test).withColumn("is_test", F.col(order) >= F.col("value")).drop("value")


def preprocess_summary(split: DataFrame, features: int, target: str = "quantity") -> DataFrame:
    """Row counts of both parts and the spread of the training target."""
    train = F.when(~F.col("is_test"), F.col(target).cast("double"))
    n_train, n_test = F.count_if(~F.col("is_test")), F.count_if(F.col("is_test"))
    return split.agg(
        F.count(F.lit(1)).alias("total_samples"), n_train.alias("training_samples"), n_test.alias("testing_samples"),
        F.concat(n_train.cast("string"), F.lit(":"), n_test.cast("string")).alias("train_test_ratio"),
        F.lit(features).cast("bigint").alias("num_features"),
        round_even(F.avg(train), 2).alias("target_mean"), round_even(F.stddev_samp(train), 2).alias("target_std"),
        round_even(F.min(train), 2).alias("target_min"), round_even(F.max(train), 2).alias("target_max"),
    )


def scale_features(split: DataFrame, columns: list[str]) -> DataFrame:
    """Columns centred and divided by the population deviation of the training rows."""
    train = split.where(~F.col("is_test"))
    stats = train.agg(*[f for c in columns for f in (
        F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])

    def scaled(c: str) -> Column:
        spread = F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(F.lit(1.0))
        return ((F.col(c) - F.col(f"__m_{c}")) / spread).alias(c)

    return beside(split, stats).select(*[scaled(c) if c in columns else F.col(c) for c in split.columns])


def recent_means(df: DataFrame, columns: list[str], group: str = "product_id", last: int = 30) -> DataFrame:
    """Mean of each column over the last rows of a group. Each task passes on only its
    own last rows of a group, so a hot group costs no more than any other."""
    latest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in _order(df)])
    recent = df.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") <= last)
    return recent.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns], F.max("date").alias("last_date"))


def future_features(
    df: DataFrame, columns: list[str], periods: int = 30, group: str = "product_id", known: str | None = None
) -> DataFrame:
    """Feature rows for the days after a group's last date: calendar fields from the
    day, everything else the mean of the last thirty rows, zero if unknown."""
    days = calendar("future_date")
    carried = [c for c in columns if c not in days and has(df, c)]
    recent = recent_means(df, carried, group)
    step = F.explode(F.sequence(F.lit(1), F.lit(periods)))
    rows = recent.withColumn("step", step).withColumn("future_date", F.date_add("last_date", F.col("step")))

    def value(c: str) -> Column:
        if c in days:
            return days[c].cast("double")
        return F.coalesce(F.col(c), F.lit(0.0)) if c in carried else F.lit(0.0)

    return rows.select(group, "future_date", *[value(c).alias(c) for c in columns])
