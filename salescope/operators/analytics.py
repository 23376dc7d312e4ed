"""Monthly, product, category, regional, marketing and inventory tables, and KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg, exact_sum, mean, round_even, total
from ..plans.quantiles import exact_medians
from ..schema import PRODUCT_KEYS, has, nothing

# How far from the median a product counts as fast or slow moving.
FAST = 1.5
SLOW = 0.5


def year_month(c: str = "date") -> Column:
    return F.date_format(F.col(c), "yyyy-MM")


def _units(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all present; a missing key forms no group.

    Plain null tests, unlike dropna, reach the Parquet scan.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def _optional(df: DataFrame, offers: list[tuple[str, str, Column]]) -> list[Column]:
    return [c.alias(name) for needed, name, c in offers if needed in df.columns]


def monthly_revenue(df: DataFrame) -> DataFrame:
    """Money, orders and units per calendar month, oldest first.

    The average order value is the mean revenue of a row. Order counting is
    two-stage (month and order first), so no month's orders meet in one task.
    """
    if not has(df, "date", "revenue"):
        return nothing(df, "year_month string, total_revenue double")
    rows = _known(df, "date").withColumn("year_month", year_month())
    metrics = [total("revenue").alias("total_revenue")]
    metrics += _optional(df, [
        ("gross_profit", "total_profit", total("gross_profit")),
        ("order_id", "total_orders", F.count_distinct("order_id")),
        ("quantity", "total_units", _units("quantity")),
        ("order_id", "avg_order_value", mean("revenue")),
        ("profit_margin", "avg_profit_margin", mean("profit_margin", 4)),
        ("net_revenue", "total_net_revenue", total("net_revenue")),
    ])
    return rows.groupBy("year_month").agg(*metrics).orderBy("year_month")


def product_performance(df: DataFrame) -> DataFrame:
    if not has(df, *PRODUCT_KEYS, "revenue", "quantity"):
        return nothing(df, "product_id string, product_name string, category string, total_revenue double")
    metrics = [total("revenue").alias("total_revenue")]
    metrics += _optional(df, [
        ("gross_profit", "total_profit", total("gross_profit")),
        ("quantity", "total_units", _units("quantity")),
        ("unit_price", "avg_price", mean("unit_price")),
        ("profit_margin", "avg_margin", mean("profit_margin", 4)),
        ("discount", "avg_discount", mean("discount")),
        ("returns", "total_returns", _units("returns")),
        ("marketing_spend", "total_marketing", total("marketing_spend")),
    ])
    grouped = _known(df, *PRODUCT_KEYS).groupBy(*PRODUCT_KEYS).agg(*metrics)
    return grouped.orderBy(F.desc("total_revenue"), "product_id")


def category_analysis(df: DataFrame) -> DataFrame:
    if not has(df, "category", "revenue", "quantity"):
        return nothing(df, "category string, total_revenue double")
    metrics = [total("revenue").alias("total_revenue")]
    metrics += _optional(df, [
        ("gross_profit", "total_profit", total("gross_profit")),
        ("quantity", "total_units", _units("quantity")),
        ("product_id", "num_products", F.count_distinct("product_id")),
        ("profit_margin", "avg_margin", mean("profit_margin", 4)),
        ("marketing_spend", "total_marketing", total("marketing_spend")),
        ("returns", "total_returns", _units("returns")),
    ])
    grouped = _known(df, "category").groupBy("category").agg(*metrics)
    return grouped.orderBy(F.desc("total_revenue"), "category")


def regional_analysis(df: DataFrame) -> DataFrame:
    if not has(df, "region", "revenue", "quantity"):
        return nothing(df, "region string, total_revenue double")
    metrics = [total("revenue").alias("total_revenue")]
    metrics += _optional(df, [
        ("gross_profit", "total_profit", total("gross_profit")),
        ("quantity", "total_units", _units("quantity")),
        ("order_id", "total_orders", F.count_distinct("order_id")),
        ("profit_margin", "avg_margin", mean("profit_margin", 4)),
    ])
    grouped = _known(df, "region").groupBy("region").agg(*metrics)
    return grouped.orderBy(F.desc("total_revenue"), "region")


def spending_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("marketing_spend") > 0)


def _per_spend(c: str) -> Column:
    spend = F.col("total_marketing")
    return F.when(spend > 0, round_even(F.col(c) / spend, 2)).otherwise(F.lit(0.0))


def marketing_effectiveness(df: DataFrame) -> DataFrame:
    """Return on ad spend per category over the rows that had spend, best first."""
    if not has(df, "marketing_spend", "category", "revenue"):
        return nothing(df, "category string, total_revenue double, total_marketing double, roas double")
    metrics = [total("revenue").alias("total_revenue"), total("marketing_spend").alias("total_marketing")]
    if has(df, "gross_profit"):
        metrics.append(total("gross_profit").alias("total_profit"))
    out = _known(spending_rows(df), "category").groupBy("category").agg(*metrics)
    out = out.withColumn("roas", _per_spend("total_revenue"))
    if has(df, "gross_profit"):
        out = out.withColumn("profit_per_marketing_dollar", _per_spend("total_profit"))
    return out.orderBy(F.desc("roas"), "category")


def velocity_class(speed: Column, median: Column) -> Column:
    return (
        F.when(speed >= median * FAST, F.lit("High"))
        .when(speed >= median * SLOW, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def stock_cover() -> Column:
    """Days the average stock lasts at the average sales, from the rounded means."""
    speed = F.col("avg_daily_sales")
    return F.when(speed > 0, round_even(F.col("avg_inventory") / speed, 1)).otherwise(F.lit(float("inf")))


def inventory_analysis(df: DataFrame) -> DataFrame:
    """Stock, speed of sale, days of cover and capital per product, most sold first.

    The median speed is worked out by counts of buckets, without holding all products in one place.
    """
    if not has(df, *PRODUCT_KEYS, "inventory_units", "quantity"):
        return nothing(df, "product_id string, product_name string, category string, stock_cover_days double")
    metrics = [
        mean("inventory_units").alias("avg_inventory"),
        mean("quantity").alias("avg_daily_sales"),
        _units("quantity").alias("total_units_sold"),
    ]
    metrics += _optional(df, [
        ("revenue", "total_revenue", total("revenue")),
        ("cost_per_unit", "avg_cost", mean("cost_per_unit")),
    ])
    out = _known(df, *PRODUCT_KEYS).groupBy(*PRODUCT_KEYS).agg(*metrics)
    median = exact_medians(out, ["avg_daily_sales"]).scalar()
    added = {"stock_cover_days": stock_cover()}
    if has(df, "cost_per_unit"):
        added["inventory_capital"] = round_even(F.col("avg_inventory") * F.col("avg_cost"), 2)
    added["velocity_class"] = velocity_class(F.col("avg_daily_sales"), median)
    return out.withColumns(added).orderBy(F.desc("total_units_sold"), "product_id")


def faster_than_median(df: DataFrame) -> DataFrame:
    """Products that sell faster than the median product."""
    products = inventory_analysis(df)
    return products.where(F.col("avg_daily_sales") > exact_medians(products, ["avg_daily_sales"]).scalar())


def velocity_counts(df: DataFrame) -> DataFrame:
    products = inventory_analysis(df)
    return products.groupBy("velocity_class").agg(F.count(F.lit(1)).alias("products"))


def compute_kpis(df: DataFrame) -> DataFrame:
    """One row of headline figures; a figure without its inputs is null, never zero."""

    def offer(c: Column, *needed: str) -> Column:
        return c if has(df, *needed) else F.lit(None).cast("double")

    money = F.coalesce(exact_sum("revenue"), F.lit(0.0)) if has(df, "revenue") else F.lit(0.0)
    base = df.agg(
        money.alias("r"),
        offer(F.coalesce(exact_sum("gross_profit"), F.lit(0.0)) if has(df, "gross_profit") else F.lit(None),
              "gross_profit").alias("p"),
        (F.count_distinct("order_id") if has(df, "order_id") else F.lit(None).cast("bigint")).alias("num_orders"),
        (_units("quantity").cast("bigint") if has(df, "quantity") else F.lit(0).cast("bigint")).alias("units_sold"),
    )
    order_value = F.when(F.col("num_orders") > 0, round_even(F.col("r") / F.col("num_orders"), 2))
    return base.select(
        round_even("r", 2).alias("total_revenue"),
        round_even("p", 2).alias("total_profit"),
        "num_orders",
        "units_sold",
        (order_value if has(df, "revenue") else F.lit(None).cast("double")).alias("avg_order_value"),
        F.when(F.col("r") > 0, round_even(F.col("p") / F.col("r"), 4)).alias("profit_margin"),
    )


def net_revenue_total(df: DataFrame) -> DataFrame:
    return df.agg(total("net_revenue").alias("total_net_revenue"))


def return_rate_by_category(df: DataFrame) -> DataFrame:
    grouped = _known(df, "category").groupBy("category").agg(
        _units("returns").alias("total_returns"), _units("quantity").alias("total_quantity")
    )
    rate = F.when(F.col("total_quantity") > 0, F.col("total_returns") / F.col("total_quantity"))
    return grouped.withColumn("return_rate", rate.otherwise(F.lit(0.0)))


def historical_roas(df: DataFrame) -> DataFrame:
    """Return on ad spend per category and over all of them (category null), zeros without any spend."""
    spend = F.coalesce(F.col("s"), F.lit(0.0))
    profit = exact_sum("gross_profit") if has(df, "gross_profit") else F.lit(0.0)
    per = (
        spending_rows(df)
        .groupBy("category")
        .agg(
            exact_sum("revenue").alias("r"), exact_sum("marketing_spend").alias("s"),
            profit.alias("p"), F.count(F.lit(1)).alias("n"),
        )
    )
    sums = [exact_sum(c).alias(c) for c in ("r", "s", "p")] + [F.coalesce(F.sum("n"), F.lit(0)).alias("data_points")]
    # The overall row is there even when nothing was spent.
    overall = per.agg(*sums).withColumn("category", F.lit(None).cast("string"))
    rolled = per.where(F.col("category").isNotNull()).groupBy("category").agg(*sums).unionByName(overall)
    per_spend = lambda c: F.when(spend > 0, round_even(F.col(c) / F.col("s"), 2)).otherwise(F.lit(0.0))
    return rolled.select(
        "category",
        per_spend("r").alias("roas"),
        round_even(F.coalesce("r", F.lit(0.0)), 2).alias("total_revenue"),
        round_even(spend, 2).alias("total_marketing"),
        per_spend("p").alias("profit_per_marketing_dollar"),
        F.when(F.col("data_points") > 0, round_even(F.col("s") / F.col("data_points"), 2)).alias("avg_daily_spend"),
        "data_points",
    )


def pricing_baseline(df: DataFrame) -> DataFrame:
    """Mean price and quantity per product with a ten percent increase as proposal."""
    grouped = _known(df, "product_id", "product_name").groupBy("product_id", "product_name").agg(
        exact_avg("unit_price").alias("p"), exact_avg("quantity").alias("q")
    )
    return grouped.select(
        "product_id", "product_name",
        round_even("p", 2).alias("current_price"),
        round_even("q", 2).alias("avg_daily_qty"),
        round_even(F.col("p") * 1.1, 2).alias("proposed_price"),
    )


def inventory_baseline(df: DataFrame) -> DataFrame:
    return _known(df, "product_id", "product_name").groupBy("product_id", "product_name").agg(
        mean("inventory_units").alias("avg_inventory"), mean("cost_per_unit").alias("avg_cost")
    )


DEFAULT_MONTHLY_SPEND = 10_000.0


def monthly_spend_baseline(df: DataFrame) -> DataFrame:
    """Spend per 30 selling days, by category and overall (category null)."""
    dates = F.greatest(F.count_distinct("date"), F.lit(1))
    spend = (
        F.coalesce(exact_sum("marketing_spend"), F.lit(0.0)) / dates * 30.0
        if has(df, "marketing_spend") else F.lit(DEFAULT_MONTHLY_SPEND)
    )
    parts = [df.agg(F.lit(None).cast("string").alias("category"), spend.alias("m"))]
    if has(df, "category"):
        parts.insert(0, _known(df, "category").groupBy("category").agg(spend.alias("m")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(
        "category", round_even("m", 2).alias("current_spend"), round_even(F.col("m") * 1.2, 2).alias("proposed_spend")
    )


def history_coverage(df: DataFrame, needed: int = 70) -> DataFrame:
    days = F.coalesce(F.datediff(F.max("date"), F.min("date")) + 1, F.lit(0))
    return df.agg(days.alias("history_days")).withColumn("enough", F.col("history_days") >= needed)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The best-selling products by revenue; sorted within tasks, then merged to n rows."""
    return product_performance(df).orderBy(F.desc("total_revenue"), "product_id").limit(n)


def top_stock_cover(df: DataFrame, n: int = 10) -> DataFrame:
    products = inventory_analysis(df).where(F.col("stock_cover_days") < float("inf"))
    return products.orderBy(F.desc("stock_cover_days"), "product_id").limit(n)


def preview(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The first rows in key order with dates as text."""
    rows = df.orderBy(*order).limit(n)
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd")) if has(df, "date") else rows
