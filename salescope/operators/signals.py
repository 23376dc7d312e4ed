"""Rule-based business signals over the aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact_sum, round_even, total
from ..functions.text import RUPEE, fixed, grouped
from ..plans.quantiles import beside, exact_medians
from ..plans.session import written
from ..schema import PRODUCT_KEYS, has, nothing
from .analytics import (
    inventory_analysis, marketing_effectiveness, monthly_revenue, return_rate_by_category, stock_cover, year_month,
)

# Thresholds of the rules.
LEAST_ROWS = 100
LEAST_MONTHS = 2
MARGIN_MONTHS, REVENUE_MONTHS = 3, 4
MARGIN_DROP = 0.9
REVENUE_CHANGE_PCT = 15
HIGH_RETURN_RATE = 0.05
LOW_ROAS = 0.5
HIGH_COVER_DAYS = 90
EDGE = 3

SIGNAL_DDL = (
    "type string, entity string, severity string, value double, baseline double, change_pct double,"
    " title string, what string, why string, so_what string"
)


def first_last_months(df: DataFrame) -> DataFrame:
    """Monthly rows of the first and last three months, marked by position."""
    return _edges(monthly_revenue(df))


def _edges(monthly: DataFrame) -> DataFrame:
    """The windows run over the monthly table only, one row per calendar month."""
    return monthly.withColumns({
        "from_start": F.row_number().over(Window.orderBy("year_month")),
        "from_end": F.row_number().over(Window.orderBy(F.desc("year_month"))),
    }).where((F.col("from_start") <= EDGE) | (F.col("from_end") <= EDGE))


def trend(df: DataFrame) -> DataFrame:
    """One row: months, rows and the means of the first and last three months."""
    return _trend(monthly_revenue(df), df.agg(F.count(F.lit(1)).alias("rows")))


def _trend(monthly: DataFrame, rows: DataFrame) -> DataFrame:
    edges = _edges(monthly)

    def edge(c: str, side: str) -> Column:
        return F.avg(F.when(F.col(side) <= EDGE, F.col(c)))

    measures = [c for c in ("avg_profit_margin", "total_revenue") if c in edges.columns]
    months = F.coalesce(F.max(F.greatest(F.col("from_start"), F.col("from_end"))), F.lit(0))
    out = edges.agg(
        months.alias("months"),
        *[edge(c, "from_start").alias(f"early_{c}") for c in measures],
        *[edge(c, "from_end").alias(f"late_{c}") for c in measures],
    )
    return beside(out, rows)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _shape(df: DataFrame, kind, entity, severity, value, baseline, change, title, what, why, so_what) -> DataFrame:
    def c(v, t="string"):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return df.select(
        c(kind).alias("type"), c(entity).alias("entity"), c(severity).alias("severity"),
        c(value, "double").alias("value"), c(baseline, "double").alias("baseline"), c(change, "double").alias("change_pct"),
        c(title).alias("title"), c(what).alias("what"), c(why).alias("why"), c(so_what).alias("so_what"),
    )


def _open() -> Column:
    return (F.col("rows") >= LEAST_ROWS) & (F.col("months") >= LEAST_MONTHS)


def margin_signal(df: DataFrame) -> DataFrame:
    if not has(df, "date", "revenue", "profit_margin"):
        return nothing(df, SIGNAL_DDL)
    return _margin(trend(df))


def _margin(months: DataFrame) -> DataFrame:
    late, early = F.col("late_avg_profit_margin"), F.col("early_avg_profit_margin")
    hit = months.where(_open() & (F.col("months") >= MARGIN_MONTHS) & (early > 0) & (late < early * MARGIN_DROP))
    drop = round_even((1.0 - late / early) * 100.0, 1)
    return _shape(
        hit, "margin", None, "warning", late, early, drop, "Declining Profit Margin",
        _text("The profit margin fell by ", fixed(drop, 1), "% from the first to the last months."),
        _text("Last months ", fixed(late * 100.0, 2), "%, first months ", fixed(early * 100.0, 2), "%."),
        "More revenue may not bring more profit. Look at discounts and costs.",
    )


def revenue_signal(df: DataFrame) -> DataFrame:
    if not has(df, "date", "revenue"):
        return nothing(df, SIGNAL_DDL)
    return _revenue(trend(df))


def _revenue(months: DataFrame) -> DataFrame:
    late, early = F.col("late_total_revenue"), F.col("early_total_revenue")
    change = round_even((late / early - 1.0) * 100.0, 1)
    hit = months.where(_open() & (F.col("months") >= REVENUE_MONTHS) & (early > 0)).withColumn("change", change)
    hit = hit.where(F.abs("change") > REVENUE_CHANGE_PCT)
    up = F.col("change") > 0
    return _shape(
        hit, "revenue", None, F.when(up, "info").otherwise("warning"), late, early, F.col("change"),
        F.when(up, "Revenue Growth Detected").otherwise("Revenue Decline Detected"),
        _text("Revenue ", F.when(up, "rose").otherwise("fell"), " by ", fixed(F.abs("change"), 1),
              "% from the first to the last months."),
        _text("Last months ", RUPEE, grouped(late, 0), ", first months ", RUPEE, grouped(early, 0), "."),
        F.when(up, "Check whether the growth will last or is seasonal.")
        .otherwise("Find out whether season, competition or structure is behind it."),
    )


def returns_signal(df: DataFrame) -> DataFrame:
    if not has(df, "returns", "quantity", "category"):
        return nothing(df, SIGNAL_DDL)
    return _returns(return_rate_by_category(df))


def _returns(rates: DataFrame) -> DataFrame:
    rate = F.col("return_rate")
    hit = rates.where(rate > HIGH_RETURN_RATE)
    return _shape(
        hit, "returns", F.col("category"), "warning", rate, HIGH_RETURN_RATE, None,
        _text("High Return Rate: ", F.col("category")),
        _text(F.col("category"), " has a return rate of ", fixed(rate * 100.0, 1), "%."),
        _text(F.col("total_returns").cast("bigint").cast("string"), " of ",
              F.col("total_quantity").cast("bigint").cast("string"), " sold units came back."),
        "Returns lower net revenue and may point to quality or sizing.",
    )


def roas_signal(df: DataFrame) -> DataFrame:
    if not has(df, "marketing_spend", "category", "revenue"):
        return nothing(df, SIGNAL_DDL)
    return _roas(marketing_effectiveness(df))


def _roas(rows: DataFrame) -> DataFrame:
    hit = beside(rows, exact_medians(rows, ["roas"])).where(
        F.col("roas") < F.col("median_roas") * LOW_ROAS)
    return _shape(
        hit, "marketing", F.col("category"), "info", F.col("roas"), F.col("median_roas"), None,
        _text("Low Marketing ROAS: ", F.col("category")),
        _text(F.col("category"), " returns ", fixed("roas", 1), "x its ad spend."),
        _text(RUPEE, grouped("total_marketing", 0), " of spend stands beside ", RUPEE, grouped("total_revenue", 0),
              " of revenue."),
        "The spend may not pay off in proportion. Consider moving it.",
    )


def inventory_signal(df: DataFrame) -> DataFrame:
    if not has(df, "product_id", "product_name", "category", "inventory_units", "quantity"):
        return nothing(df, SIGNAL_DDL)
    return _inventory(inventory_analysis(df))


def _inventory(products: DataFrame) -> DataFrame:
    cover = F.col("stock_cover_days")
    hit = products.where((cover > HIGH_COVER_DAYS) & (cover < float("inf")))
    return _shape(
        hit, "inventory", F.col("product_id"), "info", cover, HIGH_COVER_DAYS, None,
        _text("High Inventory: ", F.col("product_name")),
        _text(F.col("product_name"), " has stock for ", fixed(cover, 0), " days."),
        _text("Average stock ", fixed("avg_inventory", 0), " units, average daily sales ", fixed("avg_daily_sales", 1),
              " units."),
        "Stock ties up capital. Consider promotions or smaller reorders.",
    )


def _shared(df: DataFrame) -> dict[str, DataFrame]:
    """The tables all five rules need, rolled up from one pre-aggregate of the lines.

    Month and product rows are far fewer than order lines. They are written once and
    every roll-up starts from them: left as a plan, each rule would prune the
    aggregate to its own columns and read all order lines again.
    """
    spent = F.col("marketing_spend") > 0

    def spending(c: str) -> Column:
        return exact_sum(F.when(spent, F.col(c)))

    pre = written(df.groupBy(year_month().alias("year_month"), *PRODUCT_KEYS).agg(
        F.count(F.lit(1)).alias("lines"), exact_sum("revenue").alias("revenue"),
        exact_sum("profit_margin").alias("margin"), F.count("profit_margin").alias("margins"),
        F.sum("returns").alias("returns"), F.sum("quantity").alias("quantity"), F.count("quantity").alias("sold"),
        exact_sum("inventory_units").alias("stock"), F.count("inventory_units").alias("stocks"),
        spending("revenue").alias("spent_revenue"), spending("marketing_spend").alias("spend"),
    ), "signals")

    def mean_of(c: str, n: str, digits: int) -> Column:
        return round_even(F.try_divide(exact_sum(c), F.sum(n)), digits)

    monthly = pre.where(F.col("year_month").isNotNull()).groupBy("year_month").agg(
        total("revenue").alias("total_revenue"), mean_of("margin", "margins", 4).alias("avg_profit_margin"))
    by_category = pre.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.sum("returns").alias("total_returns"), F.sum("quantity").alias("total_quantity"),
        total("spent_revenue").alias("total_revenue"), total("spend").alias("total_marketing"))
    rate = F.when(F.col("total_quantity") > 0, F.col("total_returns") / F.col("total_quantity")).otherwise(F.lit(0.0))
    products = pre.dropna(subset=list(PRODUCT_KEYS)).groupBy(*PRODUCT_KEYS).agg(
        mean_of("stock", "stocks", 2).alias("avg_inventory"), mean_of("quantity", "sold", 2).alias("avg_daily_sales"))
    return {
        "months": _trend(monthly, pre.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("rows"))),
        "rates": by_category.withColumn("return_rate", rate),
        "roas": by_category.where(F.col("total_marketing") > 0).withColumn(
            "roas", round_even(F.col("total_revenue") / F.col("total_marketing"), 2)),
        "products": products.withColumn("stock_cover_days", stock_cover()),
        "gate": pre.agg(
            F.coalesce(F.sum("lines"), F.lit(0)).alias("rows"), F.count_distinct("year_month").alias("months")),
    }


SHARED_COLUMNS = (*PRODUCT_KEYS, "date", "revenue", "profit_margin", "returns", "quantity", "inventory_units", "marketing_spend")


def signals(df: DataFrame) -> DataFrame:
    """All signals; none for tables without dates, under 100 rows or under two months."""
    if not has(df, "date", "revenue"):
        return nothing(df, SIGNAL_DDL)
    if has(df, *SHARED_COLUMNS):
        t = _shared(df)
        gate, trends = t["gate"], _margin(t["months"]).unionByName(_revenue(t["months"]))
        others = _returns(t["rates"]).unionByName(_roas(t["roas"])).unionByName(_inventory(t["products"]))
    else:
        gate = df.agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct(year_month()).alias("months"))
        trends = margin_signal(df).unionByName(revenue_signal(df))
        others = returns_signal(df).unionByName(roas_signal(df)).unionByName(inventory_signal(df))
    return trends.unionByName(beside(others, gate).where(_open()).drop("rows", "months"))
