"""Pricing, inventory and marketing what-if scenarios for whole tables of proposals.

Every proposal meets one history row of its product or category; its three
scenarios are computed side by side in that row as an array, so there is no join
or shuffle per scenario, and a recommendation needs no pivot. Proposals meet history in plain joins on
purpose: the planner broadcasts a history it has seen to be small, and otherwise
splits partitions of often-proposed products at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, exact_sum, ratio, round_even
from ..functions.text import RUPEE, fixed, grouped
from ..schema import has
from .analytics import historical_roas

# Scenario factors.
PRICE_SENSITIVITY = {"Conservative": 1.3, "Expected": 1.0, "Optimistic": 0.7}
DEMAND_FACTOR = {"Conservative": 0.75, "Expected": 1.0, "Optimistic": 1.30}
SPEND_EFFICIENCY = {"Conservative": 0.6, "Expected": 0.8, "Optimistic": 1.0}

# Elasticity rules.
DEFAULT_ELASTICITY = -1.2
ELASTICITY_RANGE = (-3.0, -0.3)
ELASTICITY_ROWS = 10
ELASTICITY_CHANGES = 5

DEFAULT_MARGIN = 0.3
MONTH_DAYS = 30.0
ALL_CATEGORIES = "All Categories"

# What a recommendation looks at, first present first, and its labels.
PROFIT_METRICS = ("projected_profit", "net_impact", "profit_change", "expected_profit_change")
COMPARED_METRICS = ("projected_revenue", "expected_revenue_change", "potential_revenue", "projected_profit")
EVIDENCE = (
    "historical_roas", "estimated_elasticity", "historical_daily_velocity", "current_avg_daily_demand",
    "avg_cost_per_unit", "avg_selling_price", "avg_profit_margin",
)


# ---- history ----------------------------------------------------------------


def _product_sums(sales: DataFrame, *keys: str) -> DataFrame:
    known = [c for c in ("cost_per_unit", "revenue") if has(sales, c)]
    name = F.min("product_name") if has(sales, "product_name") else F.min("product_id")
    return sales.where(F.col("product_id").isNotNull()).groupBy(*keys).agg(
        name.alias("product_name"), F.count(F.lit(1)).alias("rows"),
        exact_sum("unit_price").alias("price_sum"), F.count("unit_price").alias("price_n"),
        F.sum("quantity").cast("double").alias("total_qty"), F.count("quantity").alias("qty_n"),
        *[f for c in known for f in (exact_sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))],
    )


def _product_days(sales: DataFrame) -> DataFrame:
    """Sums and counts per product and day, the base of everything said of a product.

    At scale this is far smaller than the order lines, and a hot product is already
    spread over its days.
    """
    return _product_sums(sales, "product_id", "date").withColumn("avg_price", F.try_divide("price_sum", "price_n"))


def daily_price_quantity(sales: DataFrame) -> DataFrame:
    """Mean price, units and rows per product and day."""
    days = _product_days(sales).where(F.col("date").isNotNull())
    return days.select("product_id", "date", "avg_price", "total_qty", "rows")


def _with_changes(days: DataFrame) -> DataFrame:
    w = Window.partitionBy("product_id").orderBy("date")

    def step(c: str) -> Column:
        dated = F.when(F.col("date").isNotNull(), F.col(c))
        return F.try_divide(dated, F.lag(dated).over(w)) - F.lit(1.0)

    return days.withColumns({"price_change": step("avg_price"), "qty_change": step("total_qty")})


def price_changes(sales: DataFrame) -> DataFrame:
    """Relative change of price and units from the previous observed day.

    The window runs over days of a product, at most one row per calendar day.
    """
    return _with_changes(daily_price_quantity(sales))


def _elasticity_parts() -> list[Column]:
    both = F.col("price_change").isNotNull() & F.col("qty_change").isNotNull()
    p, q = F.when(both, F.col("price_change")), F.when(both, F.col("qty_change"))

    def flat(c: str) -> Column:
        dated = F.when(F.col("date").isNotNull(), F.col(c))
        return (F.min(dated) == F.max(dated)) & (F.count(dated) > 1)

    return [
        F.sum("rows").alias("rows"), F.count_if(both).alias("changes"), F.regr_slope(q, p).alias("slope"),
        (F.min(p) < F.max(p)).alias("moves"), flat("avg_price").alias("flat_price"), flat("total_qty").alias("flat_qty"),
    ]


def _elasticity() -> Column:
    no = F.lit(False)
    usable = (
        (F.col("rows") >= ELASTICITY_ROWS) & ~F.coalesce("flat_price", no) & ~F.coalesce("flat_qty", no)
        & (F.col("changes") >= ELASTICITY_CHANGES) & F.coalesce("moves", no) & F.col("slope").isNotNull()
    )
    return F.when(usable, round_even(clamp("slope", *ELASTICITY_RANGE), 2)).otherwise(F.lit(DEFAULT_ELASTICITY))


def _history_parts(days: DataFrame) -> list[Column]:
    def avg(total: Column, n: str) -> Column:
        return F.try_divide(total, F.sum(n))

    parts = [
        F.min("product_name").alias("product_name"), F.sum("total_qty").alias("total_qty"),
        avg(F.sum("total_qty"), "qty_n").alias("avg_qty"), avg(exact_sum("price_sum"), "price_n").alias("avg_price"),
    ]
    if has(days, "cost_per_unit_sum"):
        parts.append(avg(exact_sum("cost_per_unit_sum"), "cost_per_unit_n").alias("avg_cost"))
    if has(days, "revenue_sum"):
        parts.append(F.coalesce(exact_sum("revenue_sum"), F.lit(0.0)).alias("total_revenue"))
    return parts


def price_elasticity(sales: DataFrame) -> DataFrame:
    """Elasticity per product: the slope of unit changes on price changes, clamped.

    The slope equals correlation times the ratio of deviations. Products with too
    little history or no variation, or without a slope, get the default.
    """
    few = _product_days(sales.select("product_id", "date", "quantity", "unit_price"))
    days = _with_changes(few.select("product_id", "date", "avg_price", "total_qty", "rows"))
    per = days.groupBy("product_id").agg(*_elasticity_parts())
    return per.select("product_id", _elasticity().alias("estimated_elasticity"))


def product_history(sales: DataFrame) -> DataFrame:
    """One row per product with the averages and totals scenarios start from.

    Sums over parts of the table combine before the shuffle, so neither days nor a hot product take part in it whole.
    """
    parts = _product_sums(sales, "product_id")
    return parts.groupBy("product_id").agg(*_history_parts(parts))


def product_history_and_elasticity(sales: DataFrame) -> DataFrame:
    """Both, one row per product: only what the elasticity needs is summed up by day and goes through the window."""
    return product_history(sales).join(price_elasticity(sales), "product_id")


def demand_30d(base: DataFrame, forecast: DataFrame | None) -> DataFrame:
    """Adds ``demand``: the forecast if there is one and it is not zero, else thirty
    times the mean quantity; ``from_forecast`` tells which."""
    if forecast is not None:
        totals = forecast.select("product_id", F.col("demand_30d").alias("forecast"))
        base = base.join(totals, "product_id", "left")
    else:
        base = base.withColumn("forecast", F.lit(None).cast("double"))
    known = F.nullif("forecast", F.lit(0.0))
    return base.withColumns({
        "from_forecast": known.isNotNull(), "demand": F.coalesce(known, F.col("avg_qty") * MONTH_DAYS)})


def _with_product(proposals: DataFrame, history: DataFrame, forecast: DataFrame | None) -> DataFrame:
    joined = proposals.join(history.withColumn("known", F.lit(True)), "product_id", "left")
    missing = F.concat(F.lit("No data found for product "), F.col("product_id"))
    joined = joined.withColumn("error", F.when(F.col("known").isNull(), missing)).drop("known")
    return demand_30d(joined, forecast)


def _scenarios(factors: dict[str, float], metrics: Callable[[float], dict[str, Column]]) -> Column:
    rows = F.array(*[
        F.struct(F.lit(name).alias("scenario"), *[c.alias(m) for m, c in metrics(f).items()])
        for name, f in factors.items()
    ])
    return F.when(F.col("error").isNull(), rows).alias("scenarios")


def _texts(*items) -> Column:
    return F.array(*[i if isinstance(i, Column) else F.lit(i) for i in items])


def _say(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


# ---- the three simulators ---------------------------------------------------


def simulate_pricing(sales: DataFrame, proposals: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Proposals (product_id, current_price, proposed_price) with summary and scenarios."""
    base = _with_product(proposals, product_history_and_elasticity(sales), forecast)
    now, new, cost, demand = (F.col(c) for c in ("current_price", "proposed_price", "avg_cost", "demand"))
    step = ratio(new - now, now)
    margin_now, margin_new = ratio(now - cost, now), ratio(new - cost, new)
    elasticity = F.coalesce("estimated_elasticity", F.lit(DEFAULT_ELASTICITY))
    even = ratio("total_revenue", new)

    def metrics(sensitivity: float) -> dict[str, Column]:
        shift = F.col("__step") * elasticity * F.lit(sensitivity)
        units = F.greatest(F.lit(0.0), demand * (1.0 + shift))
        revenue, profit = units * new, units * new - units * cost
        return {
            "projected_demand": round_even(units, 0),
            "demand_change_pct": round_even(shift * 100.0, 1),
            "projected_revenue": round_even(revenue, 2),
            "projected_profit": round_even(profit, 2),
            "revenue_change": round_even(revenue - demand * now, 2),
            "profit_change": round_even(profit - demand * (now - cost), 2),
        }

    source = F.when(F.col("from_forecast"), "ML forecast").otherwise("historical average")
    return base.withColumn("__step", step).select(
        *proposals.columns, "product_name", "error",
        round_even(step * 100.0, 1).alias("price_change_pct"),
        round_even(margin_now, 4).alias("current_margin"), round_even(margin_new, 4).alias("proposed_margin"),
        round_even((margin_new - margin_now) * 100.0, 2).alias("margin_change"),
        F.when(F.col("error").isNull(), elasticity).alias("estimated_elasticity"),
        round_even(cost, 2).alias("avg_cost_per_unit"),
        round_even("avg_qty", 1).alias("current_avg_daily_demand"),
        round_even(demand, 0).alias("base_demand_30d"),
        round_even(even, 0).alias("break_even_volume"),
        round_even((ratio(even, "total_qty", None) - 1.0) * 100.0, 1).alias("break_even_change_pct"),
        _scenarios(PRICE_SENSITIVITY, metrics),
        _texts(
            _say("Elasticity of ", elasticity, " taken from price and unit changes in the past."),
            "It shows how both moved together, not what caused it.",
            "Competitors keep their prices and supply is not disrupted.",
            _say("Base demand of ", fixed(demand, 0), " units a month (", source, ")."),
        ).alias("assumptions"),
        _texts("Competitors may follow the price.", "Customers may react otherwise than before.",
               "Season may strengthen or weaken the effect.").alias("risks"),
        _texts("Daily units for two weeks after the change.", "Customers won and lost.",
               "Actual against projected demand.", "Competitor prices.").alias("monitoring"),
    )


def simulate_inventory(sales: DataFrame, proposals: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Proposals (product_id, current_inventory, proposed_purchase) with summary and scenarios."""
    base = _with_product(proposals, product_history(sales), forecast)
    stock = F.col("current_inventory") + F.col("proposed_purchase")
    cost, price, demand = F.col("avg_cost"), F.col("avg_price"), F.col("demand")
    capital = F.col("proposed_purchase") * cost

    def metrics(factor: float) -> dict[str, Column]:
        wanted = demand * F.lit(factor)
        left, sold = stock - wanted, F.least(wanted, stock.cast("double"))
        cover = F.when(wanted > 0, round_even(stock / (wanted / MONTH_DAYS), 1))
        return {
            "scenario_demand": round_even(wanted, 0),
            "remaining_inventory": round_even(left, 0),
            "stock_cover_days": cover,
            "potential_revenue": round_even(sold * price, 2),
            "potential_profit": round_even(sold * (price - cost), 2),
            "surplus_units": round_even(F.greatest(F.lit(0.0), left), 0),
            "stockout_risk": left < 0,
        }

    source = F.when(F.col("from_forecast"), "ML Forecast").otherwise("Historical Average")
    return base.select(
        *proposals.columns, "product_name", "error",
        stock.alias("total_after_purchase"), round_even(capital, 2).alias("capital_required"),
        round_even(cost, 2).alias("avg_cost_per_unit"), round_even(price, 2).alias("avg_selling_price"),
        round_even("avg_qty", 1).alias("historical_daily_velocity"),
        round_even(demand, 0).alias("expected_demand_30d"),
        F.when(F.col("error").isNull(), source).alias("demand_source"),
        _scenarios(DEMAND_FACTOR, metrics),
        _texts(
            _say("Unit cost ", RUPEE, fixed(cost, 2), " (average of the past)."),
            _say("Demand of ", fixed(demand, 0), " units a month (", F.lower(source), ")."),
            "Delivery time and holding costs are left out.", "Season may change the outcome.",
        ).alias("assumptions"),
        _texts("Demand may stay below the estimate.", "Unsold stock may spoil or age.",
               _say("Capital of ", RUPEE, grouped(capital, 0), " is tied up."),
               "Storage lowers the profit.").alias("risks"),
        _texts("Daily sales after restocking.", "Turnover every week.", "Actual against estimated demand.",
               "Slow-moving stock.").alias("monitoring"),
    )


def category_margin(sales: DataFrame) -> DataFrame:
    """Mean row margin per category and over all (category null), all rows counted."""
    if not has(sales, "profit_margin"):
        return historical_roas(sales).select("category", F.lit(DEFAULT_MARGIN).alias("avg_margin"))
    per = sales.groupBy("category").agg(
        exact_sum("profit_margin").alias("s"), F.count("profit_margin").alias("n"))
    rolled = per.rollup("category").agg(
        F.grouping_id().alias("g"), exact_sum("s").alias("s"), F.sum("n").alias("n"))
    rows = rolled.where((F.col("g") == 1) | F.col("category").isNotNull())
    return rows.select("category", F.try_divide("s", "n").alias("avg_margin"))


def simulate_marketing(sales: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals (category or null for all, current_spend, proposed_spend) with summary and scenarios."""
    label = F.coalesce(F.col("category"), F.lit(ALL_CATEGORIES))
    roas = historical_roas(sales).select(
        label.alias("__key"), F.col("roas").alias("historical_roas"), F.col("data_points"))
    margins = category_margin(sales).select(label.alias("__key"), "avg_margin")
    history = roas.join(margins, "__key", "left")
    base = proposals.withColumn("__key", label).join(history, "__key", "left")
    r, margin = F.col("historical_roas"), F.col("avg_margin")
    none = (F.coalesce(r, F.lit(0.0)) == 0.0)
    base = base.withColumn("error", F.when(none, F.lit("No historical marketing data available for estimation.")))
    spend = F.col("proposed_spend") - F.col("current_spend")

    def metrics(efficiency: float) -> dict[str, Column]:
        revenue = spend * r * F.lit(efficiency)
        profit = revenue * margin
        net = profit - spend
        return {
            "expected_revenue_change": round_even(revenue, 2),
            "expected_profit_change": round_even(profit, 2),
            "additional_cost": round_even(spend, 2),
            "net_impact": round_even(net, 2),
            "effective_roas": round_even(r * F.lit(efficiency), 2),
            "is_profitable": net > 0,
        }

    ok = F.col("error").isNull()
    return base.select(
        *[c for c in proposals.columns if c != "category"], F.col("__key").alias("category"), "error",
        F.when(ok, round_even(spend, 2)).alias("spend_change"),
        F.when(ok, round_even(ratio(spend, "current_spend") * 100.0, 1)).alias("spend_change_pct"),
        F.when(ok, r).alias("historical_roas"),
        F.when(ok & (margin > 0), round_even(1.0 / margin, 2)).alias("break_even_roas"),
        F.when(ok, round_even(margin, 4)).alias("avg_profit_margin"),
        _scenarios(SPEND_EFFICIENCY, metrics),
        _texts(
            _say("Return on spend of ", fixed(r, 1), "x over ", F.col("data_points"), " rows."),
            "It shows how spend and revenue moved together, not what caused it.",
            "Diminishing returns are covered by efficiency factors.",
            _say("Average margin of ", fixed(margin * 100.0, 1), "%."),
            "Competitors and market stay as they were.",
        ).alias("assumptions"),
        _texts("Returns may differ from the past.", "Competitors may change their spend.",
               "Season may strengthen or weaken the effect.", "Channels may be saturated.").alias("risks"),
        _texts("Return on spend every week.", "Cost per new customer.", "Actual against projected revenue.",
               "Competitor marketing.").alias("monitoring"),
    )


# ---- scenario tables and recommendations ------------------------------------


def scenario_rows(decisions: DataFrame, *keep: str) -> DataFrame:
    """One row per proposal and scenario."""
    return decisions.select(*keep, F.explode("scenarios").alias("s")).select(*keep, "s.*")


def _metric_names(decisions: DataFrame) -> list[str]:
    return decisions.schema["scenarios"].dataType.elementType.names


def _of(scenario: str, metric: str) -> Column:
    rows = F.filter("scenarios", lambda s: s["scenario"] == scenario)
    return F.get(rows, F.lit(0))[metric]


def scenario_metric(decisions: DataFrame) -> str | None:
    """The metric scenarios are compared by: the first one of the fixed list present."""
    return next((m for m in COMPARED_METRICS if m in _metric_names(decisions)), None)


def recommendation(decisions: DataFrame) -> Column:
    """(recommendation, confidence, explanation) judged by the expected scenario with
    the conservative one as a check. Stock decisions carry no metric of the list and
    always need a review; prices are judged by the level of profit, not its change."""
    metric = next((m for m in PROFIT_METRICS if m in _metric_names(decisions)), None)

    def verdict(name, confidence, explanation) -> Column:
        return F.struct(
            F.lit(name).alias("recommendation"), F.lit(confidence).alias("confidence"),
            (explanation if isinstance(explanation, Column) else F.lit(explanation)).alias("explanation"))

    too_little = verdict("Insufficient data", "Low", "There are no scenarios to judge by.")
    if metric is None:
        judged = verdict("Review required", "Low", "The scenarios do not tell whether it pays.")
    else:
        expected, careful = _of("Expected", metric), _of("Conservative", metric)
        shown, careful_shown = _say(RUPEE, grouped(expected, 0)), _say(RUPEE, grouped(careful, 0))
        judged = (
            F.when((expected > 0) & (careful > 0), verdict(
                "Favorable", "Moderate-High",
                _say("Positive even in the conservative scenario; ", shown, " expected.")))
            .when(expected > 0, verdict(
                "Proceed with Caution", "Moderate",
                _say("Positive as expected (", shown, "), but the conservative scenario gives ", careful_shown, ".")))
            .otherwise(verdict("Reconsider", "Moderate", _say("The expected result is ", shown, ".")))
        )
    return F.when(F.col("scenarios").isNull(), too_little).otherwise(judged)


def with_recommendation(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("r", recommendation(decisions)).select(*decisions.columns, "r.*")
