"""Elasticity, scenarios, recommendations and contracts for tables of proposals."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import contracts, decisions as ops
from ..plans.registry import query
from ..plans.session import written

_DAILY = """select product_id, date, XA[unit_price] as avg_price, cast(sum(quantity) as double) as total_qty,
count(*) as rows from sales group by product_id, date"""
_CHANGES = f"""select *, avg_price/nullif(lag(avg_price) over w, 0) - 1e0 as price_change,
total_qty/nullif(lag(total_qty) over w, 0) - 1e0 as qty_change from ({_DAILY}) d window w as (partition by product_id order by date)"""
_ELASTIC = f"""select product_id, case when n < 10 or fp or fq or k < 5 or not mv or sl is null then -1.2e0
else R2[greatest(least(sl, -0.3e0), -3e0)] end as estimated_elasticity from (
select product_id, sum(rows) as n, count(*) filter (where price_change is not null and qty_change is not null) as k,
regr_slope(qty_change, price_change) as sl,
coalesce(min(price_change) filter (where qty_change is not null) < max(price_change) filter (where qty_change is not null), false) as mv,
min(avg_price) = max(avg_price) and count(*) > 1 as fp, min(total_qty) = max(total_qty) and count(*) > 1 as fq
from ({_CHANGES}) c group by product_id) e"""
_HISTORY = """select product_id, min(product_name) as product_name, XA[quantity] as aq, XA[cost_per_unit] as ac,
XA[unit_price] as ap, XS[revenue] as tr, cast(sum(quantity) as double) as tq from sales group by product_id"""
_FORECAST = """select product_id, case when cast(product_id as bigint) % 3 = 0 then 0e0
else cast(sum(quantity) as double)/10e0 end as demand_30d from sales where cast(product_id as bigint) % 2 = 0 group by product_id"""
_PRICED = f"""select p.*, h.*exclude(product_id), coalesce(nullif(f.demand_30d, 0e0), aq*30e0) as d, estimated_elasticity as e,
case when current_price > 0 then (proposed_price-current_price)/current_price else 0e0 end as st
from price_proposals p left join ({_HISTORY}) h on p.product_id = h.product_id
left join ({_ELASTIC}) el on p.product_id = el.product_id left join ({_FORECAST}) f on p.product_id = f.product_id"""
_PRICE_ROWS = f"""select product_id, current_price, proposed_price, scenario, R0[u] as projected_demand,
R1[sh*100e0] as demand_change_pct, R2[u*proposed_price] as projected_revenue,
R2[u*proposed_price-u*ac] as projected_profit, R2[u*proposed_price-d*current_price] as revenue_change,
R2[u*proposed_price-u*ac-d*(current_price-ac)] as profit_change
from (select *, greatest(0e0, d*(1e0+sh)) as u from (select *, st*e*s as sh from ({_PRICED}) b,
(values ('Conservative', 1.3e0), ('Expected', 1e0), ('Optimistic', 0.7e0)) x(scenario, s) where aq is not null) y) z"""
_PRICE_SUMMARY = f"""select product_id, current_price, proposed_price, product_name,
case when aq is null then 'No data found for product ' || product_id end as error, R1[st*100e0] as price_change_pct,
R4[mn] as current_margin, R4[mp] as proposed_margin, R2[(mp-mn)*100e0] as margin_change, e as estimated_elasticity,
R2[ac] as avg_cost_per_unit, R1[aq] as current_avg_daily_demand, R0[d] as base_demand_30d,
R0[tr/proposed_price] as break_even_volume, R1[((tr/proposed_price)/tq-1e0)*100e0] as break_even_change_pct
from (select *, (current_price-ac)/current_price as mn, (proposed_price-ac)/proposed_price as mp from ({_PRICED}) b) c"""
_STOCKED = f"""select p.*, h.*exclude(product_id), coalesce(nullif(f.demand_30d, 0e0), aq*30e0) as d,
nullif(f.demand_30d, 0e0) is not null as ml, current_inventory+proposed_purchase as t
from stock_proposals p left join ({_HISTORY}) h on p.product_id = h.product_id
left join ({_FORECAST}) f on p.product_id = f.product_id"""
_STOCK_ROWS = f"""select product_id, scenario, R0[w] as scenario_demand, R0[t-w] as remaining_inventory,
case when w > 0 then R1[t/(w/30e0)] end as stock_cover_days, R2[least(w, t)*ap] as potential_revenue,
R2[least(w, t)*(ap-ac)] as potential_profit, R0[greatest(0e0, t-w)] as surplus_units, t-w < 0 as stockout_risk
from (select *, d*s as w from ({_STOCKED}) b,
(values ('Conservative', 0.75e0), ('Expected', 1e0), ('Optimistic', 1.3e0)) x(scenario, s)) y"""
_ROAS = """select category, R2[r/s] as roas, n from (
select category, XS[revenue] as r, XS[marketing_spend] as s, count(*) as n from sales where marketing_spend > 0 group by 1) q"""
_SPEND = f"""select p.*, roas, m, proposed_spend-current_spend as ds from spend_proposals p
join ({_ROAS}) r on p.category = r.category
join (select category, XA[profit_margin] as m from sales group by 1) g on p.category = g.category"""
_SPEND_ROWS = f"""select category, scenario, R2[ds*roas*s] as expected_revenue_change,
R2[ds*roas*s*m] as expected_profit_change, R2[ds] as additional_cost, R2[ds*roas*s*m-ds] as net_impact,
R2[roas*s] as effective_roas, ds*roas*s*m-ds > 0 as is_profitable from ({_SPEND}) b,
(values ('Conservative', 0.6e0), ('Expected', 0.8e0), ('Optimistic', 1e0)) x(scenario, s)"""


def _verdicts(rows, key, metric):
    return f"""select {key}, case when e > 0 and c > 0 then 'Favorable' when e > 0 then 'Proceed with Caution'
else 'Reconsider' end as recommendation, case when e > 0 and c > 0 then 'Moderate-High' else 'Moderate' end as confidence
from (select {key}, max(case when scenario = 'Expected' then {metric} end) as e,
max(case when scenario = 'Conservative' then {metric} end) as c from ({rows}) s group by 1) v"""


def forecast_fixture(sales):
    """Stands in for a 30-day forecast: half of the products have one, some are zero."""
    pid = F.col("product_id").try_cast("bigint")
    return sales.where(pid % 2 == 0).groupBy("product_id").agg(F.sum("quantity").alias("q")).select(
        "product_id", F.when(pid % 3 == 0, F.lit(0.0)).otherwise(F.col("q").cast("double") / 10.0).alias("demand_30d"))


#: What the simulators, the proposals and the forecast read of an order line.
READ = ("product_id", "product_name", "category", "date", "quantity", "unit_price", "cost_per_unit", "revenue",
        "marketing_spend", "profit_margin", "inventory_units")


def _lines(spark, sf):
    """The order lines, written once for all that a simulation reads of them.

    The lines of a product lie together, so sums per product combine before they are shuffled; of a product with very
    many lines, Spark splits the partition.
    """
    return written(view(spark, sf, "sales").select(*READ).hint("rebalance", F.col("product_id")), "sales", "zstd")


def _pricing(spark, sf, sales=None):
    sales = sales or _lines(spark, sf)
    return ops.simulate_pricing(sales, view(spark, sf, "price_proposals", sales=sales), forecast_fixture(sales))


def _inventory(spark, sf, sales=None):
    sales = sales or _lines(spark, sf)
    return ops.simulate_inventory(sales, view(spark, sf, "stock_proposals", sales=sales), forecast_fixture(sales))


def _marketing(spark, sf, sales=None):
    sales = sales or _lines(spark, sf)
    return ops.simulate_marketing(sales, view(spark, sf, "spend_proposals", sales=sales))


def _three(spark, sf, make):
    """Pricing, inventory and marketing decisions on the same lines, as one table."""
    sales = _lines(spark, sf)
    return (make(_pricing(spark, sf, sales), "product_id").unionByName(make(_inventory(spark, sf, sales), "product_id"))
            .unionByName(make(_marketing(spark, sf, sales), "category")))


def _all_proposals(spark, sf, sales):
    return {
        contracts.PRICING: view(spark, sf, "price_proposals", sales=sales),
        contracts.INVENTORY: view(spark, sf, "stock_proposals", sales=sales),
        contracts.MARKETING: view(spark, sf, "spend_proposals", sales=sales),
    }


NESTED = ("scenarios", "assumptions", "risks", "monitoring")

query("daily_price_qty", _DAILY)(lambda spark, sf: ops.daily_price_quantity(view(spark, sf, "sales")))
query("pct_change", f"select product_id, date, R4[price_change] as price_change, R4[qty_change] as qty_change from ({_CHANGES}) c")(
    lambda spark, sf: ops.price_changes(view(spark, sf, "sales")).select(
        "product_id", "date", *[(F.rint(F.col(c) * 1e4) / 1e4 + 0.0).alias(c) for c in ("price_change", "qty_change")]))
query("price_elasticity", _ELASTIC)(lambda spark, sf: ops.price_elasticity(view(spark, sf, "sales")))
query("pricing_scenarios", _PRICE_ROWS)(
    lambda spark, sf: ops.scenario_rows(_pricing(spark, sf), "product_id", "current_price", "proposed_price"))
query("pricing_summary", _PRICE_SUMMARY)(lambda spark, sf: _pricing(spark, sf).drop(*NESTED))
query("empty_selection", f"select product_id, error from ({_PRICE_SUMMARY}) s where error is not null")(
    lambda spark, sf: _pricing(spark, sf).where("error is not null").select("product_id", "error"))
query("inventory_scenarios", _STOCK_ROWS)(lambda spark, sf: ops.scenario_rows(_inventory(spark, sf), "product_id"))
query("inventory_summary", f"""
select product_id, current_inventory, proposed_purchase, product_name, cast(null as varchar) as error,
       t as total_after_purchase, R2[proposed_purchase*ac] as capital_required, R2[ac] as avg_cost_per_unit,
       R2[ap] as avg_selling_price, R1[aq] as historical_daily_velocity, R0[d] as expected_demand_30d,
       case when ml then 'ML Forecast' else 'Historical Average' end as demand_source from ({_STOCKED}) b""")(
    lambda spark, sf: _inventory(spark, sf).drop(*NESTED))
query("marketing_scenarios", _SPEND_ROWS)(lambda spark, sf: ops.scenario_rows(_marketing(spark, sf), "category"))
query("marketing_summary", f"""
select current_spend, proposed_spend, category, cast(null as varchar) as error, R2[ds] as spend_change,
       case when current_spend > 0 then R1[ds/current_spend*100e0] else 0e0 end as spend_change_pct,
       roas as historical_roas, case when m > 0 then R2[1e0/m] end as break_even_roas, R4[m] as avg_profit_margin
from ({_SPEND}) b""")(lambda spark, sf: _marketing(spark, sf).drop(*NESTED))


def _judged(df, key):
    return ops.with_recommendation(df).select(F.col(key).alias("entity"), "recommendation", "confidence")


query("recommendation", f"""
select product_id as entity, recommendation, confidence from ({_verdicts(_PRICE_ROWS, 'product_id', 'projected_profit')}) p
union all select 'UNKNOWN', 'Insufficient data', 'Low'
union all select product_id, 'Review required', 'Low' from stock_proposals
union all select category, recommendation, confidence from ({_verdicts(_SPEND_ROWS, 'category', 'net_impact')}) m""")(
    lambda spark, sf: _three(spark, sf, _judged))


def _long(df, key):
    return df.select(F.col(key).alias("entity"), F.explode(contracts.scenario_results(df)).alias("x")).select("entity", "x.*")


def _unpivot(rows, key, metrics):
    return " union all ".join(
        f"select {key} as entity, scenario, '{m}' as metric, cast({m} as double) as value from ({rows}) r" for m in metrics)


query("scenario_long", _unpivot(_SPEND_ROWS, "category", [
    "expected_revenue_change", "expected_profit_change", "additional_cost", "net_impact", "effective_roas",
    "is_profitable"]))(lambda spark, sf: _long(_marketing(spark, sf), "category"))


def _compared(df, key):
    metric = ops.scenario_metric(df)
    return ops.scenario_rows(df, key).select(
        F.col(key).alias("entity"), "scenario", F.lit(metric).alias("metric"), F.col(metric).alias("value"))


query("scenario_metric", f"""
select product_id as entity, scenario, 'projected_revenue' as metric, projected_revenue as value from ({_PRICE_ROWS}) p
union all select product_id, scenario, 'potential_revenue', potential_revenue from ({_STOCK_ROWS}) i
union all select category, scenario, 'expected_revenue_change', expected_revenue_change from ({_SPEND_ROWS}) m""")(
    lambda spark, sf: _three(spark, sf, _compared))

query("decision_contracts")(
    lambda spark, sf: contracts.decision_contracts(_pricing(spark, sf), contracts.PRICING, run="check"))


def _all_contracts(spark, sf):
    sales = _lines(spark, sf)
    return contracts.run_decisions(sales, _all_proposals(spark, sf, sales), forecast_fixture(sales))


query("run_decisions")(lambda spark, sf: _all_contracts(spark, sf).select(
    "decision_id", "decision_type", contracts.decision_label().alias("label"), "recommendation.recommendation", "status"))


def _results(spark, sf):
    """Every proposal of the three types with its status, and the expected profit that its contract holds."""
    sales = _lines(spark, sf)
    made = contracts.run_results(sales, _all_proposals(spark, sf, sales), forecast_fixture(sales))
    profit = F.coalesce(*[F.try_element_at("contract.expected_outcome", F.lit(m)) for m in (
        "projected_profit", "potential_profit", "expected_profit_change")])
    key = F.coalesce(*[F.get_json_object("simulation_details", f"$.{c}") for c in ("product_id", "category")])
    return made.select(
        "decision_type", key.alias("subject"), "status", "error", profit.alias("expected_profit"),
        F.col("contract.status").alias("contract_status"), F.col("contract.recommendation.recommendation").isNotNull().alias("recommended"))


query("decision_results", f"""
select 'Pricing' as decision_type, s.product_id as subject, case when error is null then 'success' else 'error' end as status, error,
       projected_profit as expected_profit, case when error is null then 'Simulated' end as contract_status, error is null as recommended
from ({_PRICE_SUMMARY}) s left join ({_PRICE_ROWS}) r on s.product_id = r.product_id and scenario = 'Expected'
union all
select 'Inventory', product_id, 'success', null, potential_profit, 'Simulated', true from ({_STOCK_ROWS}) r where scenario = 'Expected'
union all
select 'Marketing', category, 'success', null, expected_profit_change, 'Simulated', true
from ({_SPEND_ROWS}) r where scenario = 'Expected'""")(_results)


def _outcomes(spark, sf):
    """Pricing decisions, nine in ten of which reached 90 % of the expected profit."""
    priced = _pricing(spark, sf).where("error is null")
    named = priced.select(F.col("product_id").alias("decision_id"), contracts.expected_outcome(priced).alias("expected_outcome"))
    metric = F.when(F.col("decision_id").try_cast("bigint") % 10 != 0, F.lit("projected_profit")).otherwise(F.lit("unheard_of"))
    value = F.rint(F.col("expected_outcome")["projected_profit"] * 0.9 * 100.0) / 100.0
    return named.withColumn("actual_outcome", F.struct(
        F.lit("").alias("description"), metric.alias("metric"), value.alias("value")))


_ACT = f"""select product_id as decision_id, 'projected_profit' as metric, projected_profit as expected,
R2[projected_profit*0.9e0] as actual from ({_PRICE_ROWS}) p where scenario = 'Expected' and cast(product_id as bigint) % 10 <> 0"""
query("outcome_report", f"""
select *, actual-expected as difference, case when expected <> 0 then (actual-expected)/abs(expected)*100e0 end as difference_pct
from ({_ACT}) a""")(lambda spark, sf: contracts.outcome_report(_outcomes(spark, sf)))
