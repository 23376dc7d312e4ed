"""Aggregate tables, key figures, rankings and baselines."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import analytics as ops
from ..plans.registry import query

_MONTHLY = """
select strftime(date, '%Y-%m') as year_month, R2[XS[revenue]] as total_revenue,
       R2[XS[gross_profit]] as total_profit, count(distinct order_id) as total_orders,
       SI[quantity] as total_units, R2[XA[revenue]] as avg_order_value,
       R4[XA[profit_margin]] as avg_profit_margin, R2[XS[net_revenue]] as total_net_revenue
from sales group by 1
"""

_PRODUCTS = """
select product_id, product_name, category, R2[XS[revenue]] as total_revenue,
       R2[XS[gross_profit]] as total_profit, SI[quantity] as total_units,
       R2[XA[unit_price]] as avg_price, R4[XA[profit_margin]] as avg_margin,
       R2[XA[discount]] as avg_discount, SI[returns] as total_returns,
       R2[XS[marketing_spend]] as total_marketing
from sales group by product_id, product_name, category
"""

_MARKETING = """
select *, case when total_marketing > 0 then R2[total_revenue/total_marketing] else 0e0 end as roas,
       case when total_marketing > 0 then R2[total_profit/total_marketing] else 0e0 end
         as profit_per_marketing_dollar
from (select category, R2[XS[revenue]] as total_revenue, R2[XS[marketing_spend]] as total_marketing,
             R2[XS[gross_profit]] as total_profit
      from sales where marketing_spend > 0 group by category) m
"""

_INVENTORY = """
with i as (
  select product_id, product_name, category, R2[XA[inventory_units]] as avg_inventory,
         R2[XA[quantity]] as avg_daily_sales, SI[quantity] as total_units_sold,
         R2[XS[revenue]] as total_revenue, R2[XA[cost_per_unit]] as avg_cost
  from sales group by product_id, product_name, category),
m as (select median(avg_daily_sales) as med from i)
select i.*, case when avg_daily_sales > 0 then R1[avg_inventory/avg_daily_sales]
            else cast('Infinity' as double) end as stock_cover_days,
       R2[avg_inventory*avg_cost] as inventory_capital,
       case when avg_daily_sales >= med*1.5e0 then 'High'
            when avg_daily_sales >= med*0.5e0 then 'Medium' else 'Low' end as velocity_class
from i, m
"""

_RATES = """
select category, SI[returns] as total_returns, SI[quantity] as total_quantity,
       case when sum(quantity) > 0 then cast(sum(returns) as double)/cast(sum(quantity) as double)
            else 0e0 end as return_rate
from sales group by category
"""


def _sales(name, build, sql):
    query(name, sql)(lambda spark, sf: build(view(spark, sf, "sales")))


_sales("monthly_revenue", ops.monthly_revenue, _MONTHLY)
_sales("product_performance", ops.product_performance, _PRODUCTS)
_sales("category_analysis", ops.category_analysis, """
select category, R2[XS[revenue]] as total_revenue, R2[XS[gross_profit]] as total_profit,
       SI[quantity] as total_units, count(distinct product_id) as num_products,
       R4[XA[profit_margin]] as avg_margin, R2[XS[marketing_spend]] as total_marketing,
       SI[returns] as total_returns
from sales group by category""")
_sales("regional_analysis", ops.regional_analysis, """
select region, R2[XS[revenue]] as total_revenue, R2[XS[gross_profit]] as total_profit,
       SI[quantity] as total_units, count(distinct order_id) as total_orders,
       R4[XA[profit_margin]] as avg_margin
from sales group by region""")
_sales("marketing_effectiveness", ops.marketing_effectiveness, _MARKETING)
_sales("inventory_analysis", ops.inventory_analysis, _INVENTORY)
_sales("velocity_class", lambda df: ops.inventory_analysis(df).select("product_id", "avg_daily_sales", "velocity_class"),
       f"select product_id, avg_daily_sales, velocity_class from ({_INVENTORY}) v")
_sales("velocity_counts", ops.velocity_counts,
       f"select velocity_class, count(*) as products from ({_INVENTORY}) v group by 1")
_sales("median_broadcast", ops.faster_than_median,
       f"select v.* from ({_INVENTORY}) v, (select median(avg_daily_sales) as m from ({_INVENTORY}) w) x"
       " where avg_daily_sales > m")
_sales("compute_kpis", ops.compute_kpis, """
with k as (select XS[revenue] as r, XS[gross_profit] as p, count(distinct order_id) as num_orders,
                  SI[quantity] as units_sold from sales)
select R2[r] as total_revenue, R2[p] as total_profit, num_orders, units_sold,
       R2[r/num_orders] as avg_order_value, R4[p/r] as profit_margin from k""")
_sales("net_revenue_total", ops.net_revenue_total, "select R2[XS[net_revenue]] as total_net_revenue from sales")
_sales("return_rate_by_category", ops.return_rate_by_category, _RATES)
_sales("historical_roas", ops.historical_roas, """
with per as (select category, XS[revenue] as r, XS[marketing_spend] as s, XS[gross_profit] as p, count(*) as n
             from sales where marketing_spend > 0 group by category),
a as (select * from per union all select null, XS[r], XS[s], XS[p], SI[n] from per)
select category, R2[r/s] as roas, R2[r] as total_revenue, R2[s] as total_marketing,
       R2[p/s] as profit_per_marketing_dollar, R2[s/n] as avg_daily_spend, n as data_points from a""")
_sales("pricing_baseline", ops.pricing_baseline, """
with a as (select product_id, product_name, XA[unit_price] as p, XA[quantity] as q
           from sales group by product_id, product_name)
select product_id, product_name, R2[p] as current_price, R2[q] as avg_daily_qty, R2[p*1.1e0] as proposed_price
from a""")
_sales("inventory_baseline", ops.inventory_baseline, """
select product_id, product_name, R2[XA[inventory_units]] as avg_inventory, R2[XA[cost_per_unit]] as avg_cost
from sales group by product_id, product_name""")
_sales("monthly_spend_baseline", ops.monthly_spend_baseline, """
with a as (select category, XS[marketing_spend]/greatest(count(distinct date), 1)*30e0 as m from sales group by category
           union all select null, XS[marketing_spend]/greatest(count(distinct date), 1)*30e0 from sales)
select category, R2[m] as current_spend, R2[m*1.2e0] as proposed_spend from a""")
_sales("history_coverage", ops.history_coverage, """
select cast(date_diff('day', min(date), max(date)) + 1 as int) as history_days,
       date_diff('day', min(date), max(date)) + 1 >= 70 as enough from sales""")
_sales("distinct_products", lambda df: ops.distinct_values(df, "product_id"), "select distinct product_id from sales")
_sales("distinct_categories", lambda df: ops.distinct_values(df, "category"), "select distinct category from sales")
_sales("top_products", ops.top_products,
       f"select * from ({_PRODUCTS}) p order by total_revenue desc, product_id limit 10")
_sales("top_stock_cover", ops.top_stock_cover,
       f"select * from ({_INVENTORY}) v where stock_cover_days < cast('Infinity' as double)"
       " order by stock_cover_days desc, product_id limit 10")
_sales("order_result", lambda df: ops.marketing_effectiveness(df).select("category", "roas"),
       f"select category, roas from ({_MARKETING}) m order by roas desc, category")
_sales("preview", lambda df: ops.preview(df.select("date", "order_id", "line_id", "product_id", "quantity", "revenue"),
                                         ["date", "order_id", "line_id", "quantity"]), """
select strftime(date, '%Y-%m-%d') as date, order_id, line_id, product_id, quantity, revenue from sales
order by sales.date, order_id, line_id, quantity limit 100""")
_sales("year_month", lambda df: df.select("order_id", "line_id", ops.year_month().alias("year_month")),
       "select order_id, line_id, strftime(date, '%Y-%m') as year_month from sales")
_sales("filter_spend", lambda df: ops.spending_rows(df).select("order_id", "line_id", "marketing_spend"),
       "select order_id, line_id, marketing_spend from sales where marketing_spend > 0")
_sales("filter_product", lambda df: df.groupBy("product_id").agg(F.count(F.lit(1)).alias("rows")),
       "select product_id, count(*) as rows from sales group by 1")
_sales("filter_category", lambda df: df.groupBy("category").agg(F.count(F.lit(1)).alias("rows")),
       "select category, count(*) as rows from sales group by 1")
