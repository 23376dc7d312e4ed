"""Business signals and the tables behind them."""

from ..fixtures import view
from ..operators import signals as ops
from ..plans.registry import query
from .analytics import _INVENTORY, _MARKETING, _MONTHLY, _RATES

SHOWN = ["type", "entity", "severity", "value", "baseline", "change_pct"]
_EDGES = f"""select *, cast(row_number() over (order by year_month) as int) as from_start,
cast(row_number() over (order by year_month desc) as int) as from_end from ({_MONTHLY}) m
qualify from_start <= 3 or from_end <= 3"""
_TREND = f"""select max(greatest(from_start, from_end)) as months, (select count(*) from sales) as n,
avg(case when from_start <= 3 then avg_profit_margin end) as em, avg(case when from_end <= 3 then avg_profit_margin end) as lm,
avg(case when from_start <= 3 then total_revenue end) as er, avg(case when from_end <= 3 then total_revenue end) as lr
from ({_EDGES}) e"""
_MARGIN = f"""select 'margin' as type, cast(null as varchar) as entity, 'warning' as severity, lm as value, em as baseline,
R1[(1e0-lm/em)*100e0] as change_pct from ({_TREND}) t where n >= 100 and months >= 3 and em > 0 and lm < em*0.9e0"""
_REVENUE = f"""select 'revenue', cast(null as varchar), case when c > 0 then 'info' else 'warning' end, lr, er, c
from (select *, R1[(lr/er-1e0)*100e0] as c from ({_TREND}) t0 where n >= 100 and months >= 4 and er > 0) t
where c > 15 or c < -15"""
_RETURNS = f"select 'returns', category, 'warning', return_rate, 0.05e0, cast(null as double) from ({_RATES}) r where return_rate > 0.05e0"
_ROAS = f"""select 'marketing', category, 'info', roas, med, cast(null as double) from ({_MARKETING}) m,
(select median(roas) as med from ({_MARKETING}) m2) x where roas < med*0.5e0"""
_STOCK = f"""select 'inventory', product_id, 'info', stock_cover_days, 90e0, cast(null as double)
from ({_INVENTORY}) v where stock_cover_days > 90 and stock_cover_days < cast('Infinity' as double)"""
_HEAD = "select 'none' as type, cast(null as varchar) as entity, '' as severity, 0e0 as value, 0e0 as baseline, 0e0 as change_pct where false union all "


def _sales(name, build, sql):
    query(name, sql)(lambda spark, sf: build(view(spark, sf, "sales")))


_sales("first_last_months", ops.first_last_months, _EDGES)
_sales("sig_margin", lambda df: ops.margin_signal(df).select(*SHOWN), _MARGIN)
_sales("sig_revenue", lambda df: ops.revenue_signal(df).select(*SHOWN), _HEAD + _REVENUE)
_sales("sig_returns", lambda df: ops.returns_signal(df).select(*SHOWN), _HEAD + _RETURNS)
_sales("sig_roas", lambda df: ops.roas_signal(df).select(*SHOWN), _HEAD + _ROAS)
_sales("sig_inventory", lambda df: ops.inventory_signal(df).select(*SHOWN), _HEAD + _STOCK)
_sales("signals", lambda df: ops.signals(df).select(*SHOWN),
       " union all ".join([_MARGIN, _REVENUE, _RETURNS, _ROAS, _STOCK]))
