"""Scalar functions, each applied to whole columns of the test tables."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import numeric, text
from ..plans.registry import query

KEYS = ["order_id", "line_id"]


def _sales(name, column, sql, source="sales"):
    query(name, f"select order_id, line_id, {sql} as value from {source}")(
        lambda spark, sf: view(spark, sf, source).select(*KEYS, column().alias("value")))


def _size():
    """Profits spread from paise to crores, with gaps."""
    return F.when(F.col("line_id") % 11 != 0, F.col("gross_profit") * F.pow(F.lit(10.0), F.col("quantity") % 6 - 1))


_SIZE = "(case when line_id % 11 <> 0 then gross_profit*pow(10e0, quantity % 6 - 1) end)"
_MONEY = f"""(select case when v is null then '₹0.00'
  when abs(v) >= 1e7 then '₹' || format('{{:,.2f}}', v/1e7) || ' Cr'
  when abs(v) >= 1e5 then '₹' || format('{{:,.2f}}', v/1e5) || ' L' else '₹' || format('{{:,.2f}}', v) end
  from (select {_SIZE} as v) z)"""

_sales("round_even", lambda: numeric.round_even(F.col("revenue") / F.col("quantity"), 2), "R2[revenue/quantity]")
_sales("safe_divide", lambda: numeric.ratio("revenue", "returns"),
       "case when returns > 0 then revenue/returns else 0e0 end")
_sales("clamp", lambda: numeric.clamp(F.col("profit_margin") * 4.0 - 3.0, -3.0, -0.3),
       "greatest(least(profit_margin*4e0-3e0, -0.3e0), -3e0)")
_sales("finite", lambda: numeric.finite("unit_price"),
       "case when not isinf(unit_price) and not isnan(unit_price) then unit_price end", "odd_sales")
_sales("fmt_currency", lambda: text.currency(_size()), _MONEY)
_sales("fmt_number", lambda: text.number(_size()),
       f"coalesce(format('{{:,}}', cast(trunc({_SIZE}) as bigint)), '0')")
_sales("fmt_percent", lambda: text.percent(F.when(F.col("line_id") % 11 != 0, F.col("profit_margin"))),
       "coalesce(format('{:.1f}', case when line_id % 11 <> 0 then profit_margin end*100e0) || '%', '0.0%')")
_sales("fmt_change", lambda: text.change(_size()),
       f"coalesce(case when {_SIZE} > 0 then '+' else '' end || '₹' || format('{{:,.2f}}', {_SIZE}), '—')")
_sales("fmt_change_pct", lambda: text.change_percent(_size()),
       f"coalesce(case when {_SIZE} > 0 then '+' else '' end || format('{{:.1f}}', {_SIZE}) || '%', '—')")
query("severity_mark", """
select event_id, case event_type when 'error' then '🔴' when 'warning' then '🟡' when 'info' then '🔵'
       when 'success' then '🟢' else '⚪' end as value from events""")(
    lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", text.severity_symbol("event_type").alias("value")))
