"""Linking returns to orders."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions.text import key_text
from ..operators import returns as ops
from ..operators.cleaning import derive
from ..plans.registry import query

_UNIQUE = "select trim(order_id) as k from order_sales group by 1 having count(*) = 1"
_ADJUST = f"""select trim(r.order_id) as k, count(*) as n, sum(r.quantity) as units, XS[r.revenue] as val
from return_lines r where trim(r.order_id) in ({_UNIQUE}) group by 1"""
_ATTACHED = f"""select o.*, coalesce(cast(units as double), 0e0) as returns, coalesce(val, 0e0) as returned_revenue
from order_sales o left join ({_ADJUST}) a on trim(o.order_id) = a.k"""


def _both(name, build, sql):
    query(name, sql)(lambda spark, sf: build(view(spark, sf, "order_sales"), view(spark, sf, "return_lines")))


_both("returns_matched", ops.returns_matched,
      f"select * from return_lines where trim(order_id) in ({_UNIQUE})")
_both("returns_unmatched", ops.returns_unmatched,
      f"select * from return_lines where trim(order_id) not in ({_UNIQUE})")
_both("attach_returns", ops.attach_returns, _ATTACHED)
_both("net_revenue_after_returns",
      lambda s, r: derive(ops.attach_returns(s, r)).select("order_id", "revenue", "returned_revenue", "net_revenue"),
      f"select order_id, revenue, returned_revenue, R2[revenue-returned_revenue] as net_revenue from ({_ATTACHED}) t")
_both("return_summary", lambda s, r: ops.return_summary(s, r).drop("match_note"), f"""
with f as (select trim(order_id) as k, revenue, trim(order_id) in ({_UNIQUE}) as hit from return_lines)
select count(*) as rows, count(*) filter (where hit) as matched_rows, count(*) filter (where not hit) as unmatched_rows,
       count(distinct case when hit then k end) as matched_orders, R2[XS[revenue]] as return_value,
       R2[XS[case when hit then revenue else 0e0 end]] as matched_value,
       R2[XS[case when hit then 0e0 else revenue end]] as unmatched_value from f""")


def _returned_lines(spark, sf):
    """Returned sales lines with every third amount missing, so prices step in."""
    lines = view(spark, sf, "sales").where("returns > 0")
    amount = F.when(F.col("line_id") % 3 != 0, F.col("net_price") * F.col("returns"))
    return lines.select("order_id", "line_id", "unit_price", "returns", amount.alias("revenue"))


query("return_value", """
select order_id, line_id, coalesce(case when line_id % 3 <> 0 then net_price*returns end, unit_price*returns) as return_value
from sales where returns > 0""")(
    lambda spark, sf: (lambda df: df.select("order_id", "line_id", ops.return_value(df).alias("return_value")))(
        _returned_lines(spark, sf)))

query("key_trim", "select trim(concat('  ', order_id, ' ')) as order_key, revenue from order_sales")(
    lambda spark, sf: view(spark, sf, "order_sales").select(
        key_text(F.concat(F.lit("  "), "order_id", F.lit(" "))).alias("order_key"), "revenue"))
