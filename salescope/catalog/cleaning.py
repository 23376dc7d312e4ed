"""Cleaning steps, derived columns and the cleaning report."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions.parsing import parse_date
from ..operators import cleaning as ops
from ..plans.registry import query

KEYS = ["order_id", "line_id"]
INPUTS = [
    "date", "order_id", "line_id", "product_id", "quantity", "unit_price", "discount", "cost_per_unit", "returns",
]


def _raw(name, build, sql):
    query(name, sql)(lambda spark, sf: build(view(spark, sf, "raw_sales")))


def _derived(name, column):
    def build(spark, sf):
        return ops.derive(view(spark, sf, "sales").select(*INPUTS)).select(*KEYS, column)

    query(name, f"select order_id, line_id, {column} from sales")(build)


for _c in ("discount_rate", "net_price", "revenue", "cost", "gross_profit", "profit_margin", "net_revenue"):
    _derived(_c, _c)

query("unit_price", """
select order_id, quantity, revenue, case when quantity > 0 then R2[revenue/quantity] end as unit_price,
       case when quantity > 0 then R2[revenue/quantity] end as net_price from order_sales""")(
    lambda spark, sf: ops.derive(view(spark, sf, "order_sales")).select(
        "order_id", "quantity", "revenue", "unit_price", "net_price"))

_raw("dedupe_rows", ops.dedupe_rows, "select distinct * from raw_sales")
_raw("distinct_rows", lambda df: ops.dedupe_rows(df.select("product_id", "category", "region")),
     "select distinct product_id, category, region from raw_sales")
_raw("parse_dates", lambda df: df.select(*KEYS, F.col("date").alias("text"), parse_date(df, "date").alias("date")),
     "select order_id, line_id, date as text, try_cast(date as date) as date from raw_sales")
_SLASHED = """select k, case when k % 9 = 0 then concat(cast({a} as STR), '/', cast({b} as STR), '/', cast(y as STR), ' 7:05')
when k % 11 = 0 then concat('13/13/', cast(y as STR)) when k % 13 = 0 then cast(day as STR)
else concat(cast({a} as STR), '/', cast({b} as STR), '/', cast(y as STR)) end as text
from (select o_orderkey as k, cast(o_orderdate as date) as day, day(o_orderdate) as d, month(o_orderdate) as m, year(o_orderdate) as y
from orders) o"""


def _slashed(a, b):
    """Order days written with slashes, part of them with times, as ISO days or not days at all; and what they mean."""
    def build(spark, sf):
        spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("slashed_orders")
        df = spark.sql(_SLASHED.format(a=a, b=b).replace("STR", "string").replace("from orders)", "from slashed_orders)"))
        return df.select("k", "text", parse_date(df, "text").alias("date"))

    sql = f"""select k, text, case when k % 9 = 0 or k % 11 <> 0 then day end as date
from ({_SLASHED.format(a=a, b=b).replace('STR', 'varchar')}) s join (
  select o_orderkey as kk, cast(o_orderdate as date) as day from orders) o on kk = k"""
    return sql, build


for _name, _order in (("parse_dates_day_first", ("d", "m")), ("parse_dates_month_first", ("m", "d"))):
    _sql, _build = _slashed(*_order)
    query(_name, _sql)(_build)
_raw("drop_bad_dates", lambda df: ops.drop_bad_dates(df).select("date", *KEYS),
     "select try_cast(date as date) as date, order_id, line_id from raw_sales where try_cast(date as date) is not null")
_raw("coerce_numeric", lambda df: ops.coerce_numeric(df).select(*KEYS, "quantity", "unit_price", "returns"), """
select order_id, line_id, try_cast(quantity as double) as quantity, unit_price, cast(returns as double) as returns
from raw_sales""")
_raw("fill_zero", lambda df: ops.fill_zero(df).select(*KEYS, "discount", "returns", "marketing_spend"), """
select order_id, line_id, coalesce(discount, 0) as discount, coalesce(returns, 0) as returns,
       coalesce(marketing_spend, 0) as marketing_spend from raw_sales""")
_raw("fill_median",
     lambda df: ops.fill_median(ops.typed_sales(df)).select(*KEYS, *[
         c for c in ops.MEDIAN_FILLED if c in df.columns]),
     "select order_id, line_id, quantity, unit_price, cost_per_unit, inventory_units from filled_sales")
_raw("drop_invalid", lambda df: ops.drop_invalid(ops.typed_sales(df)).select(*KEYS, "quantity", "unit_price", "cost_per_unit"), """
select order_id, line_id, quantity, unit_price, cost_per_unit from typed_sales
where quantity >= 0 and unit_price > 0 and cost_per_unit >= 0""")
_raw("clean_sales", ops.clean_sales, "select * from cleaned_sales")
_raw("spark_clean", lambda df: ops.strict_clean(df).withColumn("date", parse_date(df, "date")), """
select * replace (try_cast(date as date) as date) from strict_sales""")
_raw("pipeline_run", ops.pipeline_counts, """
select count(*) as input_rows, count(*) filter (where ok) as output_rows,
       count(*) - count(*) filter (where ok) as rows_removed, cast(22 as bigint) as columns_processed,
       'Null removal in critical columns; Invalid value filtering (negative qty/price); Null filling for optional columns; Discount rate computation; Net price computation; Revenue computation; Cost computation; Gross profit computation; Profit margin computation; Net revenue computation' as transformations
from (select coalesce(product_id is not null and try_cast(quantity as double) >= 0 and unit_price > 0
                      and cost_per_unit >= 0, false) as ok from raw_sales) r""")
_raw("cleaning_report", lambda df: ops.cleaning_report(df).select("step", "affected"), """
with g as (select *, count(*) as n from raw_sales group by all),
t as (select try_cast(date as date) as d, n, try_cast(quantity as double) as q, unit_price as p, cost_per_unit as c,
             discount, marketing_spend, returns, inventory_units from g),
f as (select *, coalesce(coalesce(q, mq) >= 0 and coalesce(p, mp) > 0 and coalesce(c, mc) >= 0, false) as ok
      from t, medians),
s as (select SI[n] as rows_in, SI[n-1] as dup, count(*) filter (where d is null) as bad,
             count(*) filter (where d is not null and q is null) as gq,
             count(*) filter (where d is not null and p is null) as gp,
             count(*) filter (where d is not null and c is null) as gc,
             count(*) filter (where d is not null and discount is null) as gd,
             count(*) filter (where d is not null and marketing_spend is null) as gm,
             count(*) filter (where d is not null and returns is null) as gr,
             count(*) filter (where d is not null and not ok) as inv,
             count(*) filter (where d is not null and ok) as rows_out from f)
select 'original_rows' as step, rows_in as affected from s union all
select 'final_rows', rows_out from s union all
select 'missing_values_handled', gq+gp+gc+gd+gm+gr from s union all
select 'invalid_records_removed', bad+inv from s union all
select 'duplicates', dup from s union all select 'date_type', 0 from s union all
select 'dates', bad from s union all select 'number_quantity', 0 from s union all
select 'fill_quantity', gq from s union all select 'fill_unit_price', gp from s union all
select 'fill_cost_per_unit', gc from s union all select 'fill_discount', gd from s union all
select 'fill_marketing_spend', gm from s union all select 'fill_returns', gr from s union all
select 'invalid_values', inv from s""")
