"""Line features, splits, scaling and future rows."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import features as ops
from ..plans.registry import query

KEYS = ["order_id", "line_id"]
_W = "(partition by product_id order by date, order_id, line_id, quantity{})"

_CAL = """cast(year(date) as int) as year, cast(month(date) as int) as month, cast(day(date) as int) as day,
 cast(isodow(date)-1 as int) as day_of_week, cast(week(date) as int) as week_of_year, cast(quarter(date) as int) as quarter,
 case when isodow(date) >= 6 then 1 else 0 end as is_weekend, case when day(date) = 1 then 1 else 0 end as is_month_start,
 case when date = last_day(date) then 1 else 0 end as is_month_end,
 R4[sin(2*pi()*month(date)/12e0)] as month_sin, R4[cos(2*pi()*month(date)/12e0)] as month_cos"""
_LAG = ", ".join(f"lag(quantity, {k}) over {_W.format('')} as quantity_lag_{k}" for k in ops.LAGS)


def _frame(n):
    return _W.format(f" rows between {n} preceding and 1 preceding")


_MEAN = ", ".join(f"R2[avg(quantity) over {_frame(n)}] as quantity_rolling_mean_{n}" for n in ops.WINDOWS)
_STD = ", ".join(
    f"R2[coalesce(stddev_samp(quantity) over {_frame(n)}, 0e0)] as quantity_rolling_std_{n}" for n in ops.WINDOWS)
_RATIOS = """case when cost_per_unit > 0 then R2[unit_price/cost_per_unit] else 0e0 end as price_to_cost_ratio,
 case when quantity > 0 then R2[marketing_spend/quantity] else 0e0 end as marketing_per_unit,
 case when quantity > 0 then R4[cast(returns as double)/quantity] else 0e0 end as return_rate,
 case when quantity > 0 then R2[cast(inventory_units as double)/quantity] else 0e0 end as inventory_to_sales"""
_ML = f"""select *, {_CAL}, {_LAG}, {_MEAN}, {_STD}, {_RATIOS} from sales
qualify lag(quantity, 30) over {_W.format('')} is not null"""
_CUT = """select d from (select date as d, row_number() over (order by date desc) as r, count(*) over () as n
from (select distinct date from sales)) x where r = greatest(1, cast(ceil(n*0.2e0) as bigint))"""


def _sales(name, build, sql=None):
    query(name, sql)(lambda spark, sf: build(view(spark, sf, "sales")))


def _lines(df):
    return df.select("date", *KEYS, "product_id", "quantity")


_sales("temporal_features", lambda df: ops.temporal_features(df.select("date", *KEYS)),
       f"select date, order_id, line_id, {_CAL} from sales")
_sales("lag_features", lambda df: ops.lag_features(_lines(df)),
       f"select date, order_id, line_id, product_id, quantity, {_LAG} from sales")
_sales("rolling_mean", lambda df: ops.rolling_features(_lines(df), std=False),
       f"select date, order_id, line_id, product_id, quantity, {_MEAN} from sales")
_sales("rolling_std", lambda df: ops.rolling_features(_lines(df), mean=False),
       f"select date, order_id, line_id, product_id, quantity, {_STD} from sales")
# The same lags with every product treated as hot: rows are cut into range blocks.
_sales("lag_features_in_blocks", lambda df: ops.lag_features(_lines(df), share=0.0, floor=0),
       f"select date, order_id, line_id, product_id, quantity, {_LAG} from sales")
_sales("global_lags", lambda df: ops.lag_features(_lines(df).drop("product_id")),
       "select date, order_id, line_id, quantity, " + _LAG.replace("partition by product_id ", "") + " from sales")
_sales("business_features",
       lambda df: ops.business_features(df).select(
           *KEYS, "price_to_cost_ratio", "marketing_per_unit", "return_rate", "inventory_to_sales"),
       f"select order_id, line_id, {_RATIOS} from sales")
_sales("ml_features", ops.ml_features, _ML)

_FEATURES = [
    "quantity", "unit_price", "discount", "cost_per_unit", "marketing_spend", "returns", "inventory_units",
    "discount_rate", "year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend",
    "is_month_start", "is_month_end", "month_sin", "month_cos",
    *[f"quantity_lag_{k}" for k in ops.LAGS],
    *[f"quantity_rolling_{s}_{n}" for s in ("mean", "std") for n in ops.WINDOWS], "price_to_cost_ratio",
]
_CODES = (
    "cast(dense_rank() over (order by category) - 1 as int) as category_encoded,"
    " cast(dense_rank() over (order by region) - 1 as int) as region_encoded"
)
_sales("encode_categories",
       lambda df: ops.encode_categories(df.select(*KEYS, "category", "region")),
       f"select order_id, line_id, category, region, {_CODES} from sales")
_sales("select_features",
       lambda df: ops.select_features(ops.ml_features(df), keep=tuple(KEYS), least=False),
       f"select order_id, line_id, {', '.join(_FEATURES)}, {_CODES} from ({_ML}) m")
_sales("chronological_split",
       lambda df: ops.chronological_split(df.select("date", *KEYS)),
       f"select date, order_id, line_id, date >= ({_CUT}) as is_test from sales")


def _numbered(df):
    return df.select((F.col("order_id").cast("bigint") * 100000000 + F.col("line_id")).alias("k"), "quantity")


_sales("ordered_split", lambda df: ops.ordered_split(_numbered(df).groupBy("k").agg(F.sum("quantity").alias("quantity")), "k"), """
select k, quantity, row_number() over (order by k) > floor(count(*) over () * (1 - 0.2e0)) as is_test
from (select cast(order_id as bigint)*100000000 + line_id as k, SI[quantity] as quantity from sales group by 1) s""")
_sales("preprocess_summary",
       lambda df: ops.preprocess_summary(ops.chronological_split(df), len(_FEATURES) + 1), f"""
select count(*) as total_samples, count(*) filter (where not t) as training_samples,
       count(*) filter (where t) as testing_samples,
       count(*) filter (where not t) || ':' || count(*) filter (where t) as train_test_ratio,
       cast({len(_FEATURES) + 1} as bigint) as num_features,
       R2[avg(case when not t then quantity end)] as target_mean,
       R2[stddev_samp(case when not t then quantity end)] as target_std,
       R2[min(case when not t then quantity end)] as target_min, R2[max(case when not t then quantity end)] as target_max
from (select quantity, date >= ({_CUT}) as t from sales) s""")
_sales("scale_features",
       lambda df: ops.scale_features(
           ops.chronological_split(df.select("date", *KEYS, F.col("discount").alias("discount"),
                                             F.col("quantity").cast("double").alias("quantity"))),
           ["discount", "quantity"]).select("date", *KEYS, *[
               (F.rint(F.col(c) * 1e4) / 1e4 + 0.0).alias(c) for c in ("discount", "quantity")], "is_test"), f"""
with s as (select date, order_id, line_id, discount, cast(quantity as double) as quantity, date >= ({_CUT}) as is_test
           from sales),
m as (select avg(discount) as dm, stddev_pop(discount) as ds, avg(quantity) as qm, stddev_pop(quantity) as qs
      from s where not is_test)
select date, order_id, line_id, R4[(discount-dm)/ds] as discount, R4[(quantity-qm)/qs] as quantity, is_test from s, m""")

_LAST = "row_number() over (partition by product_id order by date desc, order_id desc, line_id desc, quantity desc)"
_sales("recent_means",
       lambda df: ops.recent_means(df, ["quantity", "inventory_units"]), f"""
select product_id, avg(quantity) as quantity, avg(inventory_units) as inventory_units, max(date) as last_date
from (select *, {_LAST} as r from sales) s where r <= 30 group by product_id""")
_sales("future_features",
       lambda df: ops.future_features(df, ["month", "day", "day_of_week", "is_month_end", "month_sin", "inventory_units", "other"], 30), f"""
with r as (select product_id, avg(inventory_units) as inventory_units, max(date) as last_date
           from (select *, {_LAST} as r from sales) s where r <= 30 group by product_id),
f as (select product_id, inventory_units, cast(last_date + cast(i as int) as date) as date from r, range(1, 31) t(i))
select product_id, date as future_date, cast(month(date) as double) as month, cast(day(date) as double) as day,
       cast(isodow(date)-1 as double) as day_of_week, case when date = last_day(date) then 1e0 else 0e0 end as is_month_end,
       R4[sin(2*pi()*month(date)/12e0)] as month_sin, inventory_units, 0e0 as other from f""")
_sales("future_frame",
       lambda df: df.groupBy("product_id").agg(F.max("date").alias("last")).select(
           "product_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("step"), "last").select(
           "product_id", "step", F.date_add("last", F.col("step")).alias("future_date")), """
select product_id, cast(i as int) as step, cast(last + cast(i as int) as date) as future_date
from (select product_id, max(date) as last from sales group by product_id) s, range(1, 31) t(i)""")
