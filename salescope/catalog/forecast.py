"""Daily series, folds, the weekly baseline, model selection and forecasts."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import forecast as fc
from ..operators import series as S
from ..plans.registry import query
from ..streaming.demand import daily_totals, drop_repeats

_OBS = """select product_id as series_id, date, cast(sum(quantity) as double) as quantity from sales group by 1, 2
union all select 'All Products', date, cast(sum(quantity) as double) from sales group by 2"""
_SPINE = f"""select s.series_id, s.date, coalesce(o.quantity, 0e0) as quantity from (
select series_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from ({_OBS}) a group by 1) s
left join ({_OBS}) o on o.series_id = s.series_id and o.date = s.date"""
_POS = f"""select *, cast(row_number() over (partition by series_id order by date) - 1 as int) as day,
cast(count(*) over (partition by series_id) as int) as days from ({_SPINE}) p"""
_WIN = "(partition by series_id order by date rows between {n} preceding and 1 preceding)"
_FEATURES = f"""select *, cast(isodow(date)-1 as int) as day_of_week, sin(2*pi()*(isodow(date)-1)/7e0) as week_sin,
cos(2*pi()*(isodow(date)-1)/7e0) as week_cos, sin(2*pi()*(dayofyear(date)-1)/365.25e0) as month_sin,
cos(2*pi()*(dayofyear(date)-1)/365.25e0) as month_cos, day as trend_days,
{', '.join(f"coalesce(lag(quantity, {k}) over (partition by series_id order by date), 0e0) as lag_{k}" for k in S.LAG_DAYS)},
{', '.join(f"coalesce(avg(quantity) over {_WIN.format(n=k)}, 0e0) as mean_{k}" for k in S.ROLLING_DAYS)},
{', '.join(f"coalesce(stddev_pop(quantity) over {_WIN.format(n=k)}, 0e0) as std_{k}" for k in S.ROLLING_DAYS)}
from ({_POS}) q"""
_H = "least(28, greatest(7, days // 12))"
_FOLDS = f"""select series_id, days, cast(h as int) as horizon, cast(f as int) as fold, cast(days - (3-f)*h as int) as origin,
cast(mn + cast(days - (3-f)*h as int) as date) as start_date
from (select series_id, cast(count(*) as int) as days, min(date) as mn, least(28, greatest(7, count(*) // 12)) as h
from ({_SPINE}) s group by 1) l, range(0, 3) t(f) where days - (3-f)*h - 28 >= 7"""
_NAIVE = f"""select f.series_id, f.fold, a.date, a.quantity as actual, greatest(b.quantity, 0e0) as predicted
from ({_FOLDS}) f join ({_POS}) a on a.series_id = f.series_id and a.day >= f.origin and a.day < f.origin + f.horizon
join ({_POS}) b on b.series_id = f.series_id and b.day = f.origin - 7 + (a.day - f.origin) % 7"""
_SCORE = f"""select series_id, avg(abs(actual-predicted)) as mae, case when sum(abs(actual)) <> 0
then sum(abs(actual-predicted))/sum(abs(actual)) else cast('Infinity' as double) end as wape from ({_NAIVE}) n group by 1"""


def _next(periods):
    return f"""select l.series_id, cast(k as int) as step, cast(l.mx + cast(k as int) as date) as date,
case when l.days >= 7 then greatest(q.quantity, 0e0)
     when l.days + k - 1 >= 7 then coalesce(q.quantity, l.m) else l.m end as predicted
from (select series_id, count(*) as days, max(date) as mx, avg(quantity) as m from ({_SPINE}) s group by 1) l
cross join range(1, {periods} + 1) t(k)
left join ({_POS}) q on q.series_id = l.series_id
 and q.day = case when l.days >= 7 then l.days - 7 + (k-1) % 7 else (l.days + k - 1) % 7 end"""


def _series(spark, sf, overall=True, products=True):
    return S.daily_series(view(spark, sf, "sales"), overall, products)


def _numbered(spark, sf, overall=True, latest=None):
    return S.numbered_days(S.daily_demand(view(spark, sf, "sales"), overall), latest)


def _runs(spark, sf):
    return S.daily_runs(S.daily_demand(view(spark, sf, "sales")))


def r4(c):
    return (F.rint(F.col(c) * 1e4) / 1e4 + 0.0).alias(c)


query("daily_demand", _OBS)(lambda spark, sf: S.daily_demand(view(spark, sf, "sales")))
query("date_spine", f"select * from ({_SPINE}) s where series_id = 'All Products'")(
    lambda spark, sf: _series(spark, sf, products=False))
query("daily_series", f"""
select series_id, count(*) as days, min(date) as first_date, max(date) as last_date, sum(quantity) as total,
       count(*) filter (where quantity = 0) as empty_days from ({_SPINE}) s group by 1""")(
    lambda spark, sf: _series(spark, sf).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("quantity").alias("total"), F.count_if(F.col("quantity") == 0).alias("empty_days")))

_SHOWN = ["date", "day_of_week", "trend_days"]
_ROUNDED = [f for f in S.FEATURES if f not in _SHOWN]
query("daily_features", f"""
select series_id, date, day_of_week, trend_days, {', '.join(f"R4[{f}] as {f}" for f in _ROUNDED)}
from ({_FEATURES}) f where series_id = 'All Products' and day >= 28""")(
    lambda spark, sf: S.training_rows(S.daily_features(_series(spark, sf, products=False))).select(
        "series_id", *_SHOWN, *[r4(f) for f in _ROUNDED]))
query("date_spine_all", f"select * from ({_SPINE}) s")(_series)
query("daily_features_all", f"""
select series_id, date, day_of_week, trend_days, {', '.join(f"R4[{f}] as {f}" for f in _ROUNDED)}
from ({_FEATURES}) f where day >= 28""")(
    lambda spark, sf: S.training_rows(S.daily_features(_runs(spark, sf))).select(
        "series_id", *_SHOWN, *[r4(f) for f in _ROUNDED]))
query("annual_cycle", """
select order_id, line_id, cast(isodow(date)-1 as int) as day_of_week, R4[sin(2*pi()*(isodow(date)-1)/7e0)] as week_sin,
       R4[cos(2*pi()*(isodow(date)-1)/7e0)] as week_cos, R4[sin(2*pi()*(dayofyear(date)-1)/365.25e0)] as month_sin,
       R4[cos(2*pi()*(dayofyear(date)-1)/365.25e0)] as month_cos from sales""")(
    lambda spark, sf: view(spark, sf, "sales").withColumns(S.cycle(F.col("date"))).select(
        "order_id", "line_id", "day_of_week", *[r4(c) for c in ("week_sin", "week_cos", "month_sin", "month_cos")]))


def _per_series(sql, parts):
    return f"select series_id, {', '.join(f'{e} as {n}' for n, e in parts.items())} from ({sql}) x group by 1"


query("daily_lags", _per_series(_FEATURES, {
    "rows": "count(*)", **{f"lag_{k}": f"sum(lag_{k}*(day % 5))" for k in S.LAG_DAYS}}))(
    lambda spark, sf: S.daily_features(_runs(spark, sf), rolls=()).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"lag_{k}") * (F.col("day") % 5)).alias(f"lag_{k}") for k in S.LAG_DAYS]))
_ROLLED = [f"{s}_{k}" for k in S.ROLLING_DAYS for s in ("mean", "std")]
query("daily_rolling", f"select series_id, date, {', '.join(f'R4[{f}] as {f}' for f in _ROLLED)} from ({_FEATURES}) f")(
    lambda spark, sf: S.daily_features(_runs(spark, sf), lags=()).select("series_id", "date", *[r4(f) for f in _ROLLED]))
query("rolling_origin_folds", _FOLDS)(lambda spark, sf: S.rolling_origin_folds(_series(spark, sf)))
query("seasonal_naive", _next(30))(lambda spark, sf: S.seasonal_naive(_numbered(spark, sf), 30))
query("backtest", _NAIVE)(lambda spark, sf: S.naive_backtest(_numbered(spark, sf, latest=S.BACKTEST_DAYS)))
query("wape", f"select series_id, R4[mae] as mae, R4[wape] as wape from ({_SCORE}) s")(
    lambda spark, sf: S.scores(S.naive_backtest(_numbered(spark, sf, latest=S.BACKTEST_DAYS)), "series_id").select(
        "series_id", r4("mae"), r4("wape")))


def _rivals(spark, sf):
    """Scores of three methods: the baseline, a constant and a copy of the baseline."""
    naive = S.naive_backtest(_numbered(spark, sf, latest=S.BACKTEST_DAYS))
    rows = naive.select("*", F.lit(fc.NAIVE).alias("model")).unionByName(
        naive.withColumns({"predicted": F.lit(0.5), "model": F.lit(fc.BOOSTING)})).unionByName(
        naive.withColumns({"predicted": F.lit(0.0), "model": F.lit(fc.FOREST)}))
    return S.scores(rows, "series_id", "model")


query("select_method", f"""
with r as (select series_id, fold, actual, predicted, 'Seasonal Naive' as model, 3 as o from ({_NAIVE}) n
  union all select series_id, fold, actual, 0.5e0, 'Gradient Boosting', 2 from ({_NAIVE}) n
  union all select series_id, fold, actual, 0e0, 'Random Forest', 1 from ({_NAIVE}) n),
s as (select series_id, model, o, avg(abs(actual-predicted)) as mae, case when sum(abs(actual)) <> 0
  then sum(abs(actual-predicted))/sum(abs(actual)) else cast('Infinity' as double) end as wape from r group by 1, 2, 3)
select series_id, model, R4[mae] as mae, R4[wape] as wape from s
qualify row_number() over (partition by series_id order by wape, mae, o) = 1""")(
    lambda spark, sf: fc.select_method(_rivals(spark, sf)).select("series_id", "model", r4("mae"), r4("wape")))
query("history_tail", f"""
select series_id, date, quantity from ({_POS}) p where day >= days - 90""")(
    lambda spark, sf: S.history_tail(_numbered(spark, sf)).select("series_id", "date", "quantity"))
query("forecast_totals", f"""
select series_id, R2[sum(predicted)] as total_predicted, R2[avg(predicted)] as avg_daily_predicted,
       R2[max(predicted)] as max_daily_predicted, R2[min(predicted)] as min_daily_predicted, count(*) as periods
from ({_next(30)}) n group by 1""")(
    lambda spark, sf: S.forecast_totals(S.seasonal_naive(_numbered(spark, sf), 30), "series_id"))

_LONG = f"select series_id, cast(count(*) as int) as days from ({_SPINE}) s group by 1"
query("forecast_all_products", f"""
select l.series_id, case when days >= 70 then 'success' else 'error' end as status,
       case when days < 70 then 'A forecast needs 70 days of history, this series has ' || days || '.' end as error,
       case when days >= 70 then 'Seasonal Naive' end as model_name,
       case when days >= 70 then R2[t] end as total_predicted, case when days >= 70 then R2[t/30e0] end as avg_daily_predicted,
       case when days >= 70 then 30 end as periods, case when days >= 70 then R2[mae] end as backtest_mae,
       case when days >= 70 then R1[wape*100e0] end as backtest_wape,
       case when days >= 70 then R1[wape*100e0] end as baseline_wape,
       case when days >= 70 then false end as beats_baseline,
       case when days >= 70 then cast({_H} as int) end as validation_days
from ({_LONG}) l left join ({_SCORE}) s on s.series_id = l.series_id
left join (select series_id, sum(predicted) as t from ({_next(30)}) n group by 1) n on n.series_id = l.series_id""")(
    lambda spark, sf: fc.forecast_daily_demand(_numbered(spark, sf), 30, [])[0])
query("demand_30d", f"""
select l.series_id as product_id, R2[sum(predicted)] as demand_30d from ({_LONG}) l
join ({_next(30)}) n on n.series_id = l.series_id where days >= 70 and l.series_id <> 'All Products' group by 1""")(
    lambda spark, sf: fc.demand_30d(_numbered(spark, sf, overall=False), []))

query("forecast")(lambda spark, sf: fc.forecast_daily_demand(_numbered(spark, sf), 30)[0])
query("recursive_forecast")(lambda spark, sf: fc.forecast_daily_demand(_numbered(spark, sf), 30)[1])


def _outline(spark, sf):
    """What is known of the models' forecasts without fitting them: who gets one, for which days, and that it fits together."""
    summary, days = fc.forecast_daily_demand(_numbered(spark, sf), 30)
    made = days.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("steps"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        (F.min("predicted") >= 0).alias("none_negative"), F.sum("predicted").alias("total"))
    fits = F.abs(F.col("total") - F.col("total_predicted")) <= 0.005 + 1e-9 * F.abs(F.col("total"))
    return summary.join(made, "series_id", "left").select(
        "series_id", "status", "error", "periods", "validation_days", "steps", "first_day", "last_day", "none_negative",
        fits.alias("total_fits"), (F.col("backtest_wape") <= F.col("baseline_wape")).alias("no_worse_than_baseline"),
        F.col("model_name").isin(*fc.ORDER).alias("known_model"),
        (F.col("beats_baseline") == (F.col("model_name") != fc.NAIVE)).alias("beats_unless_baseline"))


query("forecast_outline", f"""
select series_id, case when days >= 70 then 'success' else 'error' end as status,
       case when days < 70 then 'A forecast needs 70 days of history, this series has ' || days || '.' end as error,
       case when days >= 70 then 30 end as periods, case when days >= 70 then cast({_H} as int) end as validation_days,
       case when days >= 70 then cast(30 as bigint) end as steps, case when days >= 70 then cast(mx + 1 as date) end as first_day,
       case when days >= 70 then cast(mx + 30 as date) end as last_day, case when days >= 70 then true end as none_negative,
       case when days >= 70 then true end as total_fits, case when days >= 70 then true end as no_worse_than_baseline,
       case when days >= 70 then true end as known_model, case when days >= 70 then true end as beats_unless_baseline
from (select series_id, count(*) as days, max(date) as mx from ({_SPINE}) s group by 1) l""")(_outline)


def _planned(spark, sf):
    """Pricing scenarios fed by the models' forecasts: which proposals rest on a forecast, which on history."""
    from ..operators import decisions

    sales = view(spark, sf, "sales")
    made = fc.demand_30d(S.numbered_days(S.daily_demand(sales, overall=False)))
    out = decisions.demand_30d(decisions.product_history(sales), made)
    same = F.abs(F.col("demand") - F.col("demand_30d")) <= 1e-6
    both = out.join(made, "product_id", "left")
    return both.select("product_id", "from_forecast", F.when(F.col("from_forecast"), same).alias("demand_is_the_forecast"),
                       F.when(~F.col("from_forecast"), F.rint(F.col("demand") * 100.0) / 100.0 + 0.0).alias("from_history"))


query("demand_30d_models")(_planned)
query("forecast_or_history", f"""
with f as (select l.series_id as product_id, R2[sum(predicted)] as d from ({_LONG}) l
           join ({_next(30)}) n on n.series_id = l.series_id where days >= 70 group by 1)
select s.product_id, d is not null and d <> 0 as from_forecast, R2[coalesce(nullif(d, 0e0), aq*30e0)] as demand
from (select product_id, XA[quantity] as aq from sales group by 1) s left join f on f.product_id = s.product_id""")(
    lambda spark, sf: _demand(spark, sf))


def _demand(spark, sf):
    from ..operators import decisions

    sales = view(spark, sf, "sales")
    history = decisions.product_history(sales)
    out = decisions.demand_30d(history, fc.demand_30d(S.numbered_days(S.daily_demand(sales, overall=False)), []))
    return out.select("product_id", "from_forecast", (F.rint(F.col("demand") * 100.0) / 100.0 + 0.0).alias("demand"))


query("stream_daily_demand", """
select cast(ts as date) as day, event_type, R2[XS[value]] as total, count(*) as rows from events group by 1, 2""")(
    lambda spark, sf: daily_totals(spark.read.parquet(f"{sf}/events.parquet"), "ts", "value", "event_type").withColumn(
        "total", F.rint(F.col("total") * 100.0) / 100.0 + 0.0))
query("stream_dedupe", "select distinct user_id, event_type from events")(
    lambda spark, sf: drop_repeats(spark.read.parquet(f"{sf}/events.parquet"), "ts", "user_id", "event_type").select(
        "user_id", "event_type"))
