"""Data-quality rules on tables with faults."""

from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import quality as ops
from ..plans.registry import query

SHOWN = ["rule", "field", "severity", "affected", "pct"]


def _rule(name, rule, source, sql):
    def build(spark, sf):
        return ops.quality_issues(view(spark, sf, source)).where(F.col("rule") == rule).select(*SHOWN)

    query(name, sql)(build)


def _count(rule, field, severity, source, test):
    return (
        f"select '{rule}' as rule, {field} as field, '{severity}' as severity, count(*) as affected,"
        f" cast(null as double) as pct from {source} where {test} having count(*) > 0"
    )


def _gap(field, source, critical, null_test=None):
    test = null_test or f"{field} is null"
    severity = "case when R1[g*100e0/n] > 50 then 'error' else 'warning' end" if critical else "'warning'"
    return (
        f"select 'missing' as rule, '{field}' as field, {severity} as severity, g as affected,"
        f" R1[(cast(g as double)/n)*100e0] as pct"
        f" from (select count(*) filter (where {test}) as g, count(*) as n from {source}) x where g > 0"
    )


_RAW_GAPS = " union all ".join([
    _gap("quantity", "raw_sales", True), _gap("unit_price", "raw_sales", True),
    *[_gap(c, "raw_sales", False) for c in ("discount", "cost_per_unit", "marketing_spend", "returns")],
])
_TEXT = (
    "select 'non_numeric' as rule, 'quantity' as field, 'error' as severity,"
    " count(*) filter (where quantity is not null and try_cast(quantity as double) is null) as affected,"
    " cast(null as double) as pct from raw_sales"
)
_DATES = _count("bad_date", "'date'", "error", "raw_sales", "date is not null and try_cast(date as date) is null")
_REPEATS = (
    "select 'duplicates' as rule, cast(null as varchar) as field, 'warning' as severity, SI[n-1] as affected,"
    " cast(null as double) as pct from (select count(*) - (select count(*) from (select distinct * from raw_sales) d) + 1 as n"
    " from raw_sales) g"
)
_FREE = _count("zero_price", "'unit_price'", "warning", "raw_sales", "unit_price = 0")
_DISCOUNT = _count("discount_range", "'discount'", "error", "{0}", "discount < 0 or discount > 100")

_rule("dq_non_numeric", "non_numeric", "raw_sales", _TEXT)
_rule("dq_bad_date", "bad_date", "raw_sales", _DATES)
_rule("dq_missing", "missing", "raw_sales", _RAW_GAPS)
_rule("dq_duplicates", "duplicates", "raw_sales", _REPEATS)
_rule("dq_zero_price", "zero_price", "raw_sales", _FREE)
_rule("dq_infinite", "infinite", "odd_sales",
      "select rule, field, severity, cast(affected as bigint) as affected, pct from ("
      + _count("infinite", "'unit_price'", "error", "odd_sales", "isinf(unit_price)") + ") x")
_rule("dq_negative", "negative", "odd_sales",
      _count("negative", "'quantity'", "error", "odd_sales", "quantity < 0") + " union all "
      + _count("negative", "'inventory_units'", "error", "odd_sales", "inventory_units < 0"))
_rule("dq_discount_range", "discount_range", "odd_sales", _DISCOUNT.format("odd_sales"))
_rule("dq_returns_exceed", "returns_exceed", "odd_sales",
      _count("returns_exceed", "'returns'", "error", "odd_sales", "returns > quantity"))

query("dq_empty", """
select 'empty' as rule, cast(null as varchar) as field, 'error' as severity, count(*) as affected,
       cast(null as double) as pct from sales where quantity < 0""")(
    lambda spark, sf: ops.quality_issues(view(spark, sf, "sales").where("quantity < 0")).select(*SHOWN))


def _by_region(spark, sf):
    sales = view(spark, sf, "sales")
    return sales.groupBy("region").agg(
        F.max("date").alias("date"), F.sum("quantity").alias("quantity"), F.max("revenue").alias("revenue"))


query("dq_min_rows", """
select 'min_rows' as rule, cast(null as varchar) as field, 'warning' as severity, count(*) as affected,
       cast(null as double) as pct from (select region from sales group by region) r having count(*) < 50""")(
    lambda spark, sf: ops.quality_issues(_by_region(spark, sf)).where("rule = 'min_rows'").select(*SHOWN))

_ALL = " union all ".join([_TEXT, _DATES, _RAW_GAPS, _REPEATS, _FREE, _DISCOUNT.format("raw_sales")])
query("dq_issues", f"select * from ({_ALL}) a")(
    lambda spark, sf: ops.validate(view(spark, sf, "raw_sales")).where("rule <> 'optional_missing'").select(*SHOWN))
query("dq_report", f"""
select e as errors, w as warnings, e + w as total_issues, e = 0 as is_valid,
       'Errors: ' || e || ', warnings: ' || w || '.' as summary
from (select count(*) filter (where severity = 'error') as e, count(*) filter (where severity = 'warning') as w
      from ({_ALL}) a) t""")(
    lambda spark, sf: ops.report(ops.validate(view(spark, sf, "raw_sales").withColumn("revenue", F.lit(1.0)))))
