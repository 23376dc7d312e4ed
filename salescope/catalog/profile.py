"""Column and table profiles."""

from ..fixtures import view
from ..operators import profile as ops
from ..plans.registry import query

_COLUMNS = [("date", "string"), ("order_id", "string"), ("product_id", "string"), ("category", "string"),
            ("quantity", "string"), ("unit_price", "double"), ("returns", "int")]

query("column_profile", " union all ".join(
    f"select '{c}' as field, '{t}' as type, count({c}) as non_null, count(*) - count({c}) as missing,"
    f" count(distinct {c}) as distinct_values from raw_sales" for c, t in _COLUMNS))(
    lambda spark, sf: ops.column_profile(view(spark, sf, "raw_sales").select(*[c for c, _ in _COLUMNS])))
query("dataset_profile", """
select count(*) as rows, cast(15 as bigint) as columns,
       SI[case when quantity is null then 1 else 0 end + case when unit_price is null then 1 else 0 end
          + case when discount is null then 1 else 0 end + case when cost_per_unit is null then 1 else 0 end
          + case when marketing_spend is null then 1 else 0 end + case when returns is null then 1 else 0 end] as missing_cells,
       count(*) - (select count(*) from (select distinct * from raw_sales) d) as duplicate_rows from raw_sales""")(
    lambda spark, sf: ops.dataset_profile(view(spark, sf, "raw_sales")))

_NUMBERS = ["quantity", "unit_price", "cost_per_unit", "discount", "returns", "revenue", "gross_profit"]
query("describe_numeric", " union all ".join(
    f"select '{c}' as field, count({c}) as count, R2[XA[{c}]] as mean, R2[stddev_samp({c})] as std,"
    f" R2[min({c})] as min, R2[quantile_cont(cast({c} as double), 0.25)] as p25,"
    f" R2[quantile_cont(cast({c} as double), 0.5)] as p50, R2[quantile_cont(cast({c} as double), 0.75)] as p75,"
    f" R2[max({c})] as max from sales" for c in _NUMBERS))(
    lambda spark, sf: ops.describe_numeric(view(spark, sf, "sales"), _NUMBERS))


_ALL_COLUMNS = [("date", "string"), ("order_id", "string"), ("line_id", "bigint"), ("product_id", "string"),
                ("product_name", "string"), ("category", "string"), ("quantity", "string"), ("unit_price", "double"),
                ("discount", "double"), ("cost_per_unit", "double"), ("marketing_spend", "double"), ("returns", "int"),
                ("customer_id", "string"), ("region", "string"), ("inventory_units", "int")]

query("column_profile_all", " union all ".join(
    f"select '{c}' as field, '{t}' as type, count({c}) as non_null, count(*) - count({c}) as missing,"
    f" count(distinct {c}) as distinct_values from raw_sales" for c, t in _ALL_COLUMNS))(
    lambda spark, sf: ops.column_profile(view(spark, sf, "raw_sales")))

_ALL_NUMBERS = ["line_id", "quantity", "unit_price", "discount", "cost_per_unit", "marketing_spend", "returns",
                "inventory_units", "discount_rate", "net_price", "revenue", "cost", "gross_profit", "net_revenue", "profit_margin"]
query("describe_numeric_all", " union all ".join(
    f"select '{c}' as field, count({c}) as count, R2[XA[{c}]] as mean, R2[stddev_samp({c})] as std,"
    f" R2[min({c})] as min, R2[quantile_cont(cast({c} as double), 0.25)] as p25,"
    f" R2[quantile_cont(cast({c} as double), 0.5)] as p50, R2[quantile_cont(cast({c} as double), 0.75)] as p75,"
    f" R2[max({c})] as max from sales" for c in _ALL_NUMBERS))(
    lambda spark, sf: ops.describe_numeric(view(spark, sf, "sales"), _ALL_NUMBERS))
