"""Readers, header mapping and exports. The files are written from the test tables."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import view
from ..plans.registry import query
from ..plans.session import scratch, ship_package
from ..sources import exports, headers, readers

_TYPED = """
select try_cast(date as date) as date, order_id, line_id, product_id, product_name, category, quantity, unit_price,
       discount, cost_per_unit, marketing_spend, returns, customer_id, region, inventory_units
from (select date, order_id, cast(line_id as varchar) as line_id, product_id, product_name, category,
             case when quantity <> 'N/A' then quantity end as quantity, unit_price, discount, cost_per_unit,
             marketing_spend, cast(returns as double) as returns, customer_id, region,
             cast(inventory_units as double) as inventory_units from raw_sales) r
"""
_READ = _TYPED.replace("quantity, unit_price,\n", "cast(quantity as double) as quantity, unit_price,\n")

_JSON = (
    _READ.replace("cast(line_id as varchar) as line_id", "line_id").replace("cast(returns as double) as returns", "returns")
    .replace("cast(inventory_units as double) as inventory_units", "inventory_units")
    .replace("case when quantity <> 'N/A' then quantity end", "quantity")
    .replace("cast(quantity as double)", "quantity")
)

#: Lines of one packed file.
LINES = 500_000


def _file(spark, sf, kind, writer, **options):
    path = f"{scratch(spark, kind)}.{kind}"
    out = view(spark, sf, "raw_sales").write
    for k, v in options.items():
        out = out.option(k, v)
    getattr(out, writer)(path)
    return readers.read_business_table(spark, path).df


query("src_csv", _READ)(lambda spark, sf: _file(spark, sf, "csv", "csv", header=True))


def _two_orders(spark, sf):
    """Half of the lines with their columns in one order, half in the other, in one folder."""
    path = f"{scratch(spark, 'orders')}.csv"
    raw = view(spark, sf, "raw_sales")
    half = F.pmod(F.xxhash64("order_id", "line_id"), F.lit(2))
    raw.where(half == 0).write.option("header", True).mode("append").csv(path)
    raw.where(half == 1).select(*reversed(raw.columns)).write.option("header", True).mode("append").csv(path)
    return readers.read_business_table(spark, path).df


query("src_csv_headers", _READ)(_two_orders)
query("src_tsv", _READ)(lambda spark, sf: _file(spark, sf, "tsv", "csv", header=True, sep="\t"))
# Lines repeat the names of all columns: packed they take little disk. A packed file is read by one task, so files are kept short.
query("src_jsonl", _JSON)(lambda spark, sf: _file(spark, sf, "jsonl", "json", compression="lz4", maxRecordsPerFile=LINES))


def _array_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition as the lines of one JSON array, batch by batch."""
    opener = "["
    for batch in batches:
        lines = batch["j"].tolist()
        if lines:
            starts = [opener] + [","] * (len(lines) - 1)
            opener = ","
            yield pd.DataFrame({"value": [s + j for s, j in zip(starts, lines, strict=True)]})
    if opener == ",":
        yield pd.DataFrame({"value": ["]"]})


def _json_arrays(spark, sf):
    """One JSON array document per partition, written as text and read back."""
    ship_package(spark)
    path = f"{scratch(spark, 'arrays')}.json"
    sales = view(spark, sf, "sales").select("date", "order_id", "line_id", "product_id", "quantity", "unit_price")
    text = sales.select(F.to_json(F.struct("*")).alias("j"))
    text.mapInPandas(_array_lines, "value string").write.text(path)
    return readers.read_business_table(spark, path).df


query("src_parquet", "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 25")(
    lambda spark, sf: readers.read_parquet(spark, f"{sf}/lineitem.parquet")
    .select("l_orderkey", "l_partkey", "l_quantity").where("l_quantity > 25"))

query("src_parquet_all", "select * from lineitem")(lambda spark, sf: readers.read_parquet(spark, f"{sf}/lineitem.parquet"))

query("load_report", """
select count(*) as rows_loaded, cast(6 as bigint) as columns_loaded, 'Parquet' as file_type,
       'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' as column_names,
       '' as column_mappings, '' as uncertain_columns from orders""")(
    lambda spark, sf: readers.load_report(readers.read_business_table(spark, f"{sf}/orders.parquet")))


def _two_exports(spark, sf):
    """Order sales as two exports with marketplace headers and a return report."""
    sales, returns = view(spark, sf, "order_sales"), view(spark, sf, "return_lines")
    named = sales.select(F.col("date").alias("Order_Date"), F.col("order_id").alias("Sub_Order_Num"),
                         F.col("quantity").alias("Quanity"), F.col("revenue").alias("Total_Taxable_Sale_Value"))
    half = F.pmod(F.col("Sub_Order_Num").cast("bigint"), F.lit(2))
    base = scratch(spark, "exports")
    named.where(half == 0).write.parquet(f"{base}/sales_a.parquet")
    named.where(half == 1).withColumn("Platform_Note", F.lit("b")).write.parquet(f"{base}/sales_b.parquet")
    returns.write.parquet(f"{base}/return_report.parquet")
    return [f"{base}/sales_a.parquet", f"{base}/sales_b.parquet", f"{base}/return_report.parquet"]


query("union_exports", """
select date, order_id, cast(quantity as int) as quantity, revenue,
       case when cast(order_id as bigint) % 2 = 1 then 'b' end as platform_note from order_sales""")(
    lambda spark, sf: exports.load_exports(spark, _two_exports(spark, sf)[:2]).sales)
query("load_business_files", """
select o.date, o.order_id, cast(o.quantity as int) as quantity, o.revenue,
       case when cast(o.order_id as bigint) % 2 = 1 then 'b' end as platform_note,
       coalesce(cast(units as double), 0e0) as returns, coalesce(val, 0e0) as returned_revenue
from order_sales o left join (
  select order_id as k, sum(quantity) as units, XS[revenue] as val from return_lines
  where order_id in (select order_id from order_sales group by 1 having count(*) = 1) group by 1) a on o.order_id = a.k
""")(lambda spark, sf: exports.load_exports(spark, _two_exports(spark, sf)).sales)

query("union_sales", """
select order_id, quantity, revenue, cast(null as date) as cancel_return_date from order_sales
union all select order_id, quantity, revenue, cancel_return_date from return_lines""")(
    lambda spark, sf: exports.union_rows([
        view(spark, sf, "order_sales").drop("date"), view(spark, sf, "return_lines")]))

_KEY = "trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g'))"
_NAMES = "(values " + ", ".join(f"('{k}', '{f}', '{m}')" for k, f, m in headers.known_names()) + ") n(k, field, match)"


def _headers(name, build, sql=None):
    query(name, sql)(lambda spark, sf: build(view(spark, sf, "export_headers")))


_headers("header_key", lambda h: h.withColumn("header_key", headers.header_key("header")),
         f"select export_id, header, {_KEY} as header_key from export_headers")
_headers("map_alias", headers.map_known, f"""
select export_id, header, header_key, field, match
from (select *, {_KEY} as header_key from export_headers) h left join {_NAMES} on h.header_key = n.k""")
# What the similarity of names gives for the unknown headers of the fixture, worked out by hand.
_SIMILAR = """(values ('quanity', 'quantity'), ('prodct name', 'product_name'), ('sale ammount', 'revenue'),
('stock quantitty', 'inventory_units')) v(k, field)"""
_headers("header_collisions", lambda h: headers.header_collisions(h, "export_id"), f"""
select export_id, field, count(*) as headers
from (select *, {_KEY} as header_key from export_headers) h
join (select k, field from {_NAMES} union all select k, field from {_SIMILAR}) n on h.header_key = n.k
group by 1, 2 having count(*) > 1""")
_headers("map_fuzzy", lambda h: headers.map_similar(h).where("field is not null").drop("candidates"), f"""
select k as header_key, count(*) as occurrences, field, 'similar name' as match
from (select {_KEY} as header_key from export_headers) h join {_SIMILAR} on h.header_key = k group by k, field""")
_headers("uncertain_headers", lambda h: headers.map_similar(h).where("field is null and size(candidates) > 0")
         .select("header_key", "occurrences", F.array_join("candidates", ", ").alias("candidates")), f"""
select {_KEY} as header_key, count(*) as occurrences, 'product_id, cost_per_unit' as candidates
from export_headers where {_KEY} = 'product cose' group by 1""")
query("src_json", """
select date, order_id, line_id, product_id, cast(quantity as bigint) as quantity, unit_price from sales""")(_json_arrays)
