"""Business views over the test tables, in SQL text shared by Spark and the checker.

Macros in the text, filled in per engine:

* ``R<k>[x]``  half-even rounding to k decimals, without negative zero
* ``XS[x]``    exact sum of doubles (whole part and millionths as integers)
* ``XA[x]``    exact mean on top of it
* ``SI[x]``    integer sum as a 64-bit integer
* ``STR``      the string type
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["sales"] = """
select *, case when revenue<>0 then R4[gross_profit/revenue] else 0e0 end as profit_margin from (
select *, R2[revenue-cost] as gross_profit, R2[revenue-returns*net_price] as net_revenue from (
select *, R2[quantity*net_price] as revenue, R2[quantity*cost_per_unit] as cost from (
select *, R2[unit_price*(1e0-discount_rate)] as net_price from (
select *, discount/100e0 as discount_rate from (
  select cast(o.o_orderdate as date) as date,
         cast(l.l_orderkey as STR) as order_id,
         cast(l.l_linenumber as bigint)*100000 + l.l_suppkey as line_id,
         cast(l.l_partkey as STR) as product_id,
         p.p_name as product_name, p.p_type as category,
         cast(l.l_quantity as int) as quantity,
         R2[p.p_retailprice*(0.80e0+((l.l_linenumber*13+l.l_suppkey*7) % 41)/100e0)] as unit_price,
         R0[l.l_discount*100e0] as discount,
         R2[p.p_retailprice*(0.35e0+(p.p_size % 30)/100e0)] as cost_per_unit,
         R2[l.l_extendedprice*l.l_tax] as marketing_spend,
         case when l.l_returnflag='R'
              then least(cast(l.l_quantity as int),
                         (1+(l.l_linenumber % 3))*case when p.p_type='PROMO' then 3 else 1 end)
              else 0 end as returns,
         cast(o.o_custkey as STR) as customer_id, r.r_name as region,
         p.p_size*60 as inventory_units
  from lineitem l
  join orders o on l.l_orderkey=o.o_orderkey
  join part p on l.l_partkey=p.p_partkey
  join customer c on o.o_custkey=c.c_custkey
  join nation n on c.c_nationkey=n.n_nationkey
  join region r on n.n_regionkey=r.r_regionkey) b) d1) d2) d3) d4
"""

# The lines with faults; every 67th of them twice.
VIEWS["raw_sales"] = """
select date, order_id, line_id, product_id, product_name, category, quantity, unit_price, discount,
       cost_per_unit, marketing_spend, returns, customer_id, region, inventory_units
from (
  select k,
         case when k % 211=0 then 'not-a-date' else cast(date as STR) end as date,
         order_id, line_id, product_id, product_name, category,
         case when k % 401=0 then 'N/A'
              when k % 307=0 then cast(-quantity as STR)
              when k % 101=0 then null else cast(quantity as STR) end as quantity,
         case when k % 97=0 then null when k % 389=0 then 0e0 else unit_price end as unit_price,
         case when k % 53=0 then null when k % 499=0 then 120e0 else discount end as discount,
         case when k % 89=0 then null else cost_per_unit end as cost_per_unit,
         case when k % 61=0 then null else marketing_spend end as marketing_spend,
         case when k % 71=0 then null else returns end as returns,
         customer_id, region, inventory_units
  from (select *, cast(order_id as bigint)*7 + line_id % 97 as k from sales) s) f
join (values (1), (2)) c(copy) on copy = 1 or k % 67 = 0
"""

VIEWS["order_sales"] = """
select cast(o_orderkey as STR) as order_id, cast(o_orderdate as date) as date,
       1 + cast(o_orderkey % 9 as int) as quantity, o_totalprice as revenue from orders
union all
select cast(o_orderkey as STR), cast(o_orderdate as date), 1, 10e0 from orders where o_orderkey % 50 = 0
"""

VIEWS["return_lines"] = """
select cast(case when l_orderkey % 20=0 then l_orderkey+100000000 else l_orderkey end as STR) as order_id,
       cast(l_shipdate as date) as cancel_return_date, 1 as quantity,
       R2[l_extendedprice*0.1e0] as revenue
from lineitem where l_returnflag='R' and l_linenumber=1
"""

VIEWS["price_proposals"] = """
select product_id, current_price,
       R2[current_price*(0.85e0+(cast(product_id as bigint) % 7)*0.05e0)] as proposed_price
from (select product_id, R2[XA[unit_price]] as current_price from sales group by product_id) a
union all select 'UNKNOWN', 100e0, 110e0
"""

VIEWS["stock_proposals"] = """
select product_id, cast(max(inventory_units) as int) as current_inventory,
       cast(100*(cast(product_id as bigint) % 4) as int) as proposed_purchase from sales group by product_id
"""

VIEWS["spend_proposals"] = """
select category, R2[s/n*30e0] as current_spend, R2[s/n*36e0] as proposed_spend
from (select category, XS[marketing_spend] as s, count(distinct date) as n from sales group by category) a
"""

# Typed sales with faults the text columns of raw_sales cannot have.
VIEWS["odd_sales"] = """
select date, order_id, line_id, product_id, product_name, category, customer_id, region, cost_per_unit,
       marketing_spend, revenue,
       case when k % 307=0 then -quantity else quantity end as quantity,
       case when k % 503=0 then cast('Infinity' as double) when k % 389=0 then 0e0 else unit_price end as unit_price,
       case when k % 499=0 then 120e0 when k % 701=0 then -5e0 else discount end as discount,
       case when k % 83=0 then quantity+1 else returns end as returns,
       case when k % 211=0 then -inventory_units when k % 2<>0 then null else inventory_units end as inventory_units
from (select *, cast(order_id as bigint)*7 + line_id % 97 as k from sales) s
"""

# Headers as many exports would spell them: one header per order, in four spellings.
VIEWS["export_headers"] = """
select export_id, case pick % 4 when 0 then upper(name) when 1 then replace(name, ' ', '_')
                  when 2 then concat('  ', name, ' ') else concat(replace(name, ' ', '-'), '!') end as header
from (select o_custkey as export_id, cast(floor(o_orderkey/16e0) as bigint) as pick,
             split_part('order date|quantity|sku|total sales|quanity|customer state|prodct name|platform note|'
                     || 'sale ammount|discount rate|unit cost|return qty|stock quantitty|region|gross profit|product cose',
                        '|', cast(1 + o_orderkey % 16 as int)) as name from orders) h
"""

# The steps of cleaning as the checking engine sees them; Spark never reads these.
CHECK_VIEWS: dict[str, str] = {}

CHECK_VIEWS["typed_sales"] = """
select try_cast(date as date) as date, order_id, line_id, product_id, product_name, category,
       try_cast(quantity as double) as quantity, unit_price, discount, cost_per_unit, marketing_spend,
       cast(returns as double) as returns, customer_id, region, cast(inventory_units as double) as inventory_units
from (select distinct * from raw_sales) r where try_cast(date as date) is not null
"""

CHECK_VIEWS["medians"] = """
select median(quantity) as mq, median(unit_price) as mp, median(cost_per_unit) as mc,
       median(inventory_units) as mi from typed_sales
"""

CHECK_VIEWS["filled_sales"] = """
select date, order_id, line_id, product_id, product_name, category, coalesce(quantity, mq) as quantity,
       coalesce(unit_price, mp) as unit_price, coalesce(discount, 0) as discount,
       coalesce(cost_per_unit, mc) as cost_per_unit, coalesce(marketing_spend, 0) as marketing_spend,
       coalesce(returns, 0) as returns, customer_id, region, coalesce(inventory_units, mi) as inventory_units
from typed_sales, medians
"""

_DERIVED_SQL = """
select *, case when revenue<>0 then R4[gross_profit/revenue] else 0e0 end as profit_margin from (
select *, R2[revenue-cost] as gross_profit, R2[revenue-returns*net_price] as net_revenue from (
select *, R2[quantity*net_price] as revenue, R2[quantity*cost_per_unit] as cost from (
select *, R2[unit_price*(1e0-discount_rate)] as net_price from (
select *, discount/100e0 as discount_rate from {source} b) d1) d2) d3) d4
"""

CHECK_VIEWS["valid_sales"] = """
select * from filled_sales where quantity >= 0 and unit_price > 0 and cost_per_unit >= 0
"""

CHECK_VIEWS["cleaned_sales"] = _DERIVED_SQL.format(source="valid_sales")

CHECK_VIEWS["strict_rows"] = """
select date, order_id, line_id, product_id, product_name, category, try_cast(quantity as double) as quantity,
       unit_price, coalesce(discount, 0) as discount, cost_per_unit, coalesce(marketing_spend, 0) as marketing_spend,
       coalesce(cast(returns as double), 0) as returns, customer_id, region,
       cast(inventory_units as double) as inventory_units
from raw_sales
where product_id is not null and try_cast(quantity as double) >= 0 and unit_price > 0 and cost_per_unit >= 0
"""

CHECK_VIEWS["strict_sales"] = _DERIVED_SQL.format(source="strict_rows")


def _fill(text: str, macro: str, make) -> str:
    """Replace ``macro[...]`` from the innermost bracket outwards."""
    pattern = re.compile(rf"\b{macro}\[([^\[\]]*)\]")
    return pattern.sub(make, text)


def render(text: str, engine: str) -> str:
    """Fill the macros in for ``spark`` or ``duckdb``."""
    spark = engine == "spark"

    def rint(x: str) -> str:
        return f"rint({x})" if spark else f"round_even({x}, 0)"

    def rounded(m: re.Match) -> str:
        scale = f"{10 ** int(m.group(1))}e0"
        return f"({rint(f'({m.group(2)})*{scale}')}/{scale} + 0e0)"

    def total(x: str) -> str:
        whole = f"floor({x})"
        return (
            f"(cast(sum(cast({whole} as bigint)) as double) + "
            f"cast(sum(cast({rint(f'(({x})-{whole})*1e6')} as bigint)) as double)/1e6)"
        )

    before = None
    while before != text:
        before = text
        text = re.sub(r"\bR(\d)\[([^\[\]]*)\]", rounded, text)
        text = _fill(text, "XS", lambda m: total(m.group(1)))
        text = _fill(text, "XA", lambda m: f"({total(m.group(1))}/count({m.group(1)}))")
        text = _fill(text, "SI", lambda m: f"cast(sum({m.group(1)}) as bigint)")
    return re.sub(r"\bSTR\b", "string" if spark else "varchar", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _read_names(text: str) -> list[str]:
    return re.findall(r"\b(?:from|join)\s+(\w+)", text)


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A business view as a lazy DataFrame; nothing is registered in the session.

    ``given`` has views that are at hand already, by name: rows read from them need not be joined up again.
    """
    text = VIEWS[name]
    names = set(_read_names(text))
    sources = {v: given[v] if v in given else view(spark, sf_dir, v, **given) for v in VIEWS if v in names and v != name}
    sources |= {t: table(spark, sf_dir, t) for t in TABLES if t in names}
    return run_sql(spark, text, sources)


def run_sql(spark: SparkSession, text: str, sources: dict[str, DataFrame]) -> DataFrame:
    rendered = render(text, "spark")
    for name in sources:
        rendered = re.sub(rf"\b(from|join)(\s+){name}\b", rf"\1\2{{{name}}}", rendered)
    return spark.sql(rendered, **sources)


def checker_sql(text: str) -> str:
    """The same text for the checking engine, with the views it needs in front."""
    needed: list[str] = []
    views = VIEWS | CHECK_VIEWS

    def visit(body: str, me: str | None) -> None:
        for name in re.findall(r"\w+", body):
            if name in views and name != me and name not in needed:
                visit(views[name], name)
                needed.append(name)

    visit(text, None)
    body = text.strip()
    if needed:
        ctes = ",\n".join(f"{n} as ({views[n].strip()})" for n in needed)
        if re.match(r"with\b", body, re.I):
            body = f"with {ctes},\n{body[4:].lstrip()}"
        else:
            body = f"with {ctes}\n{body}"
    return render(body, "duckdb")
