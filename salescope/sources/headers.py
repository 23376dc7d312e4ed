"""Recognising business columns by their header.

Two forms of the same rules: for one table the few header names are mapped while
the plan is built; for a catalog of headers from many exports the mapping is a
Spark job over the headers.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship_package

# Known header names per business field.
ALIASES = {
    "date": ["order date", "date of order", "sale date", "sales date", "transaction date", "invoice date",
             "purchase date"],
    "order_id": ["order number", "order no", "order ref", "sub order number", "sub order num", "sub order no",
                 "suborder number", "transaction id", "invoice number", "invoice no", "order item id"],
    "product_id": ["sku", "seller sku", "supplier sku", "product sku", "item sku", "item id", "variant id",
                   "product code", "style code", "listing id"],
    "product_name": ["item name", "product title", "item title", "listing name", "style name", "item description"],
    "category": ["product category", "item category", "category name", "hsn", "hsn code", "commodity code"],
    "quantity": ["qty", "units", "quantity sold", "units sold", "sold quantity", "sold qty", "sale quantity",
                 "item quantity", "number of units"],
    "unit_price": ["price", "selling price", "sale price", "item price", "price per unit", "unit selling price",
                   "supplier discounted price", "discounted price"],
    "revenue": ["total sales", "sales value", "sale value", "sale amount", "sales amount", "total sales amount",
                "total sale value", "taxable sale value", "total taxable sale value", "net sales",
                "net sales amount", "line total"],
    "discount": ["discount percent", "discount percentage", "discount pct", "discount rate"],
    "cost_per_unit": ["unit cost", "cost price", "purchase price", "cost per item", "product cost"],
    "marketing_spend": ["ad spend", "advertising spend", "advertising cost", "marketing cost", "campaign spend"],
    "returns": ["return quantity", "returned quantity", "return qty", "returned units", "units returned"],
    "customer_id": ["buyer id", "customer number", "customer no", "buyer user id", "customer code"],
    "region": ["state", "customer state", "shipping state", "delivery state", "destination state",
               "end customer state new", "customer location"],
    "inventory_units": ["stock on hand", "available stock", "inventory quantity", "closing stock", "current stock",
                        "stock quantity"],
}

# Names the library makes itself; they keep their meaning.
INTERNAL = [
    "discount_rate", "net_price", "net_revenue", "gross_profit", "profit_margin", "cost", "sales_velocity",
    "year", "month", "day", "day_of_week", "week_of_year", "quarter", "is_weekend", "is_month_start",
    "is_month_end", "month_sin", "month_cos", "price_to_cost_ratio", "effective_discount", "marketing_per_unit",
    "return_rate", "inventory_to_sales", "returned_revenue",
]

# Least similarity to accept a field, and least lead over the next one.
SIMILAR = 0.90
LEAD = 0.07

CANONICAL, KNOWN, CLOSE = "canonical field", "recognized name", "similar name"


def header_key(c: str | Column) -> Column:
    """Lower-case words of a header with single spaces between them."""
    text = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def key_of(header: str) -> str:
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in str(header).casefold())
    return " ".join(words.split())


def known_names() -> list[tuple[str, str, str]]:
    """(key, field, match) for every canonical and known name; canonical names win."""
    names = {key_of(f): (f, CANONICAL) for f in [*ALIASES, *INTERNAL]}
    for field, others in ALIASES.items():
        for other in others:
            names.setdefault(key_of(other), (field, KNOWN))
    return [(key, field, match) for key, (field, match) in names.items()]


def _similarity(key: str, name: str, floor: float) -> float:
    """Sequence similarity, or 0 once a cheap upper bound shows it is below ``floor``."""
    m = SequenceMatcher(None, key, name)
    if m.real_quick_ratio() < floor or m.quick_ratio() < floor:
        return 0.0
    return m.ratio()


@lru_cache(maxsize=65536)
def similar_fields(key: str) -> list[tuple[str, float]]:
    """Fields by falling similarity; fields too far off to matter score 0."""
    floor = SIMILAR - LEAD
    scores = []
    for field, others in ALIASES.items():
        names = [field.replace("_", " "), *others]
        scores.append((field, max(_similarity(key, key_of(n), floor) for n in names)))
    return sorted(scores, key=lambda s: -s[1])


def judge(key: str) -> tuple[str | None, str | None, list[str]]:
    """(field, match, candidates) of an unknown header key."""
    scores = similar_fields(key)
    (best, top), (_, second) = scores[0], scores[1]
    if top >= SIMILAR and top - second >= LEAD:
        return best, CLOSE, []
    return None, None, [f for f, s in scores[:3] if s >= SIMILAR]


def map_headers(names: list[str]) -> tuple[list[dict], list[dict]]:
    """Mappings and uncertain headers of one table; two headers for one field fail."""
    known = {key: (field, match) for key, field, match in known_names()}
    mapped, uncertain = [], []
    for name in names:
        key = key_of(name)
        field, match, candidates = (*known[key], []) if key in known else judge(key)
        if field:
            mapped.append({"source": name, "field": field, "match": match})
        elif candidates:
            uncertain.append({"source": name, "candidates": candidates})
    by_field: dict[str, list[str]] = {}
    for m in mapped:
        by_field.setdefault(m["field"], []).append(m["source"])
    clashes = "; ".join(f"{f}: {', '.join(s)}" for f, s in by_field.items() if len(s) > 1)
    if clashes:
        raise ValueError(f"More than one column means the same business field ({clashes}). Keep one of them.")
    return mapped, uncertain


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case column names; two equal names afterwards fail."""
    names = [c.strip().lower() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Column names are duplicated after trimming and lowercasing: {', '.join(twice)}.")
    return df.toDF(*names)


def map_columns(df: DataFrame) -> tuple[DataFrame, list[dict], list[dict]]:
    """The table with recognised columns renamed, the renamings and the uncertain headers."""
    mapped, uncertain = map_headers(df.columns)
    changed = [m for m in mapped if m["source"] != m["field"]]
    return df.withColumnsRenamed({m["source"]: m["field"] for m in changed}), changed, uncertain


def mapping_report(df: DataFrame) -> DataFrame:
    """The renamings of a table as rows (source, field, match)."""
    _, changed, _ = map_columns(df)
    rows = [(m["source"], m["field"], m["match"]) for m in changed]
    return df.sparkSession.createDataFrame(rows, "source string, field string, match string")


# ---- catalog form -----------------------------------------------------------


_JUDGED = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("candidates", T.ArrayType(T.StringType())),
])


@F.pandas_udf(_JUDGED)
def _judge_keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for keys in batches:
        judged = [judge(k) for k in keys]
        yield pd.DataFrame(judged, columns=["field", "match", "candidates"])


def map_known(headers: DataFrame, header: str = "header") -> DataFrame:
    """Headers with ``header_key``, ``field`` and ``match`` where the name is known.

    The table of names is a fixed list of some 140 rows, so it is broadcast.
    """
    names = headers.sparkSession.createDataFrame(known_names(), "header_key string, field string, match string")
    return headers.withColumn("header_key", header_key(header)).join(F.broadcast(names), "header_key", "left")


def map_similar(headers: DataFrame, header: str = "header") -> DataFrame:
    """Scores for header keys no list knows; each distinct key is scored once."""
    ship_package(headers.sparkSession)
    unknown = map_known(headers, header).where(F.col("field").isNull() & (F.col("header_key") != ""))
    keys = unknown.groupBy("header_key").agg(F.count(F.lit(1)).alias("occurrences"))
    return keys.withColumn("j", _judge_keys("header_key")).select("header_key", "occurrences", "j.*")


def map_catalog(headers: DataFrame, header: str = "header") -> DataFrame:
    """All headers with ``header_key``, ``field`` and ``match``, by known names first and by similar ones for the rest.

    Every distinct unknown key is scored once; the scores are joined back by key.
    """
    known = map_known(headers, header)
    similar = map_similar(headers, header).where(F.col("field").isNotNull()).select(
        "header_key", F.col("field").alias("__field"), F.col("match").alias("__match"))
    both = known.join(similar, "header_key", "left")
    return both.withColumns({
        "match": F.coalesce("match", "__match"), "field": F.coalesce("field", "__field")}).drop("__field", "__match")


def header_collisions(headers: DataFrame, export: str, header: str = "header") -> DataFrame:
    """Exports with more than one header for the same field, by known or similar names."""
    mapped = map_catalog(headers, header).where(F.col("field").isNotNull())
    counts = mapped.groupBy(export, "field").agg(F.count(F.lit(1)).alias("headers"))
    return counts.where(F.col("headers") > 1)
