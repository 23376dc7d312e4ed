"""Canonical sales columns and the plan-time column gate.

Operators look only at ``df.columns`` / ``df.schema`` to decide which outputs
they can offer, so gating never runs a job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The business columns every table is described with.
REQUIRED_COLUMNS = ("date", "quantity")
SALE_VALUE_COLUMNS = ("unit_price", "revenue")
OPTIONAL_COLUMNS = (
    "order_id", "product_id", "product_name", "category", "unit_price",
    "revenue", "discount", "cost_per_unit", "marketing_spend", "returns",
    "customer_id", "region", "inventory_units",
)
NUMERIC_COLUMNS = (
    "quantity", "unit_price", "discount", "cost_per_unit", "marketing_spend",
    "returns", "inventory_units", "revenue", "returned_revenue",
)
TEXT_COLUMNS = ("order_id", "product_id", "product_name", "category", "customer_id", "region")

PRODUCT_KEYS = ("product_id", "product_name", "category")


def has(df: DataFrame, *columns: str) -> bool:
    """True when every named column is present."""
    return set(columns) <= set(df.columns)


def require(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} needs the column(s): {', '.join(missing)}.")


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def is_temporal(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nothing(df: DataFrame, ddl: str) -> DataFrame:
    """The empty, typed result of an operator whose input columns are missing."""
    return df.sparkSession.createDataFrame([], ddl)
