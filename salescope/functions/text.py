"""Display texts for money, counts, percentages and changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# Indian number units, currency sign and severity symbols.
CRORE = 10_000_000.0
LAKH = 100_000.0
RUPEE = "₹"
EM_DASH = "—"
SEVERITY_SYMBOLS = {
    "error": "\U0001f534",
    "warning": "\U0001f7e1",
    "info": "\U0001f535",
    "success": "\U0001f7e2",
}
OTHER_SYMBOL = "⚪"


def grouped(c: str | Column, digits: int) -> Column:
    """Thousands separators and a fixed number of decimals."""
    return F.format_number(col(c), digits)


def fixed(c: str | Column, digits: int) -> Column:
    """A fixed number of decimals, no separators."""
    return F.replace(F.format_number(col(c), digits), F.lit(","), F.lit(""))


def currency(c: str | Column, symbol: str = RUPEE) -> Column:
    value = col(c).cast("double")
    size = F.abs(value)
    body = (
        F.when(size >= CRORE, F.concat(grouped(value / CRORE, 2), F.lit(" Cr")))
        .when(size >= LAKH, F.concat(grouped(value / LAKH, 2), F.lit(" L")))
        .otherwise(grouped(value, 2))
    )
    return F.concat(F.lit(symbol), F.coalesce(body, F.lit("0.00")))


def number(c: str | Column, digits: int = 0) -> Column:
    """Truncated to a whole number for zero digits, otherwise rounded."""
    value = col(c).cast("double")
    shown = grouped(value.cast("bigint"), 0) if digits == 0 else grouped(value, digits)
    return F.coalesce(shown, F.lit("0"))


def percent(c: str | Column, digits: int = 1) -> Column:
    shown = F.concat(fixed(col(c).cast("double") * 100.0, digits), F.lit("%"))
    return F.coalesce(shown, F.lit("0.0%"))


def change(c: str | Column, prefix: str = RUPEE) -> Column:
    value = col(c).cast("double")
    sign = F.when(value > 0, F.lit("+")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, F.lit(prefix), grouped(value, 2)), F.lit(EM_DASH))


def change_percent(c: str | Column) -> Column:
    value = col(c).cast("double")
    sign = F.when(value > 0, F.lit("+")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, fixed(value, 1), F.lit("%")), F.lit(EM_DASH))


def severity_symbol(c: str | Column) -> Column:
    picked = F.lit(OTHER_SYMBOL)
    for name, symbol in SEVERITY_SYMBOLS.items():
        picked = F.when(col(c) == name, F.lit(symbol)).otherwise(picked)
    return picked


def key_text(c: str | Column) -> Column:
    """An order key as trimmed text, so 17 and ' 17 ' meet in a join."""
    return F.trim(col(c).cast("string"))
