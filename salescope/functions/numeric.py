"""Rounding, exact sums and guarded arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000.0
#: Whole numbers below this have an exact double.
LARGEST_EXACT = float(2**53)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, digits: int = 0) -> Column:
    """Half-even rounding of the scaled double; adding zero turns -0.0 into 0.0."""
    scale = F.lit(10.0 ** digits)
    return F.rint(col(c).cast("double") * scale) / scale + F.lit(0.0)


def exact_sum(c: str | Column) -> Column:
    """Sum of doubles that does not depend on the order tasks deliver them in.

    A value is split into its whole part and its millionths, and both are summed
    as 64-bit integers, which stay in generated code. Adding doubles directly
    would lose cents on large tables and change with the task order. Digits beyond a
    millionth are lost. Values that no 64-bit integer holds, infinities and NaN among
    them, are added as doubles beside that.
    """
    value = col(c).cast("double")
    held = F.abs(value) < F.lit(LARGEST_EXACT)
    exact, rest = F.when(held, value), F.sum(F.when(~held, value))
    whole = F.floor(exact)
    micro = F.rint((exact - whole) * F.lit(MICRO)).cast("bigint")
    parts = F.sum(whole).cast("double") + F.sum(micro).cast("double") / F.lit(MICRO)
    return F.when(rest.isNull(), parts).otherwise(F.coalesce(parts, F.lit(0.0)) + rest)


def exact_avg(c: str | Column) -> Column:
    """Mean over non-null values on top of :func:`exact_sum`; null for no values."""
    count = F.count(col(c))
    return F.when(count > 0, exact_sum(c) / count)


def total(c: str | Column, digits: int = 2) -> Column:
    """Rounded sum, zero where there is nothing to add."""
    return round_even(F.coalesce(exact_sum(c), F.lit(0.0)), digits)


def mean(c: str | Column, digits: int = 2) -> Column:
    return round_even(exact_avg(c), digits)


def ratio(n: str | Column, d: str | Column, otherwise: float | None = 0.0) -> Column:
    """n / d where d is positive, else ``otherwise``."""
    return F.when(col(d) > 0, col(n) / col(d)).otherwise(F.lit(otherwise))


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def finite(c: str | Column) -> Column:
    """The value, or null where it is infinite or not a number."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def is_infinite(c: str | Column) -> Column:
    return F.abs(col(c).cast("double")) == F.lit(float("inf"))
