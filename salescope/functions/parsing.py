"""Reading dates and numbers out of text without failing on bad values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date layouts tried in this order after the ISO forms.
DATE_FORMATS = (
    "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyyMMdd",
    "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "M/d/yyyy H:mm", "d-M-yyyy H:mm",
)

# Texts that stand for a missing value in delimited files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Forms of the cast itself: a year, month or day, and one with a time behind it.
_ISO_DAY, _ISO_TIME = r"^\d{4}(-\d{1,2}){0,2}$", r"^[+-]?\d{4,6}(-\d{1,2}){0,2}[ T].*$"

_PART = {"yyyy": r"\d{4,6}", "MMM": r"\p{L}+\.?", "MM": r"\d{2}", "dd": r"\d{2}", "mm": r"\d{2}"}


def _shape(layout: str) -> str:
    """A pattern that every text of a layout fits. It is told much faster than a reader of dates fails."""
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", layout)
    return "^" + "".join(re.escape(sign) if sign else _PART.get(c + more, r"\d{1,2}") for c, more, sign in parts) + "$"


def _try_layout(text: Column, layout: str) -> Column:
    shape = _shape(layout) if layout != "yyyyMMdd" else r"^\d{8}$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))


def parse_date_text(c: Column, formats=DATE_FORMATS, day_first: Column | None = None) -> Column:
    """A calendar day from text, null where no layout fits.

    Texts such as 3/2/2024 are read month first, or day first where ``day_first`` says so: one way for all rows of a column.
    """
    text = F.trim(c)
    tries = [F.when(text.rlike(_ISO_DAY), text.try_cast("date")), F.to_date(F.when(text.rlike(_ISO_TIME), text.try_cast("timestamp")))]
    for layout in formats:
        if layout.startswith("d/M"):
            continue
        found = _try_layout(text, layout)
        if layout.startswith("M/d"):
            swapped = _try_layout(text, layout.replace("M/d", "d/M"))
            found = F.when(day_first, swapped).otherwise(found) if day_first is not None else found
        tries.append(F.to_date(found))
    return F.coalesce(*tries)


def day_comes_first(df: DataFrame, column: str, copies: str | None = None) -> Column:
    """Whether days come before months in a text column: more of its rows can only be read so than the other way.

    One aggregate over the column, used as a value of the whole table. A row stands for as many as the column ``copies`` says.
    """
    text = F.trim(F.col(f"`{column}`").cast("string"))
    slashed = F.when(text.contains("/"), text)  # others have no vote: nothing is looked for in them
    first, second = (F.regexp_extract(slashed, r"^(\d{1,2})/(\d{1,2})/\d{4}", k).try_cast("int") for k in (1, 2))

    def votes(way: Column) -> Column:
        return F.coalesce(F.sum(F.when(way, F.col(copies))), F.lit(0)) if copies else F.count_if(way)

    days = votes((first > 12) & (first <= 31) & (second <= 12))
    months = votes((second > 12) & (second <= 31) & (first <= 12))
    return df.agg((days > months).alias("day_first")).scalar()


def parse_date(df: DataFrame, column: str, votes_from: DataFrame | None = None, copies: str | None = None) -> Column:
    """A calendar day from a date, timestamp or text column.

    All rows of a text column are read by one order of day and month; the rows of ``votes_from``, or else of ``df``, tell
    which, each as often as its column ``copies`` says.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(column))
    voters = df if votes_from is None else votes_from
    return parse_date_text(F.col(column).cast("string"), day_first=day_comes_first(voters, column, copies))


def number_text(c: Column) -> Column:
    """A double from text, null where it is not a plain decimal number.

    The cast alone would also take Java's type suffixes ("1d") and hex floats.
    """
    foreign = c.rlike(r"(?i)[0-9.][df]\s*$") | c.rlike(r"(?i)^\s*[+-]?0x")
    return F.when(~foreign, c.try_cast("double"))


def to_number(df: DataFrame, column: str) -> Column:
    """A double from a number or text column; not-a-number counts as missing."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        value = F.col(column).cast("double")
        if not isinstance(kind, (T.DoubleType, T.FloatType)):
            return value
    elif isinstance(kind, T.BooleanType):
        return F.col(column).cast("double")
    else:
        value = number_text(F.col(column).cast("string"))
    return F.when(~F.isnan(value), value)


def blank_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TEXTS), c)
