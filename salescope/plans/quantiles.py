"""Exact quantiles of large columns without gathering their values.

Values are first counted by bucket of a fixed, order-keeping scale, coarse enough that the counts combine on the map side.
The running counts tell which bucket holds each wanted rank. That bucket is cut evenly between its smallest and largest
value, counted again, and the part with the rank cut once more; only what is left is counted value by value. So values that lie
close together, such as cents around a large amount, spread over tasks as well as others, no sketch has to be merged
in one place, and equal values cost nothing. The columns asked for are written once before, as every count reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

# Buckets per doubling of 1 + |value|, and how often and in how many parts a marked bucket is cut evenly.
FINENESS = 256
LEVELS = 2
PARTS = 2_048


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate next to every row.

    A global aggregate is one row by definition, so sending it to all tasks is safe.
    """
    return df.crossJoin(F.broadcast(one_row))


def bucket(v: Column, fineness: int = FINENESS) -> Column:
    """A whole number that never falls when the value rises."""
    return F.floor(F.signum(v) * F.log2(F.abs(v) + 1.0) * F.lit(float(fineness)))


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """The number of the even part of [lo, hi] that a value lies in; halves keep the differences finite."""
    share = (v / 2.0 - lo / 2.0) / (hi / 2.0 - lo / 2.0)
    return F.when(hi > lo, F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0)).cast("long")


def _wanted(counts: DataFrame, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(name, lo, hi, before, n) of the buckets that hold a wanted rank: at most one per column and rank."""
    hit = F.lit(False)
    for r in ranks(F.col("n")):
        hit = hit | ((r >= F.col("before")) & (r < F.col("before") + F.col("k")))
    return counts.where(hit).select("name", "lo", "hi", "before", "n")


def _inside(long: DataFrame, marks: DataFrame) -> DataFrame:
    return long.join(F.broadcast(marks), (F.col("name") == F.col("in")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _counts_around(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[Column], list[Column]], fineness: int
) -> DataFrame:
    """(name, v, upto, n): values of the last buckets holding a wanted rank, with the number
    of rows up to and including each value."""
    held = written(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "values")
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("v")) for i, c in enumerate(columns)])
    long = held.select(F.explode(pairs).alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = F.count(F.lit(1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")

    whole = Window.partitionBy("name")
    running = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    coarse = long.groupBy("name", bucket(F.col("v"), fineness).alias("b")).agg(*sizes)
    counts = coarse.withColumns({
        "before": F.coalesce(F.sum("k").over(running), F.lit(0)), "n": F.sum("k").over(whole)})
    for _ in range(LEVELS):
        marks = _wanted(counts, ranks).withColumnRenamed("name", "in")
        parts = _inside(long, marks).groupBy(
            "name", F.col("lo").alias("from"), "before", "n", _part(F.col("v"), F.col("lo"), F.col("hi")).alias("b")).agg(*sizes)
        running = Window.partitionBy("name", "from").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counts = parts.withColumn("before", F.col("before") + F.coalesce(F.sum("k").over(running), F.lit(0)))

    marks = _wanted(counts, ranks).withColumnRenamed("name", "in")
    fine = _inside(long, marks).groupBy("name", "lo", "before", "n", "v").agg(F.count(F.lit(1)).alias("k"))
    running = F.sum("k").over(Window.partitionBy("name", "lo").orderBy("v"))
    return fine.select("name", "v", (F.col("before") + running).alias("upto"), "n")


def _value_at(rank: Column) -> Column:
    return F.min(F.when(F.col("upto") > rank, F.col("v")))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], fineness: int = FINENESS
) -> DataFrame:
    """One row (name, n, q0, q1, ...) per column, interpolated as numpy does by default."""
    def ends(n: Column) -> list[Column]:
        return [side(F.lit(p) * (n - 1)) for p in probs for side in (F.floor, F.ceil)]

    values = [_value_at(r) for r in ends(F.col("n"))]
    found = [v.alias(f"{('lo', 'hi')[i % 2]}{i // 2}") for i, v in enumerate(values)]
    picked = _counts_around(df, columns, ends, fineness).groupBy("name").agg(F.max("n").alias("n"), *found)
    return picked.select("name", "n", *[_between(i, p).alias(f"q{i}") for i, p in enumerate(probs)])


def _between(i: int, p: float) -> Column:
    lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
    rank = F.lit(p) * (F.col("n") - 1)
    part = rank - F.floor(rank)
    return (
        F.when(part == 0.0, lo)
        .when(part == 0.5, (lo + hi) / 2.0)
        .otherwise(lo + (hi - lo) * part)
    )


def exact_medians(df: DataFrame, columns: Sequence[str], fineness: int = FINENESS) -> DataFrame:
    """One row with the exact median of each column (null if it has no value)."""
    rows = exact_quantiles(df, columns, [0.5], fineness)
    return rows.agg(*[F.max(F.when(F.col("name") == c, F.col("q0"))).alias(f"median_{c}") for c in columns])


def value_at(df: DataFrame, column: str, rank: Callable[[Column], Column], fineness: int = FINENESS) -> DataFrame:
    """One row with the value at the 0-based position ``rank(n)``."""
    counts = _counts_around(df, [column], lambda n: [rank(n)], fineness)
    return counts.agg(_value_at(rank(F.col("n"))).alias("value"))
