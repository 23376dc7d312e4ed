"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_avg, round_even
from ..plans.quantiles import exact_quantiles
from ..schema import numeric_columns


def column_profile(df: DataFrame) -> DataFrame:
    """Type, filled, missing and distinct values per column.

    All columns are turned into (column, value) pairs and equal pairs combined on the
    map side, so one shuffle of distinct values serves every column.
    """
    types = dict(df.dtypes)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in df.columns
    ])
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    filled = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
    missing = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
    out = counts.groupBy("field").agg(
        filled.alias("non_null"), missing.alias("missing"), F.count("v").alias("distinct_values"))
    return out.select("field", kinds[F.col("field")].alias("type"), "non_null", "missing", "distinct_values")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and repeated rows, from one grouping by full row."""
    gaps = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("__n"), zero).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(gaps * F.col("__n")), zero).alias("missing_cells"),
        F.coalesce(F.sum(F.col("__n") - 1), zero).alias("duplicate_rows"),
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, two decimals. NaN is no value."""
    names = columns or numeric_columns(df)
    kinds = dict(df.dtypes)
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names if kinds[c] in ("float", "double")})
    parts = [f for c in names for f in (
        F.count(c).alias(f"count_{c}"), exact_avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"),
        F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}"))]
    rows = F.array(*[
        F.struct(F.lit(c).alias("name"), *[
            F.col(f"{s}_{c}").alias(s) for s in ("count", "mean", "std", "min", "max")]) for c in names
    ])
    base = df.agg(*parts).select(F.explode(rows).alias("x")).select("x.*")
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    joined = base.join(quartiles, "name", "left")
    return joined.select(
        F.col("name").alias("field"), "count",
        *[round_even(s, 2).alias(s) for s in ("mean", "std", "min")],
        *[round_even(q, 2).alias(n) for q, n in (("q0", "p25"), ("q1", "p50"), ("q2", "p75"))],
        round_even("max", 2).alias("max"),
    )
