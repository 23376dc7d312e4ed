"""Plans that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .quantiles import beside

# A key is hot when it holds more rows than both of these allow. At most
# 1 / HOT_SHARE keys can exceed the share, so a list of hot keys has a proven
# bound and may be broadcast however large the table is.
HOT_SHARE = 1e-4
HOT_FLOOR = 1_000_000
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """Keys with more than max(floor, share of all rows) rows; at most 1/share of them.

    Only the key column is read, and counting combines on the map side.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    limit = F.greatest(F.lit(float(floor)), F.col("__all") * F.lit(share))
    totals = counts.agg(F.sum("__rows").alias("__all"))
    return beside(counts, totals).where(F.col(key).isNotNull() & (F.col("__rows") > limit)).select(key)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Join rows to a table with one row per key, spreading the left side's hot keys.

    Rows of a hot key go to ``SALTS`` partitions and the one right-hand row of that
    key is copied to each. Null keys meet nothing and are spread the same way. No
    side is broadcast by hint: the planner may do so when it has seen the size.
    """
    hot = F.broadcast(hot_keys(left, key, share, floor).withColumn("__hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c != key] or [F.lit(0)]), F.lit(SALTS))
    salted = (
        left.join(hot, key, "left")
        .withColumn("__salt", F.when(F.col("__hot") | F.col(key).isNull(), spread).otherwise(F.lit(0)).cast("bigint"))
        .drop("__hot")
    )
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = copies.cast("array<bigint>")
    replicated = (
        right.join(hot, key, "left")
        .withColumn("__salt", F.explode(copies))
        .drop("__hot")
    )
    return salted.join(replicated, [key, "__salt"], how).drop("__salt")


def lookback(
    df: DataFrame,
    group: str | None,
    order: Sequence[str],
    rows: int,
    outputs: Callable[[WindowSpec], dict[str, Column]],
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Window outputs that look at most ``rows`` rows back within a group.

    Ordinary groups are one window each. The rows of hot groups (or the whole table
    when there is no group) are cut by range into blocks along the order, so a
    group spans many tasks. Inside a block the windows are complete except for its
    first ``rows`` rows; these are worked out again among the block edges only,
    where the last ``rows`` rows of the block before stand right in front of them.
    """
    if group is None:
        whole = df.withColumn("__all", F.lit(0))
        return _in_blocks(whole, "__all", order, rows, outputs).drop("__all")

    hot = F.broadcast(hot_keys(df, group, share, floor))
    plain = Window.partitionBy(group).orderBy(*order)
    rest = df.join(hot, group, "left_anti").withColumns(outputs(plain))
    return rest.unionByName(_in_blocks(df.join(hot, group, "left_semi"), group, order, rows, outputs))


def _in_blocks(df, group, order, rows, outputs) -> DataFrame:
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(df.columns)
    cut = df.repartitionByRange(blocks, group, *order).withColumn("__block", F.spark_partition_id())

    inside = Window.partitionBy(group, "__block").orderBy(*order)
    first = {f"__in_{name}": c for name, c in outputs(inside).items()}
    marks = {
        "__head": F.lag(F.lit(1), rows).over(inside).isNull(),
        "__tail": F.lead(F.lit(1), rows).over(inside).isNull(),
    }
    marked = cut.withColumns({**first, **marks})

    zone = F.when(F.col("__head") | F.col("__tail"), F.lit(-1)).otherwise(F.col("__block"))
    edges = Window.partitionBy(group, "__zone").orderBy(*order)
    second = outputs(edges)
    zoned = marked.withColumn("__zone", zone).withColumns({f"__at_{n}": c for n, c in second.items()})
    picked = [
        F.when(F.col("__head"), F.col(f"__at_{n}")).otherwise(F.col(f"__in_{n}")).alias(n) for n in second
    ]
    return zoned.select(*names, *picked)
