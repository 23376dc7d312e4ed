"""Gapless row numbers over a whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

#: Where the number of a task ends and that of its row begins in ``monotonically_increasing_id`` (Spark's documented layout).
ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], out: str, name: str = "numbered") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... along ``order``.

    Rows are cut by range and sorted inside each range; the rows of the ranges before are added up over one row per
    range, whose number is that of the shuffle partitions. Rows equal in ``order`` are numbered one after another and may be
    cut between ranges, so no tie meets in one task; ``df`` should be a written table or as repeatable as one.
    """
    marked = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie")]
    cut = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    table = written(cut.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", ROW_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = table.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(out, F.col("__before") + F.col("__at") - F.shiftleft(F.col("__part"), ROW_BITS)).drop(
        "__part", "__before", "__at")
