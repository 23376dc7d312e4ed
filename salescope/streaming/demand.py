"""Daily demand and duplicate removal on streams; both also run on batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(events: DataFrame, time: str, value: str, *keys: str, late: str = "2 days") -> DataFrame:
    """Sum and count per calendar day and key, by event time.

    On a stream, days older than the latest event minus ``late`` are closed and rows
    for them dropped; on a batch table the watermark has no effect.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    source = stamped.withWatermark(time, late) if events.isStreaming else stamped
    day = F.window(time, "1 day").alias("w")
    return source.groupBy(day, *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows")).select(
        F.to_date(F.col("w.start")).alias("day"), *keys, "total", "rows")


def drop_repeats(events: DataFrame, time: str, *keys: str, late: str = "2 days") -> DataFrame:
    """Each key once. The stream keeps a key only as long as its watermark allows."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        return stamped.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return stamped.dropDuplicates(list(keys))
