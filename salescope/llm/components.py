"""Connected components by star contraction, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.plans.session import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node it is linked with.

    Large and small stars alternate: each node hangs its larger, then its smaller neighbours onto the smallest one, until
    nothing moves. Every round is two aggregates with joins whose hot nodes Spark can split, written to the shared
    folder; the number of rounds grows as the logarithm of the longest chain.
    """
    both = F.least("a", "b"), F.greatest("a", "b")
    edges = written(links.select(both[0].alias("a"), both[1].alias("b")).filter("a < b").distinct(), "links")
    before = None
    while not edges.isEmpty():
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select("m", "b").filter("m < b").distinct()
        large = large.select(F.col("m").alias("a"), "b")
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(F.col("m").alias("a"), F.col("a").alias("x"), F.col("b"))
        hung = small.select("a", "b").union(small.select("a", F.col("x").alias("b"))).filter("a < b").distinct()
        edges = written(hung, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
