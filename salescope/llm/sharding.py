"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay together, bytes are near equal."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import order_hash, packed, running_total
from salescope.plans.session import ship_package, written

#: Groups, or partial partitions, that one task combines.
BATCH = 4_096


def difference(sums: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combines partial partitions into one: (its sums, for each partial partition the shard of each of its parts).

    The two with the largest spread are combined, the largest part of one with the smallest of the other, until one
    is left. Which parts went together is kept as a binary tree and read off from its root.
    """
    shards = len(sums[0])
    heap = [(min(s) - max(s), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    held = {i: list(s) for i, s in enumerate(sums)}
    made: list[tuple[int, int, list[int], list[int]]] = []
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        a, b = held.pop(i), held.pop(j)
        down = sorted(range(shards), key=lambda k: -a[k])
        up = sorted(range(shards), key=lambda k: b[k])
        total = [a[x] + b[y] for x, y in zip(down, up)]
        new = len(sums) + len(made)
        made.append((i, j, down, up))
        held[new] = total
        heapq.heappush(heap, (min(total) - max(total), new))
    root = heap[0][1]
    to: dict[int, list[int]] = {root: list(range(shards))}
    for n in range(root, len(sums) - 1, -1):
        i, j, down, up = made[n - len(sums)]
        own = to.pop(n)
        first, second = [0] * shards, [0] * shards
        for k in range(shards):
            first[down[k]] = own[k]
            second[up[k]] = own[k]
        to[i], to[j] = first, second
    return held[root], [to[i] for i in range(len(sums))]


def _combine(shards: int):
    def combine(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("node").reset_index(drop=True)
        total, to = difference([[int(x) for x in s] for s in batch["sums"]])
        return pd.DataFrame({
            "node": batch["node"], "parent": key[0], "to": [np.array(t, np.int32) for t in to],
            "sums": [np.array(total, np.int64) if i == 0 else None for i in range(len(batch))],
        })

    return combine


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """(node, shard) for ``groups`` of (node, bytes); node is a string that tells groups apart.

    Groups are dealt into batches by their digest, of about BATCH each; one task combines a batch into one
    partial partition, whose parts are numbered. Partial partitions are batched again until one is left, so the
    levels grow as the logarithm of the groups. Walking back down, each level joins the shard of every part.
    """
    ship_package(groups.sparkSession)
    level = groups.select("node", F.array(
        F.col("bytes").cast("long"), *[F.lit(0).cast("long")] * (shards - 1)).alias("sums"))
    n, levels = groups.count(), []
    while n > 1 or not levels:
        batches = max(1, -(-n // BATCH))
        name = f"L{len(levels)}-"
        dealt = level.withColumn("batch", F.concat(F.lit(name), F.pmod(F.xxhash64("node"), F.lit(batches)).cast("string")))
        done = written(dealt.groupBy("batch").applyInPandas(
            _combine(shards), "node string, parent string, to array<int>, sums array<long>"), "shard-level")
        levels.append(done.select("node", "parent", "to"))
        level = done.filter("sums is not null").select(F.col("parent").alias("node"), "sums")
        n = batches if batches > 1 else 0
    place = levels[-1].select("node", "to")
    for lower in reversed(levels[:-1]):
        above = place.select(F.col("node").alias("parent"), F.col("to").alias("onto"))
        place = lower.join(above, "parent").select(
            "node", F.transform("to", lambda k: F.element_at("onto", k + 1)).alias("to"))
    return place.select("node", F.element_at("to", 1).alias("shard"))


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Puts documents into ``shards`` of near equal bytes: (row, size, text_crc32, shard, slot).

    ``row`` is the document with all its columns, ``size`` the bytes of its text plus 1, ``slot`` its place in the
    shard, without gaps from 0, in an order fixed by ids. Documents of equal text are one group and share a shard.
    Null texts are a group apart from empty ones; their size is 1 and their checksum that of no bytes. Null ids come
    first; equal rows get slots one after another. No documents: no rows.
    """
    docs = packed(documents)
    text = F.col("row.text")
    docs = docs.select(
        "row", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("node"), order_hash(F.col("row.doc_id")).alias("by"),
    )
    groups = written(docs.groupBy("node").agg(F.sum("size").alias("bytes")), "shard-groups")
    if groups.isEmpty():
        placed = docs.withColumn("shard", F.lit(0))
    else:
        placed = docs.join(assign(groups, shards), "node")
    ties = [F.col("row.doc_id").asc_nulls_first(), F.col("node"), F.col("size")]
    slots = running_total(placed.withColumn("one", F.lit(1)), "shard", "by", ties, "one", "slot")
    return slots.select("row", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                        F.col("slot").cast("long").alias("slot"))
