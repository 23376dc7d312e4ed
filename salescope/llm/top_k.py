"""Exact top-k search by whole-number inner product, a block of vectors at a time, pruned by bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.plans.session import ship_package, written

#: Vectors of one block, blocks of one shelf (what a task reads at a time), and queries of one chunk.
BLOCK, SHELF, CHUNK = 512, 32, 512

K = 5


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def quantized(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest score each block can hold for each query: the summed maxima of its terms."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: the highest score first, then the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search(
    own: np.ndarray, queries: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int,
) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best of each query in ``blocks`` of (ids, vectors).

    ``floor`` holds scores that k vectors are known to reach. Each query visits blocks in the order of their bounds, and
    stops at the first whose bound is below its k-th score so far; queries at the same block are scored together.
    """
    low = np.stack([m.min(axis=0) for _, m in blocks])
    high = np.stack([m.max(axis=0) for _, m in blocks])
    bound = bounds(queries, low, high)
    order = np.argsort(-bound, axis=1, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
    kth, active = floor.astype(float).copy(), np.arange(len(own))
    for step in range(len(blocks)):
        at = order[active, step]
        keep = bound[active, at] >= kth[active]
        active, at = active[keep], at[keep]
        for b in np.unique(at):
            some = active[at == b]
            ids, vectors = blocks[b]
            scores = vectors @ queries[some].T
            for q, column in zip(some, scores.T):
                good = np.flatnonzero((column >= kth[q]) & (ids != own[q]))
                if len(good):
                    i, s = np.append(found[q][0], ids[good]), np.append(found[q][1], column[good])
                    top = best(s, i, k)
                    found[q] = i[top], s[top]
                    if len(top) == k:
                        kth[q] = max(kth[q], s[top[-1]])
    return [(int(own[q]), int(i), int(s)) for q in range(len(own)) for i, s in zip(*found[q])]


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist())
    # Products of larger numbers are not exact in floating point: Python's own whole numbers are.
    exact = m.shape[1] * float(np.abs(m).max(initial=0)) ** 2 < 2**53
    return m.astype(float) if exact else m.astype(object)


def _shelves(k: int, every: int):
    def shelve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One partition, a range of ids: its blocks, and its queries with a score that k others reach."""
        whole = list(batches)
        if not whole:
            return
        part = pd.concat(whole).sort_values("vec_id", kind="stable")
        for _, same in part.groupby("dim"):
            for a in range(0, len(same), BLOCK):
                block = same.iloc[a : a + BLOCK]
                ids, m = block["vec_id"].to_numpy(), _matrix(block["v"])
                asks = np.flatnonzero(ids % every == 0)
                floor = np.full(len(block), -np.inf)
                for q in asks:
                    others = np.delete(m @ m[q], q)
                    if len(others) >= k:
                        floor[q] = np.partition(others.astype(float), len(others) - k)[len(others) - k]
                yield pd.DataFrame({
                    "shelf": block["shelf"], "dim": block["dim"], "block": a // BLOCK, "vec_id": ids, "v": block["v"],
                    "floor": floor,
                })

    return shelve


def top_k(vectors: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest whole-number inner product for each query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates all rows with another id; ties go to
    the smaller id. Vectors that are null, empty, or hold null or non-finite components, or have no id, take no part;
    vectors of different lengths are not compared. Of rows with one id, the one with the smallest vector counts.
    Ids are cut by range into shelves of blocks. Every chunk of queries meets every shelf in a task of its own, and a
    last window keeps the k best of what the shelves return. Fewer candidates: fewer rows. No vectors: no rows.
    """
    ship_package(vectors.sparkSession)
    e = F.col("embedding")
    kept = vectors.filter(F.col("vec_id").isNotNull() & usable(e))
    kept = kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(quantized(e)).alias("v"))
    kept = written(kept.withColumn("dim", F.size("v")), "top-vectors")
    shelves = 1 + kept.count() // (BLOCK * SHELF)
    ranged = kept.repartitionByRange(shelves, "vec_id").withColumn("shelf", F.spark_partition_id())
    table = written(ranged.mapInPandas(
        _shelves(k, every), "shelf int, dim int, block int, vec_id long, v array<long>, floor double"), "top-shelves")
    asks = table.filter(F.col("vec_id") % every == 0)
    chunks = 1 + asks.count() // CHUNK
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    asks = asks.select(chunk.alias("chunk"), "dim", "vec_id", "v", "floor",
                       F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"))
    copies = table.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            left = left.sort_values(["block", "vec_id"])
            blocks = [(b["vec_id"].to_numpy(), _matrix(b["v"])) for _, b in left.groupby("block")]
            rows = search(right["vec_id"].to_numpy(), _matrix(right["v"]), right["floor"].to_numpy(), blocks, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ("shelf", "chunk", "dim")
    met = copies.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: floor(256 * x::double))) as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) group by vec_id),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5
"""
