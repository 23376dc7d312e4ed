"""Near-duplicates by bottom-k sketches from one hash function, inverted lists, and exact Jaccard similarity.

The order that decides which shingles a sketch retains is the hash, behind a coarse count of how common the shingle is:
common passages come last. A document retains the first quarter of its shingles and one more, as many as two
documents of similarity 0.75 need to share at least one retained value, whatever the order. So no link is missed by
chance, and inverted lists are short unless documents are alike in most of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import joined, mix64, packed, passes, word_hashes
from salescope.llm.components import connected_components
from salescope.plans.session import ship_package, written

WORDS = 5
#: Links need 100 * common >= PERCENT * all; the retained share of a document follows from it.
PERCENT = 75
#: Counters of how common shingles are, SLICE of them to a row: one size for any corpus.
COUNTERS, SLICE = 1 << 22, 1 << 16
#: Values of the sketch that estimates the similarity of a pair, and the estimate below which it is dropped.
SKETCH, LEAST_ESTIMATE = 32, 0.35
#: Bits of the parities that bound from below how many shingles two documents do not share.
PARITIES = 1024
#: Members of a list that one task compares; longer lists are cut into blocks.
BLOCK = 4_096
#: Rounds in which every member of a list that is still apart is compared with one other of it, drawn anew.
HUB_ROUNDS = 2


def shingles(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle of the documents of one pass, sorted by both."""
    data, starts = joined(held)
    h, at, _ = word_hashes(data)
    doc = np.searchsorted(starts, at, "right") - 1
    n = np.bincount(doc, minlength=len(held))
    first = np.cumsum(n) - n
    size = np.minimum(n, WORDS)[doc]  # of the shingle that begins here: all words, if they are fewer
    begins = np.arange(len(h)) - first[doc] + size <= n[doc]
    at = np.flatnonzero(begins)
    chain = mix64(size[at].astype(np.uint64))
    for k in range(WORDS):
        live = size[at] > k
        chain[live] = mix64(chain[live] * np.uint64(0x9E3779B97F4A7C15) ^ h[at[live] + k])
    order = np.lexsort((chain, doc[at]))
    doc, chain = doc[at][order], chain[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (chain[1:] != chain[:-1])
    return doc[new], chain[new]


def common_counts(texts: DataFrame) -> np.ndarray:
    """How common shingles are: a level, twice the binary logarithm of a count, for each of COUNTERS classes of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for _, held in passes(batch["text"].tolist()):
                place = (shingles(held)[1] % np.uint64(COUNTERS)).astype(np.int64)
                np.add.at(total, place, 1)
        parts = total.reshape(-1, SLICE)
        some = np.flatnonzero(parts.any(axis=1))
        wide = [1 if parts[i].max() < 256 else 4 for i in some]
        yield pd.DataFrame({"slice": some, "wide": wide, "sums": [parts[i].astype(f"<u{k}").tobytes() for i, k in zip(some, wide)]})

    def add(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for wide, sums in zip(batch["wide"], batch["sums"]):
            total += np.frombuffer(sums, f"<u{wide}")
        level = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pd.DataFrame({"slice": [key[0]], "levels": [level.tobytes()]})

    sums = texts.mapInPandas(count, "slice long, wide int, sums binary")
    levels = np.zeros((COUNTERS // SLICE, SLICE), np.uint8)
    for row in sums.groupBy("slice").applyInPandas(add, "slice long, levels binary").toLocalIterator():
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(-1)


def _set_hashes(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's set; ``n`` has the sizes of the sets, which lie one after another in ``h``."""
    low, out = np.cumsum(n) - n, []
    for seed in (np.uint64(0), np.uint64(0x9E3779B97F4A7C15)):
        sums = np.add.reduceat(np.append(mix64(h + seed), np.uint64(0)), low) if len(n) else np.zeros(0, np.uint64)
        out.append(mix64(np.where(n > 0, sums, np.uint64(0))).astype(np.int64))
    return out[0], out[1]


def _set_hash(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, size) of the shingle set of each text."""
    nodes, sizes = [], []
    for _, held in passes(texts):
        doc, h = shingles(held)
        n = np.bincount(doc, minlength=len(held))
        nodes.append(_set_hashes(h, n)[0])
        sizes.append(n)
    if not nodes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(nodes), np.concatenate(sizes)


def set_of(text: Column) -> Column:
    """(node, n) of a text: the hash of its shingle set and the number of its shingles."""

    @F.pandas_udf("node long, n long")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        nodes, sizes = _set_hash(texts.tolist())
        return pd.DataFrame({"node": nodes, "n": sizes})

    return hashed(text)


def _sketched(levels):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, held in passes(batch["text"].tolist()):
                doc, h = shingles(held)
                n = np.bincount(doc, minlength=len(held))
                keep = n * (100 - PERCENT) // 100 + (n > 0)
                low = np.cumsum(n) - n
                level = levels.value[(h % np.uint64(COUNTERS)).astype(np.int64)]
                ranked = h[np.lexsort((mix64(h), level, doc))]
                spread = mix64(h ^ np.uint64(77))
                small = spread[np.lexsort((spread, doc))] >> np.uint64(32)
                s1, s2 = _set_hashes(h, n)
                bit = doc * PARITIES + (mix64(h + np.uint64(3)) % np.uint64(PARITIES)).astype(np.int64)
                odd = np.bincount(bit, minlength=len(held) * PARITIES).astype(np.uint8) & 1
                parity = np.packbits(odd.reshape(-1, PARITIES), axis=1)
                part = batch.iloc[first : first + len(held)]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "n": n, "node": s1, "check": s2,
                    "kept": [ranked[a : a + k].astype(np.int64) for a, k in zip(low, keep)],
                    "sketch": [small[a : a + min(k, SKETCH)].astype("<u4").tobytes() for a, k in zip(low, n)],
                    "parity": [row.tobytes() for row in parity],
                })

    return sketch


def estimate(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """Estimated similarity of each pair: the share of the smallest values of the union that both sketches hold."""
    out = np.zeros(len(one))
    for a in range(0, len(one), 8192):
        x, y = one[a : a + 8192], other[a : a + 8192]
        full = np.full((len(x), 2 * SKETCH), np.iinfo(np.uint64).max, np.uint64)
        for col, side in ((0, x), (SKETCH, y)):
            n = np.array([len(b) // 4 for b in side])
            flat = np.frombuffer(b"".join(side), "<u4")
            row = np.repeat(np.arange(len(side)), n)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            full[row, col + at] = flat
        size = np.maximum([len(b) // 4 for b in x], [len(b) // 4 for b in y])
        full.sort(axis=1)
        twice = np.zeros(full.shape, bool)
        twice[:, 1:] = (full[:, 1:] == full[:, :-1]) & (full[:, 1:] < np.iinfo(np.uint64).max)
        rank = np.cumsum(~twice, axis=1)
        # A sketch with fewer values holds its whole set; if both do, all of the union is known.
        most = np.where(size < SKETCH, 2 * SKETCH, SKETCH)
        union = np.minimum((~twice & (full < np.iinfo(np.uint64).max)).sum(axis=1), most)
        out[a : a + 8192] = (twice & (rank <= most[:, None])).sum(axis=1) / np.maximum(union, 1)
    return out


def _alike(own: set, other: set, percent: int = PERCENT) -> bool:
    common = len(own & other)
    return common > 0 and 100 * common >= percent * (len(own) + len(other) - common)


def within_parity(n: np.ndarray, m: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles may be alike: each shingle that one of them lacks turns one parity at most."""
    turned = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
    return (100 + PERCENT) * turned <= (100 - PERCENT) * (n + m)


def _bits(parities: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(parities), "<u8").reshape(len(parities), -1)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are alike; ``texts`` (doc_id, text) has those of the documents.

    Pairs whose parities or sketches tell them apart clearly are dropped first; the rest are compared on their texts.
    """
    side = ("n", "sketch", "parity")

    @F.pandas_udf("boolean")
    def near_by(
        n: pd.Series, one: pd.Series, bits: pd.Series, m: pd.Series, other: pd.Series, turned: pd.Series,
    ) -> pd.Series:
        fit = within_parity(n.to_numpy(), m.to_numpy(), _bits(bits), _bits(turned))
        at = np.flatnonzero(fit)
        fit[at] = estimate(one.iloc[at].tolist(), other.iloc[at].tolist()) >= LEAST_ESTIMATE
        return pd.Series(fit)

    @F.pandas_udf("boolean")
    def same_set(texts: pd.Series, nodes: pd.Series) -> pd.Series:
        return pd.Series(_set_hash(texts.tolist())[0] == nodes.to_numpy())

    near = pairs.join(nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in side]), "a")
    near = near.join(nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in side]), "b")
    near = near.filter(near_by(*[f"{c}_a" for c in side], *[f"{c}_b" for c in side]))
    near = written(near.select("a", "b"), "near-pairs")
    own = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    # Written, the ids have a known size: if they are few, Spark sends them to the texts instead of shuffling those.
    own = written(nodes.select("node", F.col("least_id").alias("doc_id")).join(own, "node"), "near-ids")
    # An id may stand on rows of other texts, too: only the text with the node's set counts.
    own = texts.join(own, "doc_id").filter(same_set("text", "node"))
    own = written(own.groupBy("node").agg(F.min("text").alias("text")), "near-texts")

    @F.pandas_udf("boolean")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        key, hub = None, set()
        for a, ta, tb in parts:
            out = []
            for k, x, y in zip(a, ta, tb):
                if k != key:
                    key, hub = k, set(shingles([x.encode("utf-8", "replace")])[1].tolist())
                out.append(_alike(set(shingles([y.encode("utf-8", "replace")])[1].tolist()), hub))
            yield pd.Series(out)

    full = near.join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    full = full.join(own.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return full.filter(alike("a", "ta", "tb")).select("a", "b")


def _cross_pairs(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs of different components within each list that may be alike; ``batch`` holds whole lists.

    Two alike documents differ in (100 - PERCENT) / (100 + PERCENT) of the sum of their sizes at most. What they retain
    before the first value they share differs, and each shingle that one of them lacks turns one parity at most: pairs
    that differ in more are left out. No alike pair is.
    """
    batch = batch.sort_values(["value", "pb", "node"], kind="stable")
    value, pb, own = batch["value"].to_numpy(), batch["pb"].to_numpy(), batch["own"].to_numpy()
    node, comp, n = batch["node"].to_numpy(), batch["component"].to_numpy(), batch["n"].to_numpy()
    s, at = batch["blocks"].to_numpy(), batch["at"].to_numpy()
    parity = _bits(batch["parity"])
    step, live = 1, np.arange(len(value))
    while True:
        live = live[live + step < len(value)]
        live = live[(value[live] == value[live + step]) & (pb[live] == pb[live + step])]
        if not len(live):
            return
        other = live + step
        most = (100 - PERCENT) * (n[live] + n[other])
        differ = np.maximum(at[live] + at[other], np.abs(n[live] - n[other]))
        fit = (comp[live] != comp[other]) & ((100 + PERCENT) * differ <= most)
        # In a list of several blocks, two members of one block meet where that block is paired with itself.
        lo, hi = np.minimum(own[live], own[other]), np.maximum(own[live], own[other])
        fit &= lo * s[live] + hi == pb[live]
        fit = np.flatnonzero(fit)
        one, two = live[fit], other[fit]
        fit = fit[within_parity(n[one], n[two], parity[one], parity[two])]
        if len(fit):
            yield pd.DataFrame({"a": np.minimum(node[live], node[other])[fit], "b": np.maximum(node[live], node[other])[fit]})
        step += 1


def _hub_pairs(members: DataFrame, step: int) -> DataFrame:
    """Pairs of each member with the one its list, or block of a list, draws in this round, if they may be alike."""
    drawn = F.xxhash64("node", "value", F.lit(step))
    hubs = members.groupBy("value", "own").agg(*[F.min_by(c, drawn).alias(f"hub_{c}") for c in ("node", "component", "n", "at")])
    met = members.join(hubs, ["value", "own"]).filter("component <> hub_component")
    differ = F.greatest(F.col("at") + F.col("hub_at"), F.abs(F.col("n") - F.col("hub_n")))
    met = met.filter((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n") + F.col("hub_n")))
    return met.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()


def document_sets(documents: DataFrame) -> DataFrame:
    """(node, component, component_id): the component of each shingle set that a document with an id has.

    Documents of equal sets are one node. In each inverted list the members are compared with its first one; what
    these links join is contracted. In lists that are still apart, they are then compared with a member that each list
    draws for itself: in a large group of near copies, whose members share many lists, each one meets as many others as
    it has lists, not all of them. All pairs that are apart after HUB_ROUNDS of that are compared, long lists in blocks.
    Every pair of similarity 0.75 shares a list, so components are those of all links.
    """
    spark = documents.sparkSession
    ship_package(spark)
    sent = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sent = sent.filter("doc_id is not null")
    levels = spark.sparkContext.broadcast(common_counts(sent.select("text")))
    rows = sent.mapInPandas(
        _sketched(levels), "doc_id long, n long, node long, check long, kept array<long>, sketch binary, parity binary")
    nodes = written(rows.groupBy("node", "check", "n").agg(
        F.min("doc_id").alias("least_id"), F.first("kept").alias("kept"), F.first("sketch").alias("sketch"),
        F.first("parity").alias("parity"),
    ), "near-nodes")

    # Lists of very common values are cut, so that no list meets in one task; the counters tell which may be long.
    @F.pandas_udf("int")
    def blocks_of(values: pd.Series) -> pd.Series:
        level = levels.value[(values.to_numpy().astype(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)]
        return pd.Series(np.ceil(2.0 ** ((level + 1) / 2) / BLOCK).astype(np.int32))

    values = nodes.filter("n > 0").select("node", "n", F.posexplode("kept").alias("at", "value"))
    values = values.withColumn("blocks", blocks_of("value")).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    within = Window.partitionBy("value", "own")
    lists = values.withColumn("hub", F.min("node").over(within)).withColumn("size", F.count(F.lit(1)).over(within))
    lists = written(lists.filter("size > 1 or blocks > 1").drop("size"), "near-lists")
    stars = lists.filter("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    heads = lists.filter("blocks > 1").select("value", "hub").distinct()
    first = heads.groupBy("value").agg(F.min("hub").alias("a"))
    stars = stars.union(heads.join(first, "value").filter("a < hub").select("a", F.col("hub").alias("b"))).distinct()
    links = written(verified(stars, nodes, sent), "near-links")
    open_lists = lists.drop("hub")
    for step in range(HUB_ROUNDS + 1):
        members = open_lists.join(connected_components(links), "node", "left")
        members = written(members.withColumn("component", F.coalesce("component", "node")), "near-members")
        apart = members.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        apart = members.join(apart.filter("lo < hi").select("value"), "value")
        open_lists = apart.drop("component")
        if step == HUB_ROUNDS:
            break
        more = written(verified(_hub_pairs(apart, step), nodes, sent), "near-links")
        if more.isEmpty():
            break
        links = links.union(more)

    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair_block = F.transform(other, lambda o: F.least("own", o) * F.col("blocks") + F.greatest("own", o))
    apart = apart.join(nodes.select("node", "parity"), "node").withColumn("pb", F.explode(pair_block))

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if whole := list(batches):
            yield from _cross_pairs(pd.concat(whole, ignore_index=True))

    pairs = apart.repartition("value", "pb").mapInPandas(cross, "a long, b long").distinct()
    component = connected_components(links.union(verified(pairs, nodes, sent)))
    own = nodes.select("node", "least_id").join(component, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return written(own.join(least, "component").select("node", "component_id"), "near-components")


def link_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Documents without words are linked with nothing and kept. A null id is no id: such a document is linked only with
    those of an equal set; it is dropped if one of them has an id, and else kept without a component. Rows with one id
    stand for themselves; equal rows are kept or dropped together. No documents: no rows.
    """
    found = document_sets(documents)
    docs = documents.select("doc_id", set_of(F.coalesce("text", F.lit(""))).alias("set"))
    docs = docs.select("doc_id", F.col("set.n").alias("n_shingles"), F.col("set.node").alias("node"))
    own = docs.join(found, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id").cast("long")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return own.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents that :func:`link_documents` keeps, with all their columns; of equal rows, one."""
    found = document_sets(documents)
    names = documents.columns
    docs = packed(documents).select("row", set_of(F.coalesce("row.text", F.lit(""))).alias("set"))
    docs = docs.select("row", F.col("set.n").alias("n"), F.col("set.node").alias("node")).join(found, "node", "left")
    own, kept = F.col("row.doc_id").cast("long"), F.col("component_id")
    docs = docs.filter((F.col("n") == 0) | F.coalesce(own == kept, kept.isNull()))
    return docs.select(*[F.col(f"row.`{c}`").alias(c) for c in names]).distinct()
