"""Suffix-array deduplication: bytes that an earlier document has in a string of THRESHOLD bytes are removed.

Prefix doubling over a sampled suffix array. Every string of THRESHOLD bytes holds an anchor, its string of FIRST bytes
with the smallest hash, so equal strings have equal anchors at equal places. Anchors are the positions of the first
round: Spark ranks them by bucket, and those of one document only are dropped. What is left is dealt by anchor and doubled
to 8, 16, 32 and THRESHOLD bytes: sorted pairs of ranks at a growing offset give the next ranks, and equal last ranks
are equal strings. Runs of strings that agree whole, as copies do, are settled by a hash before that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import PASS_BYTES, byte_codes, mix64
from salescope.plans.session import ship_package, written

THRESHOLD = 50
FIRST = 24

#: Bytes of text that one block of documents and one bucket of anchors stand for, on average.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 1 << 24

#: An anchor in so many blocks is followed by its single strings instead of by itself, so none meets in one task.
HOT_BLOCKS = 1_000


def _pieces(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document, offset in the document, place of each string start) for passes over documents.

    A long document is cut into overlapping pieces, each string begins in one of them.
    """
    def made(held: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(raw) for _, _, raw in held])
        begin = np.cumsum(size) - size
        n = np.maximum(size - THRESHOLD + 1, 0)
        which = np.repeat(np.arange(len(held)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.array([d for d, _, _ in held])[which]
        shift = np.array([o for _, o, _ in held])[which]
        return b"".join(raw for _, _, raw in held) + bytes(THRESHOLD + 8), doc, shift + inside, begin[which] + inside

    held: list[tuple[int, int, bytes]] = []
    size = 0
    for doc, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        for a in range(0, max(len(raw) - THRESHOLD + 1, 0), PASS_BYTES):
            part = raw[a : a + PASS_BYTES + THRESHOLD - 1]
            if held and size + len(part) > PASS_BYTES:
                yield made(held)
                held, size = [], 0
            held.append((doc, a, part))
            size += len(part)
    if held:
        yield made(held)


def runs(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, anchor, document, offset, place, strings) of each run of neighbouring strings with one anchor."""
    for data, doc, offset, place in _pieces(texts):
        codes = byte_codes(data)
        h = mix64(codes)
        for a in range(8, FIRST, 8):
            h[: len(h) - a] = h[: len(h) - a] * np.uint64(0x9E3779B97F4A7C15) ^ codes[a:]
            h = mix64(h)
        wide, span = THRESHOLD - FIRST + 1, 1
        while 2 * span <= wide:
            h[: len(h) - span] = np.minimum(h[: len(h) - span], h[span:])
            span *= 2
        if span < wide:
            h[: len(h) - wide + span] = np.minimum(h[: len(h) - wide + span], h[wide - span :])
        anchor = h[place]
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(new)
        yield data, anchor[at], doc[at], offset[at], place[at], np.diff(np.append(at, len(place)))


def _short(anchors: np.ndarray) -> np.ndarray:
    """What tells anchors of one bucket apart: their upper 32 bits. A chance tie only lets an anchor pass that is dropped later."""
    return anchors >> np.uint64(32)


def _packed(shorts: np.ndarray) -> bytes:
    return shorts.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.uint64)


def _block_anchors(buckets: int):
    def anchors(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        """The block's anchors by bucket: those of one document, and those of several."""
        ids = pd.factorize(batch["doc_id"])[0]
        pairs = []
        for _, anchor, doc, *_ in runs(_texts(batch)):
            pairs.append(np.unique(np.stack([anchor, ids[doc].astype(np.uint64)]), axis=1))
        if not pairs:
            return pd.DataFrame({"bucket": [], "block": [], "one": [], "more": []})
        anchor = np.unique(np.concatenate(pairs, axis=1), axis=1)[0]
        anchor, n = np.unique(anchor, return_counts=True)
        bucket = anchor % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        anchor, n, bucket = anchor[order], n[order], bucket[order]
        some, at = np.unique(bucket, return_index=True)
        rows = []
        for b, x, y in zip(some, at, [*at[1:], len(bucket)]):
            part, several = anchor[x:y], n[x:y] > 1
            rows.append((int(b), key[0], _packed(_short(part[~several])), _packed(_short(part[several]))))
        return pd.DataFrame(rows, columns=["bucket", "block", "one", "more"])

    return anchors


def _repeated_anchors(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
    """For each block, its anchors in the bucket that several documents have, and which of them are hot."""
    sides = [_unpacked(side) for pair in zip(batch["one"], batch["more"]) for side in pair]
    sizes = np.array([len(x) for x in sides])
    several = np.repeat(np.arange(len(sides)) % 2 == 1, sizes)
    anchor, where, n = np.unique(np.concatenate(sides), return_inverse=True, return_counts=True)
    live = (n > 1) | (np.bincount(where, several, len(anchor)) > 0)
    hot = n >= HOT_BLOCKS
    rows, end = [], np.cumsum(sizes)
    for i, block in enumerate(batch["block"]):
        own = where[end[2 * i] - sizes[2 * i] : end[2 * i + 1]]
        own = own[live[own]]
        if len(own):
            rows.append((block, _packed(anchor[own[~hot[own]]]), _packed(anchor[own[hot[own]]])))
    return pd.DataFrame(rows, columns=["block", "live", "hot"])


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2**64, kept by the worker."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * PASS_BYTES), base, np.uint64)]))
    return _powers[base][:n]


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Hashes:
    """Hashes of any stretches of a byte string, from running sums over its spread eight-byte codes."""

    def __init__(self, data: bytes) -> None:
        codes = mix64(byte_codes(data))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * _power(BASE, len(codes)))])
        self.back = _power(INVERSE, len(codes) + 1)

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix64((self.sums[start + length - 7] - self.sums[start]) * self.back[start] ^ length.astype(np.uint64))


FOLLOWED = "key long, content long, doc_id long, block long, text_hash int, start int, strings int, settled boolean"


def _texts(batch: pd.DataFrame) -> list[str]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z).decode() for z in batch["z"]]


def _followed(key: tuple, batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The runs of a block with repeated anchors, with a hash of their content; of hot anchors, the single strings.

    Runs whose content an earlier document of the block has, too, are settled here.
    """
    names = [c.split()[0] for c in FOLLOWED.split(", ")]
    if not len(batch) or not len(found):
        return pd.DataFrame({c: [] for c in names})
    live = np.unique(np.concatenate([_unpacked(b) for b in found["live"]]))
    hot = np.unique(np.concatenate([_unpacked(b) for b in found["hot"]]))
    ids, hashes = batch["doc_id"].to_numpy(), batch["text_hash"].to_numpy()
    parts = []
    for data, anchor, doc, offset, place, n in runs(_texts(batch)):
        known = Hashes(data)
        short = _short(anchor)
        i = np.flatnonzero(np.isin(short, live))
        parts.append((anchor[i], known.of(place[i], n[i] + THRESHOLD - 1), doc[i], offset[i], n[i]))
        i = np.flatnonzero(np.isin(short, hot))
        if len(i):
            i, j = np.repeat(i, n[i]), np.arange(n[i].sum()) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
            single = known.of(place[i] + j, np.full(len(i), THRESHOLD))
            parts.append((mix64(single + np.uint64(BASE)), single, doc[i], offset[i] + j, np.ones(len(i), np.int64)))
    anchor, content, doc, offset, n = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 5
    own = ids[doc.astype(np.int64)]
    order = np.lexsort((own, content, anchor))
    anchor, content, doc, offset, n, own = (c[order] for c in (anchor, content, doc.astype(np.int64), offset, n, own))
    new = np.ones(len(own), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    first = own[np.flatnonzero(new)][np.cumsum(new) - 1]
    return pd.DataFrame({
        "key": anchor.astype(np.int64), "content": np.where(own > first, 0, content.astype(np.int64)), "doc_id": own,
        "block": key[0], "text_hash": hashes[doc], "start": offset.astype(np.int32), "strings": n.astype(np.int32),
        "settled": own > first})


SETTLED = "removed boolean, key long, doc_id long, block long, text_hash int, start int, strings int"


def _compared(batch: pd.DataFrame) -> pd.DataFrame:
    """Runs removed whole, as an earlier document has the same content, and first runs of anchors with several contents."""
    names = [c.split()[0] for c in SETTLED.split(", ")]
    done, rest = batch[batch["settled"]], batch[~batch["settled"]]
    rest = rest.sort_values(["key", "content", "doc_id"])
    key, content, ids = rest["key"].to_numpy(), rest["content"].to_numpy(), rest["doc_id"].to_numpy()
    begins = np.ones(len(rest), bool)
    begins[1:] = key[1:] != key[:-1]
    new = begins.copy()
    new[1:] |= content[1:] != content[:-1]
    first = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    group = np.cumsum(begins) - 1
    several = np.bincount(group, new, int(begins.sum()))[group] > 1 if len(rest) else np.zeros(0, bool)
    later = ids > first
    return pd.concat([done.assign(removed=True), rest[later].assign(removed=True), rest[~later & several].assign(removed=False)])[names]


CONTENTS = "key long, doc_id long, text_hash int, start int, strings int, content binary"


def _contents(key: tuple, batch: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The bytes of the wanted runs of a block."""
    names = ["key", "doc_id", "text_hash", "start", "strings"]
    if not len(batch) or not len(wanted):
        return pd.DataFrame({c: [] for c in [*names, "content"]})
    held = {(i, h): k for k, (i, h) in enumerate(zip(batch["doc_id"], batch["text_hash"]))}
    raw = [zstandard.ZstdDecompressor().decompress(z) for z in batch["z"]]
    return wanted[names].assign(content=[
        raw[held[i, h]][a : a + n + THRESHOLD - 1]
        for i, h, a, n in zip(wanted["doc_id"], wanted["text_hash"], wanted["start"], wanted["strings"])])


def double(contents: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, smallest owner of the string) for the strings of THRESHOLD bytes in all contents.

    Ranks of 8 bytes are their sorted values; a round sorts the pairs of ranks at an offset and numbers them anew, at
    twice the length. Positions without a partner, whose string would pass the end, fall out.
    """
    size = np.array([len(c) for c in contents])
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(size)), size)
    inside = np.arange(size.sum()) - np.repeat(begin, size)
    rank = np.unique(byte_codes(b"".join(contents) + bytes(8)), return_inverse=True)[1].astype(np.int64)
    length = 8
    for wanted in (16, 32, THRESHOLD):
        off = wanted - length
        pair = rank[: len(rank) - off] * (rank.max(initial=0) + 1) + rank[off:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length = wanted
    fits = np.flatnonzero((inside + THRESHOLD <= size[which])[: len(rank)])
    rank, which, inside = rank[fits], which[fits], inside[fits]
    least = np.full(rank.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, owner[which])
    return which, inside, least[rank]


def _doubled(batch: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, text_hash, start, length) of removed stretches; ``batch`` holds all runs of each of its anchors."""
    kind, contents = pd.factorize(batch["content"])
    ids = batch["doc_id"].to_numpy()
    owner = np.full(len(contents), np.iinfo(np.int64).max)
    np.minimum.at(owner, kind, ids)
    which, inside, least = double(list(contents), owner)
    gone = least < owner[which]
    lost = pd.DataFrame({"kind": which[gone], "inside": inside[gone]}).sort_values(["kind", "inside"])
    # Neighbouring strings make one stretch.
    new = (lost["kind"].diff() != 0) | (lost["inside"].diff() != 1)
    lost = lost.groupby(new.cumsum()).agg(kind=("kind", "first"), inside=("inside", "first"), n=("inside", "size"))
    own = batch.assign(kind=kind).merge(lost, on="kind")
    return pd.DataFrame({
        "doc_id": own["doc_id"], "text_hash": own["text_hash"], "start": own["start"] + own["inside"],
        "length": own["n"] + THRESHOLD - 1})


def by_whole_keys(step):
    """Applies ``step`` to batches sorted by key; the last key of a batch waits for the next one."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows < 50_000 or batch["key"].iloc[0] == batch["key"].iloc[-1]:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole["key"] == whole["key"].iloc[-1]
            yield step(whole[~last].reset_index(drop=True))
            held, rows = [whole[last]], int(last.sum())
        if held:
            yield step(pd.concat(held, ignore_index=True))

    return apply


def compressed(text: Column) -> Column:
    """A text as compressed bytes of UTF-8: it goes through shuffles that way. Null is empty."""

    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=5).compress
        return pd.Series([press((t or "").encode("utf-8", "replace")) for t in texts], dtype=object)

    return squeeze(text)


def once_each(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text) without repeats of both.

    Only rows whose id stands on several rows are compared by text; which ids these are is read from the ids alone.
    """
    again = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    again = written(again, "repeated-ids")
    if again.isEmpty():
        return documents
    several = documents.join(again, "doc_id", "left_semi").withColumn("whole", F.xxhash64(F.coalesce("text", F.lit(""))))
    several = several.groupBy("doc_id", "whole").agg(F.first("text").alias("text")).drop("whole")
    return documents.join(again, "doc_id", "left_anti").unionByName(several)


def repeated_stretches(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length): stretches of bytes whose strings also start in a document with a smaller id."""
    ship_package(documents.sparkSession)
    sent = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = once_each(sent)
    total = sent.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = 1 + total // BLOCK_BYTES, 1 + total // BUCKET_BYTES
    sent = sent.select(
        "doc_id", F.hash(F.coalesce("text", F.lit(""))).alias("text_hash"), compressed(F.col("text")).alias("z"))
    dealt = sent.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks))).repartition("block")
    by_block = dealt.groupBy("block")
    anchors = by_block.applyInPandas(_block_anchors(buckets), "bucket long, block long, one binary, more binary")
    repeated = anchors.groupBy("bucket").applyInPandas(_repeated_anchors, "block long, live binary, hot binary")
    followed = by_block.cogroup(repeated.groupBy("block")).applyInPandas(_followed, FOLLOWED)
    sorted_runs = followed.repartition("key").sortWithinPartitions("key")
    compared = sorted_runs.mapInPandas(by_whole_keys(_compared), SETTLED)
    whole = compared.filter("removed").select(
        "doc_id", "text_hash", "start", (F.col("strings") + (THRESHOLD - 1)).alias("length"))
    wanted = compared.filter("not removed").groupBy("block")
    contents = by_block.cogroup(wanted).applyInPandas(_contents, CONTENTS)
    doubled = contents.repartition("key").sortWithinPartitions("key").mapInPandas(
        by_whole_keys(_doubled), "doc_id long, text_hash int, start int, length int")
    return whole.unionByName(doubled)


def remove(raw: bytes, starts: list[int] | None, lengths: list[int] | None) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, maximal removed runs)."""
    if starts is None or not len(starts):
        return raw, 0, 0
    kept, at, spans, end = [], 0, 0, -1
    for a, n in sorted(zip(starts, lengths)):
        if a > end:
            kept.append(raw[at:a])
            spans += 1
        end = max(end, a + n)
        at = end
    kept.append(raw[at:])
    left = b"".join(kept)
    return left, len(raw) - len(left), spans


def deduplicate(documents: DataFrame) -> DataFrame:
    """(row, text, n_bytes, n_removed, n_spans, kept_sha256) for every document, ``row`` with its other columns.

    ``text`` is what stays, null if it was null; where a removed stretch cuts a character in two, its odd bytes go, too, while counts and the
    digest are those of the bytes. Strings are judged on the input. Null text is empty. A null id is neither smaller nor
    larger than others: nothing is removed from such a document, and it removes nothing. Rows with one id remove nothing
    from each other. No documents: no rows.
    """
    stretches = repeated_stretches(documents).groupBy("doc_id", "text_hash").agg(
        F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
    row = F.struct(F.lit(None).cast("boolean").alias("_"), *[F.col(f"`{c}`") for c in documents.columns if c != "text"])
    docs = documents.select(
        row.alias("row"), F.col("text").isNull().alias("is_null"), F.col("doc_id").cast("long").alias("doc_id"),
        F.hash(F.coalesce("text", F.lit(""))).alias("text_hash"), compressed(F.col("text")).alias("z"))

    @F.pandas_udf("text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def cut(pressed: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        rows, expand = [], zstandard.ZstdDecompressor().decompress
        for z, a, n in zip(pressed, starts, lengths):
            left, gone, spans = remove(expand(z), a, n)
            rows.append((left.decode("utf-8", "ignore"), len(left) + gone, gone, spans, hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(rows, columns=["text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = docs.join(stretches, ["doc_id", "text_hash"], "left")
    done = joined.select("row", "is_null", cut("z", "starts", "lengths").alias("cut"))
    text = F.when(~F.col("is_null"), F.col("cut.text"))
    return done.select("row", text.alias("text"), *[f"cut.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
