"""What the training-data operators share: reading, row packing, running totals, word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of a text, as all contracts of this subpackage define them.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one ordered block of a running total holds on average.
BLOCK_ROWS = 2_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, so that columns an operator adds cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


#: Bytes of rows that Spark hands to a Python worker at a time, so that long texts do not pile up on both sides.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session by bytes, unless it bounds them closer itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def order_hash(key: Column) -> Column:
    """A whole number below 2**52 from the digest of a key, the same in every SQL engine; null keys give one value."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def running_total(df: DataFrame, key: str, by: str, ties: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same key before this one.

    Rows are ordered by ``by``, an evenly spread number below 2**52, then by ``ties``. A key with many
    rows is cut along that order into blocks of about BLOCK_ROWS rows, so no key meets in one task: sums of
    blocks are added up first, then rows inside each block. Keys must not be null.
    """
    blocks = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_blocks"))
    cut = df.join(blocks, key).withColumn("_block", F.floor(F.col(by) / F.lit(float(2**52)) * F.col("_blocks")))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        cut.groupBy(key, "_block").agg(F.sum(value).alias("_sum"))
        .select(key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(key, "_block").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(sums, [key, "_block"])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_blocks", "_block", "_before")
    )


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MUL
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def byte_codes(data: bytes | bytearray) -> np.ndarray:
    """The eight bytes from each position on, as one number; ``data`` ends with eight spare bytes."""
    return np.ndarray((max(len(data) - 8, 0),), "<u8", data, strides=(1,))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)

#: Classes of bytes: 0 stands between words; a word is a run of one other class.
BY_SPACE = np.ones(256, np.uint8)
BY_SPACE[[0, 9, 10, 11, 12, 13, 32]] = 0
LETTERS = np.zeros(256, np.uint8)
LETTERS[128:] = 1
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
LETTERS_AND_SIGNS = np.where(BY_SPACE == 0, 0, np.where(LETTERS == 1, 1, 2)).astype(np.uint8)


def word_hashes(
    data: bytes, classes: np.ndarray = BY_SPACE, lower: bool = True,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a byte string, with A-Z lower-cased if asked for.

    A hash is built from eight bytes of the word at a time, so it costs a few array passes for the whole string.
    """
    raw = np.frombuffer(data, np.uint8)
    kind = np.zeros(len(raw) + 2, np.uint8)
    kind[1:-1] = classes[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    start, end = edge[:-1], edge[1:]
    real = kind[1:][start] > 0
    start, end = start[real], end[real]
    low = np.zeros(len(raw) + 16, np.uint8)
    low[: len(raw)] = _LOWER[raw] if lower else raw
    codes = byte_codes(low.tobytes())
    length = end - start
    h = mix64(length.astype(np.uint64) + _ODD)
    live, at = np.arange(len(start)), 0
    while len(live):
        left = length[live] - at
        piece = codes[start[live] + at] & _LOW_BYTES[np.minimum(left, 8)]
        h[live] = mix64(h[live] * _MUL ^ piece)
        at += 8
        live = live[left > 8]
    return h, start, end


def word_heads(data: bytes, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """A hash of the first ``most`` bytes, at most eight, of each word, A-Z lower-cased."""
    low = np.zeros(len(data) + 16, np.uint8)
    low[: len(data)] = _LOWER[np.frombuffer(data, np.uint8)]
    return mix64(byte_codes(low.tobytes())[start] & _LOW_BYTES[np.minimum(end - start, most)] ^ _ODD)


#: Bytes of text that one array pass takes together; a longer document is a pass of its own.
PASS_BYTES = 1 << 19


def passes(texts: list[str | None]):
    """Yields (number of the first document, bytes of each document) for runs of documents; null counts as empty."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > PASS_BYTES:
            yield first, held
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def joined(held: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Documents divided by a zero byte, and the place of each start, with the end of all as the last."""
    starts = np.concatenate([[0], np.cumsum([len(b) + 1 for b in held])]).astype(np.int64)
    return b"\0".join(held) + b"\0", starts
