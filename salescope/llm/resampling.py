"""Documents drawn by importance: those whose words look most like a target text collection.

Texts are taken in batches: joined with a separator that no word holds, one pattern pass finds the words of all of them,
the place of each word among the ends of the documents tells whose it is, and runs that would cross from one document to
the next are masked before they are counted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import packed, passes
from salescope.plans.numbering import numbered
from salescope.plans.session import ship_package, written

BUCKETS = 10_000

#: Words that one feature holds at most.
RUN = 3

#: Documents with fewer words are never drawn; PERCENT of the others are.
LEAST_WORDS = 20
PERCENT = 5

#: Ends each text of a batch. It divides words, so one inside a text may give way to a space.
SENTINEL = b"\0"

#: Words (bytes of digits, letters and all other characters than ASCII; A-Z are lower-cased before) and the ends of texts.
TOKENS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")


def _step(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _crc_steps() -> tuple[np.ndarray, np.ndarray]:
    """What zero bytes after a text make of its checksum, as tables by byte of the checksum: for 0 to 63 zero bytes, and for
    each power of two of them.

    A checksum register is linear over bits, so the images of its four bytes tell those of all values.
    """
    rule = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rule = np.where(rule & 1, (rule >> 1) ^ np.uint32(0xEDB88320), rule >> 1)
    none = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [none]
    for _ in range(63):
        short.append(rule[short[-1] & 255] ^ (short[-1] >> np.uint32(8)))
    powers = [short[1]]
    for _ in range(31):
        powers.append(_step(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


_SHORT, _POWERS = _crc_steps()
_FLAT = [np.ascontiguousarray(_SHORT[:, k]).ravel() for k in range(4)]


def crc_after(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of texts put together: ``first`` moves on by the ``length`` bytes of ``second``."""
    at = np.minimum(length, 63).astype(np.uint32) << np.uint32(8)
    moved = _FLAT[0][at | first & 255]
    moved ^= _FLAT[1][at | first >> 8 & 255]
    moved ^= _FLAT[2][at | first >> 16 & 255]
    moved ^= _FLAT[3][at | first >> 24]
    long = np.flatnonzero(length > 63)
    if len(long):
        slow, left = first[long], length[long]
        for p in range(int(left.max()).bit_length()):
            slow = np.where(left >> p & 1, _step(_POWERS[p], slow), slow)
        moved[long] = slow
    return moved ^ second


def features(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, document of each feature, bucket of each feature) of one batch of texts."""
    data = b"".join(x for b in held for x in (b.replace(SENTINEL, b" "), SENTINEL))
    tokens = TOKENS.findall(data.lower())
    crc = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.flatnonzero((length == 1) & (crc == zlib.crc32(SENTINEL)))
    word = np.ones(len(tokens), bool)
    word[ends] = False
    at = np.flatnonzero(word)
    doc, crc, length = np.searchsorted(ends, at), crc[at], length[at]
    spaced = _step(_SHORT[1], ~crc ^ np.uint32(32)) ^ np.uint32(0xFFFFFFFF)
    docs, found, run, size = [doc], [crc], crc, length
    for k in range(1, RUN):
        n = max(len(doc) - k, 0)
        run = crc_after(spaced[:n], run[1 : n + 1], size[1 : n + 1])
        size = length[:n] + 1 + size[1 : n + 1]
        within = doc[:n] == doc[k : k + n]
        docs.append(doc[:n][within])
        found.append(run[within])
    bucket = np.concatenate(found) % np.uint32(BUCKETS)
    return np.bincount(doc, minlength=len(held)), np.concatenate(docs), bucket.astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of a ``text`` column fall in each bucket; tasks add up what they read before it is shuffled."""
    ship_package(texts.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, held in passes(batch["text"].tolist()):
                total += np.bincount(features(held)[2], minlength=BUCKETS)
        on = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": on, "n": total[on]})

    parts = packed(texts).select("row.text").mapInPandas(counted, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight, in thousandths, rounded down."""
    s, t = documents.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths from a digest of the id; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(row, n_words, n_features, weight) of every document against the ``text`` column of ``target``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(gains(bucket_counts(documents), bucket_counts(target)))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gain = shared.value.astype(float)
        for part in parts:
            made = [np.zeros((0, 3), np.int64)]
            for _, held in passes(part.tolist()):
                words, doc, bucket = features(held)
                weight = np.bincount(doc, gain[bucket], len(held)).astype(np.int64)
                made.append(np.stack([words, np.bincount(doc, minlength=len(held)), weight], axis=1))
            yield pd.DataFrame(np.concatenate(made), columns=["n_words", "n_features", "weight"])

    return packed(documents).select("row", weighed(F.col("row.text")).alias("w")).select("row", "w.*")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` counts the drawn ones from 1.

    Of the documents with LEAST_WORDS words, ``percent`` in a hundred are drawn without replacement, likelier the larger
    their weight: the highest sums of weight and noise, ties to the smaller id. Null text counts as no words, and the sum
    of no features is 0. Repeated rows are documents of their own; equal ones are ranked one after another. Null ids
    come before others of the same score. No documents: no rows. No target texts: every bucket's gain rests on smoothing alone.
    """
    weighed = weigh(documents, target).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "resampling")
    could = F.col("n_words") >= LEAST_WORDS
    draw = scored.filter(could).count() * percent // 100
    order = [F.when(could, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    placed = numbered(scored, order, "place", "resampled")
    rank = F.when(could & (F.col("place") < draw), F.col("place") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


#: The checksum's table is made by its rule; words are lower-cased and run together as the operator does it.
RESAMPLE_SQL = r"""
with recursive crc_step(i, k, v) as (
  select i, 0, i::ubigint from range(256) r(i)
  union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from crc_step where k < 8
), rule as (select list(v order by i) as tab from crc_step where k = 8),
lowered as (
  select true as is_doc, row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select false, row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), runs as (
  select is_doc, row, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]
    || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as f from lowered
), grouped as (
  select is_doc, row, f, count(*) as n from runs group by all
), names as (select distinct f, hex(encode(f)) as h from grouped),
hashed as (
  select f, xor(list_reduce([4294967295::ubigint] || [('0x' || h[2 * i + 1 : 2 * i + 2])::ubigint for i in range(len(h) // 2)],
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 10000 as bucket from names, rule
), placed as (select is_doc, row, bucket, sum(n) as n from grouped join hashed using (f) group by all),
counts as (
  select bucket, coalesce(sum(n) filter (is_doc), 0)::double as s, coalesce(sum(n) filter (not is_doc), 0)::double as t
  from placed group by 1
), totals as (select sum(s) as ss, sum(t) as tt from counts),
gains as (
  select bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint as gain from counts, totals
), weights as (
  select row, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from placed join gains using (bucket) where is_doc group by 1
), scored as (
  select doc_id, len(w) >= 20 as could, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::ubigint + 0.5e0)
      / 4294967296e0)))::bigint as score
  from lowered left join weights using (row) where is_doc
), placed_docs as (
  select *, row_number() over (partition by could order by score desc, doc_id nulls first, n_features) as place,
    (select count(*) from scored where could) * 5 // 100 as draw from scored
)
select doc_id, n_features, weight, score, case when could and place <= draw then place end as rank from placed_docs
"""
