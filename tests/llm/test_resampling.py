import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from salescope.llm import resampling
from salescope.plans.numbering import numbered

TEXTS = ["Hello World éé foo-bar 12", "", "a", "a b", "X" * 300 + " yy " + "z" * 70_000, "\U0001f600 K İ ß A_B", "u\0v w\0", None]


def plain(text):
    """Words and bucket numbers of the features of one text, word by word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), sorted(zlib.crc32(r.encode()) % 10_000 for r in runs)


def drawn(documents, target, percent=5):
    """All rows as the contract tells them, from whole lists in memory."""
    counted = [(i, *plain(t)) for i, t in documents]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, _, b in counted:
        np.add.at(s, b, 1)
    for x in target:
        np.add.at(t, plain(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + 10_000) / ((s[k] + 1) * (t.sum() + 10_000)))) for k in range(10_000)]
    rows = []
    for i, n, b in counted:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in b)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, n, len(b), weight, score, None])
    could = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(could[: len(could) * percent // 100], 1):
        r[5] = k
    return sorted(map(repr, map(tuple, rows)))


def test_batches_count_what_texts_alone_count():
    words, doc, bucket = resampling.features([(t or "").encode() for t in TEXTS])
    assert [(int(words[i]), sorted(bucket[doc == i].tolist())) for i in range(len(TEXTS))] == [plain(t) for t in TEXTS]


def test_checksums_of_joined_texts():
    parts = [(b"ab", b""), (b"", b"x" * 63), (b"q", b"y" * 64), (b"r" * 7, b"z" * 100_003)]
    first, second, size = (np.array(x) for x in zip(*[(zlib.crc32(a), zlib.crc32(b), len(b)) for a, b in parts]))
    made = resampling.crc_after(first.astype(np.uint32), second.astype(np.uint32), size)
    assert made.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("target", [["word1 word7919 fun", "éé café", None], []])
def test_same_as_in_memory(spark, docs, target):
    rows = [(None, None), (None, "no id " * 9), (1, ""), (2, "one two"), (2, "one two")]
    rows += [(i, " ".join(f"word{(i * k) % 97}" for k in range(15 + i % 30))) for i in range(3, 120)] + [(50, "word1 " * 40)] * 3
    made = resampling.resample(docs(rows), spark.createDataFrame([(t,) for t in target], "text string"), 30).collect()
    assert sorted(repr(tuple(r)) for r in made) == drawn(rows, target, 30)


def test_no_documents(spark, docs):
    assert resampling.resample(docs([]), spark.createDataFrame([("a b",)], "text string")).collect() == []


def test_numbers_without_gaps(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000, numPartitions=7).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 11))
    rows = numbered(df, [F.col("k").desc()], "at").collect()
    assert sorted(r["at"] for r in rows) == list(range(5000))
    keys = [r.k for r in sorted(rows, key=lambda r: r["at"])]
    assert keys == sorted(keys, reverse=True)
