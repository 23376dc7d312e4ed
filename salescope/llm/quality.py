"""Quality scores: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import LETTERS_AND_SIGNS, joined, mix64, packed, passes, word_hashes
from salescope.llm.labelled import labelled_sample, remainder
from salescope.plans.session import ship_package

#: Labelled documents the network is fitted on at most.
SAMPLE_ROWS = 20_000

#: Word vectors: words are hashed into a fixed number of them, so the table has one size for any corpus.
WIDTH, BUCKETS, SLICE = 48, 1 << 14, 1 << 8


def _index(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-th place and sign of the sparse index vector of each word."""
    x = mix64(h + np.uint64(0x632BE59BD9B4E019) * np.uint64(n + 1))
    return (x % np.uint64(WIDTH)).astype(np.int64), ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


@dataclass
class Tokens:
    """Words of letters and digits, and runs of signs, of the documents of one pass; ``form`` tells how a word looks."""

    doc: np.ndarray
    word: np.ndarray
    form: np.ndarray


def tokens(held: list[bytes]) -> Tokens:
    """The form of a word: its length up to 12, signs or letters, its first two capitals, and whether it repeats one just before."""
    data, starts = joined(held)
    h, at, end = word_hashes(data, LETTERS_AND_SIGNS, lower=False)
    raw = np.frombuffer(data, np.uint8)
    doc = np.searchsorted(starts, at, "right") - 1
    sign = LETTERS_AND_SIGNS[raw[at]] == 2
    capital = lambda b: (b >= 65) & (b <= 90)
    second = raw[np.minimum(at + 1, end - 1)]
    again = np.zeros(len(h), np.uint64)
    for back in (1, 2, 3, 4):
        same = np.zeros(len(h), bool)
        same[back:] = h[back:] == h[:-back]
        again[same & (again == 0)] = back
    form = np.minimum(end - at, 12).astype(np.uint64)
    form = form * np.uint64(2) + sign
    form = (form * np.uint64(2) + capital(raw[at])) * np.uint64(2) + capital(second)
    form = mix64(form * np.uint64(8) + again + np.uint64(1 << 20))
    return Tokens(doc, h, form)


def contexts(texts: list[str | None], total: np.ndarray) -> None:
    """Adds to ``total`` (words by WIDTH) the index vectors of the words and forms next to each word."""
    for _, held in passes(texts):
        t = tokens(held)
        bucket = (t.word % np.uint64(BUCKETS)).astype(np.int64) * WIDTH
        near = t.doc[1:] == t.doc[:-1]
        for source in (t.word, t.form):
            for n in (0, 1):
                place, sign = _index(source, n)
                for here, there in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                    at = bucket[here] + place[there]
                    total += np.bincount(at[near & (sign[there] == 1)], minlength=len(total))
                    total -= np.bincount(at[near & (sign[there] == 0)], minlength=len(total))


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The random-indexing vectors of all words, from every document of the corpus.

    Each task adds up one table of fixed size; Spark adds the tables slice by slice. What reaches the driver is one
    table, BUCKETS * WIDTH numbers, whatever the corpus. Vectors are scaled to length one; words never seen have zeros.
    """
    ship_package(documents.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS * WIDTH, np.int64)
        for batch in batches:
            contexts(batch["text"].tolist(), total)
        parts = total.reshape(-1, SLICE * WIDTH)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"slice": some, "sums": [_narrow(parts[i]) for i in some]})

    def add(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        total = sum(_wide(b) for b in batch["sums"])
        return pd.DataFrame({"slice": [key[0]], "sums": [total.astype("<i8").tobytes()]})

    sums = documents.select("text").mapInPandas(count, "slice long, sums binary")
    rows = sums.groupBy("slice").applyInPandas(add, "slice long, sums binary").collect()
    table = np.zeros((BUCKETS // SLICE, SLICE * WIDTH))
    for row in rows:
        table[row["slice"]] = np.frombuffer(row["sums"], "<i8")
    table = table.reshape(BUCKETS, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold all of them."""
    most = int(np.abs(x).max(initial=0))
    kind = next(k for k, limit in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1), ("<i8", 2**63 - 1)) if most <= limit)
    return bytes([int(kind[2])]) + x.astype(kind).tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Features of each document: mean word vector, mean form vector, their lengths, and the number of words on a log scale."""
    out = np.zeros((len(texts), 2 * WIDTH + 3), np.float32)
    for first, held in passes(texts):
        t = tokens(held)
        n = np.bincount(t.doc, minlength=len(held)).astype(np.float32)
        part = out[first : first + len(held)]
        if len(t.doc):
            bucket = (t.word % np.uint64(BUCKETS)).astype(np.int64)
            begin = np.searchsorted(t.doc, np.arange(len(held)))
            some = n > 0
            for a in range(0, WIDTH, 16):
                part[some, a : a + 16] = np.add.reduceat(vectors[:, a : a + 16][bucket], begin[some], axis=0)
            for k in (0, 1):
                place, sign = _index(t.form, k)
                flat = np.bincount(t.doc * WIDTH + place, sign * 2.0 - 1, len(held) * WIDTH)
                part[:, WIDTH : 2 * WIDTH] += flat.reshape(-1, WIDTH)
        part[:, : 2 * WIDTH] /= np.maximum(n, 1)[:, None]
        part[:, -3] = np.linalg.norm(part[:, :WIDTH], axis=1)
        part[:, -2] = np.linalg.norm(part[:, WIDTH : 2 * WIDTH], axis=1)
        part[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers over scaled features; probabilities are divided by a temperature before the logistic."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 4_000, batch: int = 256, step: float = 0.01) -> Network:
    """Adam on four fifths of the rows; the temperature with the least log loss on the rest calibrates the scores.

    Without rows every score is one half.
    """
    rng = np.random.default_rng(11)
    wide = x.shape[1]
    net = Network(np.zeros(wide), np.ones(wide), rng.normal(0, wide**-0.5, (wide, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(x):
        return net
    order = rng.permutation(len(x))
    kept = order[: max(1, len(x) * 4 // 5)]
    left = order[len(kept):] if len(x) > 4 else order
    net.mean, net.scale = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-3
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    z = (x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for n in range(1, steps + 1):
        part = rng.choice(kept, batch)
        hid = np.tanh(z[part] @ weights[0] + weights[1])
        error = (1 / (1 + np.exp(-np.clip(hid @ weights[2] + weights[3][0], -30, 30))) - y[part]) / batch
        back = np.outer(error, weights[2]) * (1 - hid * hid)
        grads = [z[part].T @ back + 1e-4 * weights[0], back.sum(axis=0), hid.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
        rate = step * (1 - n / (steps + 1))
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *weights[:3], float(weights[3][0])
    raw = net.raw(x[left])

    def loss(temperature: float) -> float:
        p = raw / temperature
        return float(np.mean(np.logaddexp(0, p) - y[left] * p))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def train(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, folds: int = 4, held: int = 2) -> Network:
    """Fits the network on at most SAMPLE_ROWS labelled documents, pooled by Spark."""
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": list(pooled(batch["text"].tolist(), shared.value))})

    sample = labelled_sample(documents, labels, "quality", folds, held, SAMPLE_ROWS)
    rows = sample.mapInPandas(featurize, "doc_id long, y int, x array<float>").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), 2 * WIDTH + 3)
    return fit(x, rows["y"].to_numpy(float))


def score_quality(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(row, held_out, score, predicted) for every document, ``row`` with all its columns.

    predicted is 1 from the score ``least`` on. Null and empty texts have no words and get the score of zero
    vectors; repeated rows get equal scores. No documents: no rows. No labels: every score is one half.
    """
    spark = documents.sparkSession
    vectors = word_vectors(documents)
    net = train(documents, labels, vectors)
    shared = spark.sparkContext.broadcast((vectors, net))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, model = shared.value
        for part in parts:
            yield pd.Series(model.score(pooled(part.tolist(), table).astype(float)))

    docs = packed(documents).select("row", scored(F.col("row.text")).alias("score"))
    return docs.select(
        "row", (remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
