"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import LETTERS, joined, packed, passes, small_batches, word_hashes, word_heads
from salescope.llm.labelled import labelled_sample, remainder
from salescope.plans.session import ship_package

#: Labelled documents the model is fitted on at most.
SAMPLE_ROWS = 20_000

#: One sampled row in so many is kept from the fit, to calibrate its scores.
CALIBRATION = 5


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    factors: int = 4
    steps: int = 1_500
    batch: int = 256
    step: float = 0.1
    shrink: float = 1e-3


@dataclass
class Machine:
    """A fitted model; its size depends on the settings alone."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def pass_terms(held: list[bytes], buckets: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of each distinct term of one pass of texts: words of letters and digits, lower-cased, and
    their beginnings. ``keep`` tells the buckets of interest; others are left out.
    """
    data, starts = joined(held)
    h, at, end = word_hashes(data, LETTERS)
    doc = (np.searchsorted(starts, at, "right") - 1).astype(np.int32)
    heads = word_heads(data, at, end, 5)
    bucket = np.concatenate([h % np.uint64(buckets), heads % np.uint64(buckets)]).astype(np.int32)
    doc = np.concatenate([doc, doc])
    if keep is not None:
        good = keep[bucket]
        doc, bucket = doc[good], bucket[good]
    pair = np.unique(doc.astype(np.int64) * buckets + bucket)
    return (pair // buckets).astype(np.int32), (pair % buckets).astype(np.int32)


def kept_terms(model: Machine) -> np.ndarray:
    """The buckets whose weight or factors are not all zero."""
    return (model.linear != 0) | (model.factors != 0).any(axis=0)


def score(texts: list[str | None], model: Machine, keep: np.ndarray | None = None) -> np.ndarray:
    """Scores of whole texts, one bounded pass after the other; ``keep`` is :func:`kept_terms`, worked out once for many calls."""
    keep = kept_terms(model) if keep is None else keep
    raw = np.full(len(texts), model.bias)
    for first, held in passes(texts):
        doc, bucket = pass_terms(held, len(model.linear), keep)
        n = len(held)
        own = np.zeros(n)
        own += np.bincount(doc, model.linear[bucket], n)
        for row in model.factors:
            v = row[bucket]
            own += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        raw[first : first + n] += own
    return 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, s: Settings = Settings()) -> Machine:
    """Fits weights and factors of all terms in ``rows``, the numbers of each document's terms.

    Adaptive steps over shuffled batches; weights shrink towards zero, so terms without a bearing end there. No term
    is left out beforehand: one that tells nothing alone may tell much together with another.
    Without labelled rows every score is one half; with labels of one kind the bias alone tells it.
    """
    rng = np.random.default_rng(7)
    model = Machine(0.0, np.zeros(s.buckets), np.zeros((s.factors, s.buckets)))
    if not len(rows):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.bias = float(np.log(share / (1 - share)))
    size = np.array([len(r) for r in rows], np.int64)
    begin = np.cumsum(size) - size
    flat = np.concatenate(rows).astype(np.int32)
    seen = np.flatnonzero(np.bincount(flat, minlength=s.buckets))
    place = np.zeros(s.buckets, np.int32)
    place[seen] = np.arange(len(seen))
    flat = place[flat]
    # One column for each term that occurs: its weight, then its factors.
    k, m = s.factors, len(seen)
    weights = np.concatenate([np.zeros((1, m)), rng.normal(0, 0.02, (k, m))])
    squares = np.full((k + 1, m), 1e-3)
    speed = np.array([s.step] + [0.3 * s.step] * k)[:, None]
    there = np.zeros(m, bool)
    gb = 1e-3
    for _ in range(-(-s.steps * s.batch // max(len(rows), s.batch))):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), s.batch):
            part = order[a : a + s.batch]
            n, own = len(part), size[part]
            doc = np.repeat(np.arange(n), own)
            term = flat[np.arange(len(doc)) + np.repeat(begin[part] - (np.cumsum(own) - own), own)]
            there[term] = True
            used = np.flatnonzero(there)
            there[used] = False
            place[used] = np.arange(len(used))
            term = place[term]
            w = weights[:, used]
            held = [c[term] for c in w]
            total = np.stack([np.bincount(doc, c, n) for c in held])
            square = np.bincount(doc, sum(c * c for c in held[1:]), n)
            raw = model.bias + total[0] + 0.5 * ((total[1:] ** 2).sum(axis=0) - square)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / n
            total[0] = 1
            g = np.stack([np.bincount(term, c[doc], len(used)) for c in total * error])
            g[1:] -= g[0] * w[1:]
            square = squares[:, used] + g * g
            squares[:, used] = square
            rate = speed / np.sqrt(square)
            w -= rate * g
            weights[:, used] = np.sign(w) * np.maximum(np.abs(w) - rate * s.shrink, 0)
            g0 = float(error.sum())
            gb += g0 * g0
            model.bias -= s.step * g0 / gb**0.5
    model.linear[seen], model.factors[:, seen] = weights[0], weights[1:]
    return model


def raw_scores(rows: list[np.ndarray], model: Machine) -> np.ndarray:
    """Scores before calibration and the logistic function, of documents given by their terms."""
    out = []
    for r in rows:
        v = model.factors[:, r]
        out.append(model.bias + model.linear[r].sum() + 0.5 * (v.sum(axis=1) ** 2 - (v * v).sum(axis=1)).sum())
    return np.array(out)


def calibrated(model: Machine, raw: np.ndarray, y: np.ndarray) -> Machine:
    """The slope and shift under which raw scores of rows the model has not seen tell their labels' odds best.

    Shrinkage holds raw scores near the base rate; a logistic curve through the unseen rows undoes it. Newton steps on the penalized
    likelihood, the penalty that of one row of each label. With labels of one kind nothing changes.
    """
    if len(set(y.tolist())) < 2:
        return model
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    x = np.concatenate([x, [[raw[y == 1].mean(), 1], [raw[y == 0].mean(), 1]]])
    goal = np.concatenate([y, [0.5, 0.5]])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p) - 1e-6 * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return replace(model, slope=max(float(w[0]), 0.0), shift=float(w[1]))


def train(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), folds: int = 5, held: int = 0) -> Machine:
    """Fits the machine on at most SAMPLE_ROWS labelled documents.

    Spark works out their terms; all of them reach the driver, four bytes for each distinct term of a document.
    """
    ship_package(documents.sparkSession)
    small_batches(documents.sparkSession)
    buckets = s.buckets

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = []
            for _, held in passes(batch["text"].tolist()):
                doc, bucket = pass_terms(held, buckets)
                cuts = np.searchsorted(doc, np.arange(1, len(held)))
                own += [t.tobytes() for t in np.split(bucket.astype("<i4"), cuts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "terms": own})

    sample = labelled_sample(documents, labels, "toxic", folds, held, SAMPLE_ROWS)
    made = sample.mapInPandas(featurize, "doc_id long, y int, terms binary").toPandas().sort_values("doc_id")
    rows, y = [np.frombuffer(t, "<i4") for t in made["terms"]], made["y"].to_numpy(float)
    apart = np.arange(len(rows)) % CALIBRATION == 0
    model = fit([r for r, a in zip(rows, apart) if not a], y[~apart], s)
    return calibrated(model, raw_scores([r for r, a in zip(rows, apart) if a], model), y[apart])


def score_toxicity(documents: DataFrame, model: Machine) -> DataFrame:
    """(row, score) for every document, ``row`` with all its columns; null and empty texts get the score of no terms."""
    spark = documents.sparkSession
    ship_package(spark)
    small = replace(model, linear=model.linear.astype(np.float32), factors=model.factors.astype(np.float32))
    shared = spark.sparkContext.broadcast(small)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep = None
        for part in texts:
            keep = kept_terms(shared.value) if keep is None else keep
            yield pd.Series(score(part.tolist(), shared.value, keep))

    docs = packed(documents)
    return docs.select("row", scored(F.col("row.text")).alias("score"))


def classify(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(row, held_out, score, predicted): predicted is 1 from the score ``least`` on.

    Repeated rows get equal scores. No documents: no rows. No labels: every score is one half.
    """
    scored = score_toxicity(documents, train(documents, labels))
    return scored.select(
        "row", (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
