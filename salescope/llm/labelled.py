"""What the trained scorers share: which rows are held out, and the bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: (doc_id, text, y).

    Those with the smallest digests of their ids are taken, so the sample is the same on every run. A repeated
    label row counts once, the larger label wins; of documents with one id the alphabetically first text is taken.
    Rows without an id or a label are left out. The ids of the sample are few enough to be broadcast.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    marked = marked.filter(remainder(F.col("doc_id"), folds) != held)
    marked = marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
