"""A corpus made ready for training: five stages over the documents, each written and read again by the next.

Toxic documents go, one of each group of near-duplicates stays, passages that an earlier document has are cut out,
sources are mixed to their target weights, and what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm import mixing, near_duplicates, packing, repeats, toxicity
from salescope.llm.common import read_table
from salescope.plans.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels outside the held-out fold.

    A score of one half tells nothing, so it keeps a document: without a labelled row to learn from, nothing is dropped.
    """
    scored = toxicity.classify(docs, read_table(spark, sf_dir, "labels"))
    kept = scored.filter(F.col("score") <= 0.5)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return near_duplicates.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier one has, too; ``n_chars`` follows. A null text stays null."""
    done = repeats.deduplicate(docs)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars"))
    return done.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, in training order."""
    return mixing.training_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: the classifier, the near-duplicate components and the token ids can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
