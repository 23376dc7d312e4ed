"""The registered queries of this subpackage and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm import (
    conversations, main_text, mixing, near_duplicates, neighbours, packing, personal_data, quality, repeats, resampling, sharding,
    top_k, toxicity,
)
from salescope.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, size=F.col("row.size"))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.get("positions", F.lit(0)).alias("first_position"),
    )


SQL["op3_mixing"] = mixing.MIX_SQL


@query
def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    sharded = sharding.shard_documents(read_table(spark, sf, "documents").select("doc_id", "text"))
    return sharded.select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, read_table(spark, sf, "labels"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, read_table(spark, sf, "labels"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


@query
def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = main_text.extract_pages(read_table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.link_documents(read_table(spark, sf, "documents").select("doc_id", "text"))


@query
def op1_repeats(spark: SparkSession, sf: str) -> DataFrame:
    done = repeats.deduplicate(read_table(spark, sf, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_k.top_k(read_table(spark, sf, "embeddings").select("vec_id", "embedding"))


SQL["op5_top_k"] = top_k.TOP_K_SQL


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


@query
def op6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, read_table(spark, sf, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op11_resampling"] = resampling.RESAMPLE_SQL


@query
def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair(read_table(spark, sf, "conversations"))


SQL["op13_conversations"] = conversations.REPAIR_SQL


@query
def op12_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data.detect(read_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
