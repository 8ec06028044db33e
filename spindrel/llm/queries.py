"""The registered queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, jaccard, mixing, neighbours, packing, quality, sharding, tokenbin, toxicity, urls
from .common import scratch, table
from .tokens import public_vocabulary


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_vocabulary(), capacity=2048, end_id=1)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compacted store gives back, with digests of the texts."""
    docs = sharding.compacted(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return docs.select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_next(table(spark, sf_dir, "documents"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_files(table(spark, sf_dir, "documents"), public_vocabulary(), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_learned_partitions, op3_mixing, op4_quality, op5_packing, op6_ngram_jaccard, op7_sharding, op8_url_filters, op9_imatch, op10_token_binary)}
