"""Exact facets over the matching documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..mapping import IndexMapping, number_text


@dataclass(frozen=True)
class Range:
    key: str
    start: float | None = None
    end: float | None = None


@dataclass(frozen=True)
class Facet:
    name: str
    field: str
    ranges: tuple[Range, ...] = ()
    size: int = 10
    shard_size: int | None = None

    @property
    def per_shard(self) -> int:
        return self.shard_size or int(self.size * 1.5) + 10


def values(docs: DataFrame, mapping: IndexMapping, name: str) -> DataFrame:
    """(shard_id, key): a row for each value of each document, repeated values included."""
    f = mapping.by_name[name]
    if f.numeric and f"{name}__num" in docs.columns:
        return docs.where(F.col(f"{name}__num").isNotNull()).select("shard_id", number_text(F.col(f"{name}__num")).alias("key"))
    if f"{name}__kw" in docs.columns:
        return docs.select("shard_id", F.explode(f"{name}__kw").alias("key"))
    return docs.where(F.lit(False)).select("shard_id", F.lit("").alias("key"))


def terms(docs: DataFrame, mapping: IndexMapping, facet: Facet) -> DataFrame:
    """(key, count, error_bound, other): the largest counts first, keys in order among equals; exact, so the bound is 0."""
    counts = values(docs, mapping, facet.field).groupBy("key").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    top = counts.orderBy(F.desc("count"), "key").limit(facet.size)
    top = top.crossJoin(F.broadcast(total)).withColumn("other", F.col("total") - F.sum("count").over(Window.partitionBy()))
    return top.select("key", "count", F.lit(0).cast("long").alias("error_bound"), "other").orderBy(F.desc("count"), "key")


def terms_by_shard(docs: DataFrame, mapping: IndexMapping, facet: Facet) -> DataFrame:
    """As terms(), from the largest counts of each shard alone, with what that may have missed."""
    counts = values(docs, mapping, facet.field).groupBy("shard_id", "key").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("shard_id").orderBy(F.desc("count"), "key"))
    ranked = counts.withColumn("place", place)
    kept = ranked.where(F.col("place") <= facet.per_shard).groupBy("key").agg(F.sum("count").alias("count"))
    missed = ranked.where(F.col("place") > facet.per_shard).agg(F.coalesce(F.sum(F.when(F.col("place") == facet.per_shard + 1, F.col("count"))), F.lit(0)).alias("error_bound"), F.coalesce(F.sum("count"), F.lit(0)).alias("omitted"))
    own = kept.agg(F.sum("count").alias("total"))
    top = kept.orderBy(F.desc("count"), "key").limit(facet.size).crossJoin(F.broadcast(missed)).crossJoin(F.broadcast(own))
    other = F.col("omitted") + F.col("total") - F.sum("count").over(Window.partitionBy())
    return top.select("key", "count", "error_bound", other.alias("other")).orderBy(F.desc("count"), "key")


def ranges(docs: DataFrame, facet: Facet) -> DataFrame:
    """(place, key, count) in the order given; ranges include their start and not their end, may overlap, and may be empty."""
    name = f"{facet.field}__num"
    x = F.col(name) if name in docs.columns else F.lit(None).cast("double")
    each = []
    for i, r in enumerate(facet.ranges):
        inside = x.isNotNull()
        inside &= x >= r.start if r.start is not None else F.lit(True)
        inside &= x < r.end if r.end is not None else F.lit(True)
        each.append(F.struct(F.lit(i).alias("place"), F.lit(r.key).alias("key"), F.count_if(inside).alias("count")))
    return docs.agg(F.array(*each).alias("r")).select(F.inline("r"))
