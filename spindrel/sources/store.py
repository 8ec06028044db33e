"""The document log: an append-only table of upserts and tombstones, the truth that indexes are derived from.

A row's version is that of its bulk, a number which no other bulk has; rows of one bulk follow each other by seq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import shard_of
from ..mapping import FieldMapping, IndexMapping, typed
from .files import Folder


@dataclass
class BulkResult:
    accepted: int
    errors: DataFrame  # doc_id, error


def newest(log: DataFrame) -> DataFrame:
    """The last row of each document, deleted or not: by version, and by seq where there is one."""
    order = [F.desc(c) for c in ("version", "seq") if c in log.columns]
    return log.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("_n = 1").drop("_n")


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each document that isn't deleted."""
    return newest(log).where("not deleted")


class DocumentStore:
    """A folder of Parquet files, partitioned by shard; a write adds files with a version above all before."""

    def __init__(self, spark: SparkSession, uri: str, mapping: IndexMapping):
        self.spark, self.uri, self.mapping = spark, uri.rstrip("/"), mapping

    @property
    def log_uri(self) -> str:
        return f"{self.uri}/log"

    def schema(self) -> T.StructType:
        values = [T.StructField(f.name, T.ArrayType(self.mapping.schema()[f.name].dataType)) for f in self.mapping.fields]
        rest = [("acl", T.ArrayType(T.StringType())), ("deleted", T.BooleanType()), ("version", T.LongType()), ("seq", T.LongType()), ("shard_id", T.IntegerType())]
        return T.StructType([T.StructField("doc_id", T.StringType()), *values, *(T.StructField(n, t) for n, t in rest)])

    def log(self) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.log_uri).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.log_uri)):
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(self.log_uri)

    def next_version(self) -> int:
        return Folder(self.spark, f"{self.uri}/versions").take()

    def _write(self, rows: DataFrame) -> None:
        rows.select(*self.schema().names).write.mode("append").partitionBy("shard_id").parquet(self.log_uri)

    def bulk(self, docs: DataFrame, version: int | None = None) -> BulkResult:
        """Adds docs: doc_id, some of the mapped fields, perhaps acl, routing and other columns, where values in columns that
        aren't mapped make a row an error. Rows without id are errors too; the others are written. Of rows with one id the
        last counts, in the order of the frame's partitions and rows."""
        known = {*self.mapping.by_name, "doc_id", "acl", "routing"}
        unknown = [c for c in docs.columns if c not in known]
        error = F.when(F.col("doc_id").isNull() | (F.col("doc_id").cast("string") == ""), F.lit("no id"))
        for c in unknown:
            error = error.when(F.col(f"`{c}`").isNotNull(), F.lit(f"field {c} isn't mapped"))
        judged = docs.withColumn("_error", error).withColumn("_seq", F.monotonically_increasing_id())
        good = judged.where("_error is null").withColumn("doc_id", F.col("doc_id").cast("string"))
        key = F.coalesce(F.col("routing").cast("string"), "doc_id") if "routing" in docs.columns else F.col("doc_id")
        values = [self._values(docs, f).alias(f.name) for f in self.mapping.fields]
        acl = F.coalesce("acl", F.array().cast("array<string>")) if "acl" in docs.columns else F.array().cast("array<string>")
        rows = good.select("doc_id", *values, acl.alias("acl"), F.lit(False).alias("deleted"), F.lit(version or self.next_version()).cast("long").alias("version"), F.col("_seq").alias("seq"), shard_of(key, self.mapping.shards).cast("int").alias("shard_id"))
        self._write(rows)
        return BulkResult(good.count(), judged.where("_error is not null").select("doc_id", F.col("_error").alias("error")))

    def _values(self, docs: DataFrame, f: FieldMapping):
        kind = self.mapping.schema()[f.name].dataType
        if f.name not in docs.columns:
            return F.lit(None).cast(T.ArrayType(kind))
        own = docs.schema[f.name].dataType
        many = isinstance(own, T.ArrayType)
        one = F.col(f.name) if many else F.when(F.col(f.name).isNotNull(), F.array(f.name))
        return F.transform(F.filter(one, lambda x: x.isNotNull()), lambda x: typed(f, x, own.elementType if many else own))

    def delete(self, ids: DataFrame, version: int | None = None) -> None:
        """Tombstones for ids (doc_id), in the shards that the documents are in."""
        now = self.log().select("doc_id", "shard_id").distinct()
        rows = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(now, "doc_id", "left")
        empty = [F.lit(None).cast(self.schema()[f.name].dataType).alias(f.name) for f in self.mapping.fields]
        shard = F.coalesce("shard_id", shard_of(F.col("doc_id"), self.mapping.shards)).cast("int")
        self._write(rows.select("doc_id", *empty, F.array().cast("array<string>").alias("acl"), F.lit(True).alias("deleted"), F.lit(version or self.next_version()).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), shard.alias("shard_id")))

    def get(self, *ids: str) -> DataFrame:
        """The newest live versions of some documents."""
        return latest(self.log().where(F.col("doc_id").isin(*ids)))

    def live(self) -> DataFrame:
        return latest(self.log())
