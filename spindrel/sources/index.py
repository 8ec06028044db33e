"""Index tables: built from documents, written as immutable segments, found by the manifest of a generation.

postings  field, term, doc_id, shard_id, tf, len, positions: a row for each term of a document's field, with the field's length
docs      doc_id, shard_id, acl, the stored values, and for sorts, ranges and facets <field>__num or <field>__kw
changed   doc_id, version, seq, deleted: what a segment says of documents, deleted ones too
terms     field, term, df: the dictionary, over all segments
stats     field, shard_id, doc_count, sum_len; the row with a null field counts all documents of a shard; over all segments

A segment holds the documents that one publication changed. Where a later segment names a document, earlier ones no longer
count for it. Postings lie in ranges of (field, term, doc_id), so that the documents of one term spread over files and tasks;
docs lie in ranges of doc_id, so that a page reads few row groups.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import Registry
from ..functions.hashing import shard_of
from ..mapping import FieldMapping, FieldType, IndexMapping, number_form, number_text, term_form, to_dict, typed
from . import blocks
from .blocks import GAP
from .files import Folder

#: A task puts about so many bytes of Parquet in order; there are as many tasks as that takes.
PIECE = 6 << 20
#: The version of what is written.
FORMAT = 2
CHANGED = "doc_id string, version long, seq long, deleted boolean"


def fingerprint(mapping: IndexMapping) -> str:
    """What an index must agree on with the mapping that it is read by."""
    return json.dumps(to_dict(mapping), sort_keys=True)


def sums(rows: list[DataFrame], keys: list[str], values: list[str], kept: str) -> DataFrame:
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values)).where(f"{kept} > 0")


@dataclass
class Index:
    mapping: IndexMapping
    analyzers: Registry
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    docs: DataFrame
    #: Where postings and docs have been written already, in their order.
    home: str | None = None
    #: Statistics that queries have looked up; an index never changes.
    memo: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def _segment(self, data: str, changed: DataFrame | None) -> dict:
        """Writes this index's documents as a segment; returns its paths."""
        if not self.home:
            placed(self.postings).write.parquet(f"{data}/postings")
            self.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{data}/docs")
        rows = self.docs.select("doc_id", F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted")) if changed is None else changed
        rows.write.parquet(f"{data}/changed")
        home = self.home or data
        return {"postings": f"{home}/postings", "docs": f"{home}/docs", "changed": f"{data}/changed", "analysis": analysis(self.mapping, self.analyzers)}

    @staticmethod
    def _commit(folder: Folder, mapping: IndexMapping, data: str, terms: DataFrame, stats: DataFrame, segments: list[dict], token: str) -> int:
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{data}/terms")
        stats.coalesce(1).write.parquet(f"{data}/stats")  # a row for each field and shard
        generation = max(folder.versions(), default=0) + 1
        folder.commit(generation, {"format": FORMAT, "index": mapping.name, "mapping": fingerprint(mapping), "generation": generation, "segments": segments, "terms": f"{data}/terms", "stats": f"{data}/stats", "token": token})
        return generation

    def save(self, uri: str, token: str = "", changed: DataFrame | None = None) -> int:
        """Writes the index as one segment, and a new generation of it; returns its number. An older generation never
        replaces a newer one, since a manifest's name is taken once."""
        folder, data = Folder(self.spark, uri), f"{uri}/data/{uuid.uuid4().hex}"
        segment = self._segment(data, changed)
        return self._commit(folder, self.mapping, data, self.terms, self.stats, [segment], token)

    def append(self, uri: str, changed: DataFrame, token: str = "") -> int:
        """Adds this index of changed documents to the newest generation. What was there of these documents is taken off the
        dictionary and the statistics; neither postings nor documents are written again."""
        folder, data = Folder(self.spark, uri), f"{uri}/data/{uuid.uuid4().hex}"
        m = folder.manifest(max(folder.versions()))
        old = Index.load(self.spark, uri, self.mapping, m["generation"], self.analyzers)
        segment = self._segment(data, changed)
        ids = self.spark.read.schema(CHANGED).parquet(segment["changed"]).select("doc_id")
        gone_terms, gone_stats = old._share(ids, [s.get("analysis") for s in m["segments"]], f"{data}/gone")
        less = lambda df, *names: df.select(*(c for c in df.columns if c not in names), *((-F.col(c)).alias(c) for c in names))
        terms = sums([old.terms, self.terms, less(gone_terms, "df")], ["field", "term"], ["df"], "df")
        stats = sums([old.stats, self.stats, less(gone_stats, "doc_count", "sum_len")], ["field", "shard_id"], ["doc_count", "sum_len"], "doc_count")
        generation = self._commit(folder, self.mapping, data, terms, stats, [*m["segments"], segment], token)
        Folder(self.spark, data).delete("gone")
        return generation

    def _share(self, ids: DataFrame, analyses: list[str | None], path: str) -> tuple[DataFrame, DataFrame]:
        """What documents add to the dictionary and the statistics. Their texts, if stored, are analysed again, which moves less
        than to look for their ids in all postings; but only by the analysis that they were indexed by."""
        gone = self.docs.join(ids, "doc_id", "left_semi")
        mapped = [f for f in self.mapping.fields if f.name in self.docs.columns]
        if any(not f.stored for f in self.mapping.fields) or set(analyses) != {analysis(self.mapping, self.analyzers)}:
            postings = self.postings.join(ids, "doc_id", "left_semi")
            return dictionary(postings), statistics(postings, gone)
        blocks.shares(gone.select("doc_id", "shard_id", *(f.name for f in mapped)), mapped, self.analyzers).write.parquet(path)
        made = self.spark.read.parquet(path)
        stats = made.where("term is null").groupBy("field", "shard_id").agg(F.sum("doc_count").alias("doc_count"), F.sum("sum_len").alias("sum_len"))
        return made.where("term is not null").groupBy("field", "term").agg(F.sum("df").alias("df")), stats.unionByName(everything(gone))

    @staticmethod
    def known(spark: SparkSession, uri: str) -> tuple[DataFrame, int]:
        """(doc_id, version, seq) of the newest that the newest generation has seen of each document, and its segments."""
        folder = Folder(spark, uri)
        segments = folder.manifest(max(folder.versions()))["segments"]
        rows = spark.read.schema(CHANGED).parquet(*(s["changed"] for s in segments))
        newest = rows.groupBy("doc_id").agg(F.max(F.struct("version", "seq")).alias("v"))
        return newest.select("doc_id", "v.version", "v.seq"), len(segments)

    @classmethod
    def load(cls, spark: SparkSession, uri: str, mapping: IndexMapping, generation: int | None = None, analyzers: Registry | None = None) -> Index:
        """The newest generation, or the one named. It must be of this format and mapping."""
        folder = Folder(spark, uri)
        found = folder.versions()
        if not found or generation is not None and generation not in found:
            raise FileNotFoundError(f"no such generation in {uri}")
        m = folder.manifest(max(found) if generation is None else generation)
        if m["index"] != mapping.name:
            raise ValueError(f"{uri} holds index {m['index']!r}, not {mapping.name!r}")
        if m.get("format") != FORMAT:
            raise ValueError(f"{uri} is of format {m.get('format')}, not {FORMAT}")
        if m["mapping"] != fingerprint(mapping):
            raise ValueError(f"{uri} was built with another mapping")

        def whole(name: str) -> DataFrame:
            parts = []
            for i, s in enumerate(m["segments"]):
                later = [x["changed"] for x in m["segments"][i + 1 :]]
                df = spark.read.parquet(s[name])
                parts.append(df.join(spark.read.schema(CHANGED).parquet(*later).select("doc_id"), "doc_id", "left_anti").select(*df.columns) if later else df)
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

        return cls(mapping, analyzers or Registry(mapping.synonyms), whole("postings"), spark.read.parquet(m["terms"]), spark.read.parquet(m["stats"]), whole("docs"))

    def cached(self) -> Index:
        for t in (self.postings, self.terms, self.stats, self.docs):
            t.persist()
        return self


def analysis(mapping: IndexMapping, analyzers: Registry) -> str:
    """How an index's fields are analysed."""
    return repr([(f.name, analyzers[f.index_analyzer()]) for f in mapping.fields])


def pieces(spark: SparkSession, size: int) -> int:
    """Into how many partitions so many bytes are dealt: none grows with the input, and few bytes take few tasks."""
    return max(1, min(spark.sparkContext.defaultParallelism, size >> 20), -(-size // PIECE))


def planned_size(df: DataFrame) -> int | None:
    """Bytes that a frame reads, as far as its plan knows."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 50 else None


def in_ranges(docs: DataFrame, size: int | None = None) -> DataFrame:
    """Documents in ranges of their ids, in about equal pieces."""
    size = planned_size(docs) if size is None else size
    return docs.repartitionByRange("doc_id") if size is None else docs.repartitionByRange(pieces(docs.sparkSession, size), "doc_id")


def placed(postings: DataFrame) -> DataFrame:
    return postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")


def dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def statistics(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each term of a document's field the length is known; the first position's or, without positions, any one counts."""
    lengths = postings.select("field", "shard_id", "doc_id", "len").distinct().groupBy("field", "shard_id").agg(F.count("*").alias("doc_count"), F.sum("len").alias("sum_len"))
    return lengths.unionByName(everything(docs))


def everything(docs: DataFrame) -> DataFrame:
    """The rows of the statistics that count all documents."""
    return docs.groupBy("shard_id").agg(F.count("*").alias("doc_count")).select(F.lit(None).cast("string").alias("field"), "shard_id", "doc_count", F.lit(0).cast("long").alias("sum_len"))


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def _kind(df: DataFrame, name: str) -> T.DataType:
    kind = df.schema[name].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def text_tokens(docs: DataFrame, f: FieldMapping, analyzers: Registry) -> DataFrame:
    """doc_id, shard_id, len, term, pos of a text field. Several values follow each other, GAP positions apart."""
    analyzer, base = analyzers[f.index_analyzer()], ["doc_id", "shard_id"]
    if not _is_array(docs, f.name):
        found = docs.select(*base, analyzer.column(F.col(f.name).cast("string")).alias("ts")).where(F.size("ts") > 0)
        return found.select(*base, F.size("ts").alias("len"), F.explode("ts").alias("t")).select(*base, "len", "t.term", "t.pos")
    values = docs.select(*base, F.posexplode(F.filter(F.col(f.name).cast("array<string>"), lambda x: x.isNotNull())).alias("i", "value"))
    values = values.withColumn("ts", analyzer.column(F.col("value")))
    used = F.coalesce(F.array_max(F.transform("ts", lambda t: t["pos"])) + 1, F.lit(0)) + GAP
    own = Window.partitionBy("doc_id")
    values = values.withColumn("base", F.coalesce(F.sum(used).over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("len", F.sum(F.size("ts")).over(own))
    tokens = values.select(*base, F.col("len").cast("int").alias("len"), "base", F.explode("ts").alias("t"))
    return tokens.select(*base, "len", "t.term", (F.col("t.pos") + F.col("base")).cast("int").alias("pos"))


def value_tokens(docs: DataFrame, f: FieldMapping) -> DataFrame:
    """The same of a field that isn't text: each value is a term."""
    value = F.col(f.name) if _is_array(docs, f.name) else F.array(f.name)
    kind = _kind(docs, f.name)
    terms = F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: term_form(f, typed(f, x, kind)))
    found = docs.select("doc_id", "shard_id", terms.alias("ts")).where(F.size("ts") > 0)
    return found.select("doc_id", "shard_id", F.size("ts").alias("len"), F.posexplode("ts").alias("pos", "term")).select("doc_id", "shard_id", "len", "term", "pos")


def build(docs: DataFrame, mapping: IndexMapping, analyzers: Registry | None = None, path: str | None = None, routed: bool = False, ranged: bool = False) -> Index:
    """Index tables of docs: doc_id, the mapped fields (values or arrays), and perhaps acl (array of groups) and routing, or
    shard_id if they are routed already (then their ids are distinct); they may lie in ranges of their ids already.

    With a path, documents and postings are written there: first documents in ranges of their ids, then from these the blocks
    of their postings, so texts are analysed once, then the postings in their order; the rest is derived from what was written.
    Without one, or where ids repeat, documents are dealt by id before they are analysed, so that their tokens are summed up
    where they are made.
    """
    analyzers = analyzers or Registry(mapping.synonyms)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    docs = docs if "acl" in docs.columns else docs.withColumn("acl", F.array().cast("array<string>"))
    key = F.coalesce("routing", "doc_id") if "routing" in docs.columns else F.col("doc_id")
    docs = docs if routed else docs.withColumn("shard_id", shard_of(key, mapping.shards))
    mapped = [f for f in mapping.fields if f.name in docs.columns]

    columns = ["doc_id", "shard_id", "acl"]
    for f in mapped:
        kind, many = _kind(docs, f.name), _is_array(docs, f.name)
        values = F.filter(F.col(f.name) if many else F.array(f.name), lambda x: x.isNotNull())
        if f.stored:
            columns.append(F.col(f.name))
        if f.doc_values and f.numeric:
            columns.append(number_form(f, typed(f, F.get(values, F.lit(0)), kind)).alias(f"{f.name}__num"))
        elif f.doc_values:
            columns.append(values.cast("array<string>").alias(f"{f.name}__kw"))

    if not path:
        docs = docs.repartition("doc_id")
        postings = _plain(docs, mapped, analyzers)
        return Index(mapping, analyzers, postings, dictionary(postings), statistics(postings, docs), docs.select(*columns))

    spark, raw, home = docs.sparkSession, f"{path}/raw", f"{path}/postings"
    table = docs.select(*columns)
    (table if ranged else in_ranges(table)).sortWithinPartitions("doc_id").write.parquet(f"{path}/docs")
    table = spark.read.parquet(f"{path}/docs")
    read = table if all(f.stored for f in mapped) else docs
    again = not routed and not table.groupBy("doc_id").count().where("count > 1").isEmpty()
    if again:
        _plain(read.repartition("doc_id"), mapped, analyzers).write.parquet(raw)
        placed(spark.read.parquet(raw)).write.parquet(home)
    else:
        n, mapped = pieces(spark, Folder(spark, f"{path}/docs").size()), sorted(mapped, key=lambda f: f.name)
        bounds = blocks.sampled_bounds(read, mapped, analyzers, n)
        blocks.packed(read, mapped, analyzers, bounds).write.parquet(raw)
        made = spark.read.parquet(raw)
        blocks.rows(made, mapped, len(bounds) + 1).write.parquet(home)
    postings = spark.read.parquet(home)
    stats = statistics(postings, table) if again else blocks.measured(made).unionByName(everything(table))
    stats.coalesce(1).write.parquet(f"{path}/stats")  # a row for each field and shard
    Folder(spark, path).delete("raw")
    return Index(mapping, analyzers, postings, dictionary(postings), spark.read.parquet(f"{path}/stats"), table, path)


def _plain(docs: DataFrame, fields: list[FieldMapping], analyzers: Registry) -> DataFrame:
    """Postings of documents that are dealt by id."""

    def field_postings(f: FieldMapping) -> DataFrame:
        tokens = text_tokens(docs, f, analyzers) if f.type is FieldType.TEXT else value_tokens(docs, f)
        positions = F.sort_array(F.collect_list("pos")) if f.positions else F.lit(None).cast("array<int>")
        return tokens.groupBy("doc_id", "shard_id", "len", "term").agg(F.count("*").cast("int").alias("tf"), positions.alias("positions")).select(F.lit(f.name).alias("field"), "term", "doc_id", "shard_id", "tf", "len", "positions")

    return reduce(DataFrame.unionByName, map(field_postings, fields))


__all__ = ["Index", "build", "number_text"]
