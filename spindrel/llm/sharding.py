"""Sharding by size-tiered compaction: small immutable shards, merges of similarly sized ones, versioned manifests.

A store is a folder with `data/` (Parquet shards, never changed once written) and `manifest-<version>.json` files. A manifest
names the shards of its version; what no manifest names doesn't exist for readers, so whatever a lost task or a failed
commit leaves behind is harmless until vacuum() removes it.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import open_fs

MB = 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


def whole(batch: pa.RecordBatch, kind: pa.Schema) -> pa.RecordBatch:
    """The batch with all columns of kind; those it doesn't have are null."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    return pa.RecordBatch.from_arrays([batch.column(at[f.name]).cast(f.type) if f.name in at else pa.nulls(batch.num_rows, f.type) for f in kind], schema=kind)


class CommitConflict(RuntimeError):
    """Another writer has committed the same version first."""


def tier(size: int, smallest: int, fanout: int) -> int:
    """0 up to smallest, then one more for each factor of fanout."""
    return 0 if size <= smallest else math.ceil(math.log(size / smallest, fanout) - 1e-9)


def plan_merges(shards: list[Shard], target: int, fanout: int = 4, smallest: int = 4 * MB) -> list[list[Shard]]:
    """Groups of shards of one tier to merge. Shards of 3/4 of the target or more are left alone.

    A tier that holds a target's worth is merged into groups of about the target at once, so that data isn't rewritten tier
    by tier; what is left of a tier is merged as soon as it has fanout shards, and otherwise waits for more arrivals.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < 0.75 * target:
            tiers.setdefault(tier(s.bytes, smallest, fanout), []).append(s)
    merges = []
    for _, some in sorted(tiers.items()):
        group, size = [], 0
        for s in sorted(some, key=lambda s: (s.bytes, s.path)):
            if group and size + s.bytes > 1.1 * target:
                merges.append(group)
                group, size = [], 0
            group, size = [*group, s], size + s.bytes
        if size >= 0.75 * target or len(group) >= fanout:
            merges.append(group)
    return [g for g in merges if len(g) > 1]


def merged_schema(old: str | None, new: T.StructType) -> str:
    """The columns of a store after rows of another schema have arrived: those that are new come last, all may be null. A
    column whose type has changed is an error."""
    fields = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(old)).fields} if old else {}
    for f in new.fields:
        if fields.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].simpleString()} in the store, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(n, t) for n, t in fields.items()]).json()


class ShardStore:
    """Writers append, compact and commit; readers see the newest version or one they name."""

    def __init__(self, spark: SparkSession, uri: str, target: int = 128 * MB, fanout: int = 4, smallest: int = 4 * MB, shard_rows: int = 2000):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.target, self.fanout, self.smallest, self.shard_rows = target, fanout, smallest, shard_rows
        fs, place = open_fs(self.uri)
        fs.create_dir(place, recursive=True)

    def versions(self) -> list[int]:
        fs, place = open_fs(self.uri)
        names = (f.base_name for f in fs.get_file_info(pa.fs.FileSelector(place)))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        fs, place = open_fs(f"{self.uri}/manifest-{version:010d}.json")
        with fs.open_input_stream(place) as f:
            found = json.loads(f.read())
        return found | {"shards": [Shard(**s) for s in found["shards"]]}

    def commit(self, base: dict, shards: list[Shard], schema: str) -> dict:
        """Makes `shards` the version after base's, or raises CommitConflict: a complete file is renamed to its version's name,
        which the file system refuses if the name is taken."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]}
        fs, place = open_fs(own := f"{self.uri}/tmp-{uuid.uuid4().hex}.json")
        with fs.open_output_stream(place) as f:
            f.write(json.dumps(new).encode())
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        source, to = path(own), path(f"{self.uri}/manifest-{new['version']:010d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, to, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete_file(place)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e) or new["version"] in self.versions():
                raise CommitConflict(f"version {new['version']} is taken") from e
            raise
        return new | {"shards": shards}

    def _change(self, change) -> dict:
        """Commits change(manifest) -> (shards, schema) or None; where another writer was first, once more on its version."""
        for _ in range(20):
            base = self.manifest()
            found = change(base)
            if found is None:
                return base
            try:
                return self.commit(base, *found)
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.uri} keeps changing")

    def append(self, df: DataFrame) -> dict:
        """Adds df's rows as new small shards, of at most shard_rows rows each, and commits. What has been written stays good
        if others commit meanwhile. Columns that the store doesn't have yet are null in what was there before."""
        merged_schema(self.manifest()["schema"], df.schema)
        folder = f"{self.uri}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.shard_rows).parquet(folder)
        fs, place = open_fs(folder)
        paths = [f"{folder}/{f.base_name}" for f in fs.get_file_info(pa.fs.FileSelector(place)) if f.base_name.endswith(".parquet")]
        new = [s for s in self._described(paths) if s.rows]
        return self._change(lambda base: (base["shards"] + new, merged_schema(base["schema"], df.schema)))

    def _described(self, paths: list[str]) -> list[Shard]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for uri in b.column("path").to_pylist():
                    fs, place = open_fs(uri)
                    with fs.open_input_file(place) as f:
                        rows.append((uri, pq.read_metadata(f).num_rows, f.size()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "rows", "bytes"])

        return self._in_tasks([(p,) for p in paths], "path string", run) if paths else []

    def _in_tasks(self, rows: list[tuple], kind: str, run) -> list[Shard]:
        """A row a task, a Shard from each row; only names and sizes of shards pass through the driver."""
        df = self.spark.createDataFrame(rows, kind)
        out = df.repartition(max(1, min(len(rows), 4 * self.spark.sparkContext.defaultParallelism if kind == "path string" else len(rows))))
        return [Shard(r["path"], r["rows"], r["bytes"]) for r in out.mapInArrow(run, "path string, rows long, bytes long").collect()]

    def compact(self) -> dict:
        """Merges until no tier has anything to merge, with a commit after each round; returns the newest manifest. A round
        whose shards another writer has merged first is given up; arrivals of others meanwhile don't matter.

        A task merges one group, streaming row groups from its shards to a new file whose name holds the task attempt.
        """
        now = self.manifest()
        while merges := plan_merges(now["shards"], self.target, self.fanout, self.smallest):
            folder = f"{self.uri}/data/{uuid.uuid4().hex}"
            block = 16 * MB

            def run(batches: Iterator[pa.RecordBatch], folder: str = folder) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for group, paths in zip(b.column("merge").to_pylist(), b.column("paths").to_pylist(), strict=True):
                        out = f"{folder}/{group:06d}-{TaskContext.get().taskAttemptId()}.parquet"
                        fs, place = open_fs(out)
                        fs.create_dir(place.rpartition("/")[0], recursive=True)
                        held, size, n = [], 0, 0
                        opened = [(lambda x: x[0].open_input_file(x[1]))(open_fs(uri)) for uri in paths]
                        kind = pa.unify_schemas([pq.read_schema(f) for f in opened])
                        with pq.ParquetWriter(place, kind, filesystem=fs, compression="snappy") as writer:
                            for f in opened:
                                f.seek(0)
                                for batch in pq.ParquetFile(f).iter_batches(1024):
                                    held.append(whole(batch, kind))
                                    size, n = size + batch.nbytes, n + batch.num_rows
                                    if size >= block:
                                        writer.write_table(pa.Table.from_batches(held))
                                        held, size = [], 0
                                f.close()
                            if held:
                                writer.write_table(pa.Table.from_batches(held))
                        yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([n]), pa.array([fs.get_file_info(place).size])], ["path", "rows", "bytes"])

            made = self._in_tasks([(i, [s.path for s in g]) for i, g in enumerate(merges)], "merge int, paths array<string>", run)
            gone = {s.path for g in merges for s in g}
            now = self._change(lambda base: ([s for s in base["shards"] if s.path not in gone] + made, base["schema"]) if gone <= {s.path for s in base["shards"]} else None)
        return now

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        paths = [s.path for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest `keep` manifests and every shard they don't name; returns how many shards went."""
        fs, place = open_fs(self.uri)
        for v in self.versions()[:-keep]:
            fs.delete_file(f"{place}/manifest-{v:010d}.json")
        named = {s.path.rpartition(f"{self.uri}/")[2] for v in self.versions() for s in self.manifest(v)["shards"]}
        gone = 0
        for f in fs.get_file_info(pa.fs.FileSelector(f"{place}/data", recursive=True, allow_not_found=True)):
            if f.type == pa.fs.FileType.File and f.path.rpartition(f"{place}/")[2] not in named:
                fs.delete_file(f.path)
                gone += f.path.endswith(".parquet")
        return gone


def compacted(docs: DataFrame, uri: str, arrivals: int = 4, **sizes: int) -> DataFrame:
    """docs, appended to a new store at uri in several arrivals of small shards, compacted after each, what is no longer named
    removed, and read from the newest version.

    An arrival has the rows with one remainder of a hash of all their columns that can be hashed, so equal rows arrive
    together. Columns, nulls, repeated rows and very long texts stay as they are, whatever the columns' names, nested ones
    too; an empty table gives an empty one.
    """
    store = ShardStore(docs.sparkSession, uri, **sizes)
    names = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.NumericType | T.StringType)]
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64(*names), F.lit(arrivals)) == k) if names else docs.where(F.lit(k == 0)))
        store.compact()
        store.vacuum(keep=1)
    return store.read()
