"""Versioned manifests in a folder of any file system that Spark reaches: written whole, then renamed, never replaced."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """The version is taken."""


class Folder:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri, self.jvm = spark, uri.rstrip("/"), spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.uri))

    def versions(self) -> list[int]:
        names = (f.getPath().getName() for f in self.fs.listStatus(self.path(self.uri)))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _name(self, version: int) -> str:
        return f"{self.uri}/manifest-{version:010d}.json"

    def manifest(self, version: int) -> dict:
        stream = self.fs.open(self.path(self._name(version)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def size(self) -> int:
        """Bytes of all files below."""
        return self.fs.getContentSummary(self.path(self.uri)).getLength()

    def delete(self, name: str) -> None:
        """A file or folder below this one."""
        self.fs.delete(self.path(f"{self.uri}/{name}"), True)

    def take(self) -> int:
        """A number that no other writer gets, above all taken before. The files of some last numbers stay."""
        while True:
            found = self.versions()
            version = max(found, default=0) + 1
            try:
                self.commit(version, {})
            except Conflict:
                continue
            for old in found[:-8]:
                self.fs.delete(self.path(self._name(old)), False)
            return version

    def commit(self, version: int, content: dict) -> None:
        own = self.path(f"{self.uri}/tmp-{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(own, self.path(self._name(version)), self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(own, False)
            if version in self.versions():
                raise Conflict(f"version {version} of {self.uri} is taken") from e
            raise
