"""Incremental indexing: the document log as a stream, each batch published as a segment of a new generation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import Registry
from ..sources.files import Folder
from ..sources.index import Index, build, in_ranges
from ..sources.store import DocumentStore, newest

#: An index of so many segments is built anew as one.
MOST_SEGMENTS = 8


class ChangeFeed:
    """Reads what the log has gained since the checkpoint, and publishes an index of the newest live documents.

    A batch becomes a segment of the documents that it changes; the others aren't touched. Every so many batches the whole
    log is indexed anew. Spark's checkpoint holds the place in the log and is moved on after a batch, so a batch may be seen
    twice; rows that aren't newer than what the index knows of their documents are left out, so a second time changes nothing,
    and batches that come late don't bring back what is older. Searches that run keep the generation they were started on.
    """

    def __init__(self, store: DocumentStore, index_uri: str, checkpoint: str, files_per_batch: int = 1000, analyzers: Registry | None = None):
        self.store, self.index_uri, self.checkpoint, self.files_per_batch, self.analyzers = store, index_uri, checkpoint, files_per_batch, analyzers
        self.batches: list[int] = []

    def _built(self, rows: DataFrame, ranged: bool = False) -> Index:
        path = f"{self.index_uri}/data/{uuid.uuid4().hex}"
        return build(rows.where("not deleted").drop("deleted", "version", "seq"), self.store.mapping, self.analyzers, path, routed=True, ranged=ranged)

    def publish(self, batch: DataFrame | None = None, number: int = 0) -> None:
        """A batch of the log, or without one the whole log."""
        changed = ("doc_id", "version", "seq", "deleted")
        if batch is None or not Folder(self.store.spark, self.index_uri).versions():
            if batch is not None and batch.isEmpty():
                return
            rows = newest(in_ranges(self.store.log()))  # each document's versions are in one range of ids, and the newest stay there
            self._built(rows, ranged=True).save(self.index_uri, str(number), rows.select(*changed))
        else:
            known, segments = Index.known(self.store.spark, self.index_uri)
            seen = known.select("doc_id", F.struct("version", "seq").alias("seen"))
            rows = newest(batch).join(seen, "doc_id", "left").where(F.col("seen").isNull() | (F.struct("version", "seq") > F.col("seen"))).drop("seen").persist()
            try:
                if rows.isEmpty():
                    return
                if segments >= MOST_SEGMENTS:
                    self.publish(None, number)
                    return
                self._built(rows).append(self.index_uri, rows.select(*changed), str(number))
            finally:
                rows.unpersist()
        self.batches.append(number)

    def start(self, available_now: bool = True, interval: str = "5 seconds") -> StreamingQuery:
        """available_now drains the log and ends; otherwise batches follow each other at the interval."""
        log = self.store.spark.readStream.schema(self.store.schema()).option("maxFilesPerTrigger", self.files_per_batch).parquet(self.store.log_uri)
        writer = log.writeStream.foreachBatch(self.publish).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

    def drain(self) -> None:
        self.start().awaitTermination()
