"""Token-id output in a file format of its own: fixed-width bit packing in blocks.

A file: blocks of BLOCK ids (the last one shorter), each id in `bits` bits, least significant bit first, every block padded
to whole bytes; then the index: document ids (int64), ids before each document (uint64, one more than documents), block
offsets (uint64, one more than blocks), a bit for each document that says whether its id is null; then a trailer of seven little-endian uint64: documents, ids, blocks, bits, ids a
block, version, magic. Readers start from the trailer, so a writer never holds more than a block and the index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, scratch, staged
from .tokens import encoder

BLOCK, VERSION, MAGIC, TRAILER = 1 << 14, 2, int.from_bytes(b"spnTokB1", "little"), 7 * 8


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.held, self.n_held, self.at = [], 0, 0
        self.doc_ids, self.starts, self.offsets, self.nulls = [], [0], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(self.n_held - self.n_held % self.block)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for k in range(0, upto, self.block):
            data = pack(ids[k : min(upto, k + self.block)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(self.n_held)
        self.out.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes() + np.packbits(np.array(self.nulls, bool), bitorder="little").tobytes())
        self.out.write(np.array([len(self.doc_ids), self.starts[-1], len(self.offsets) - 1, self.bits, self.block, VERSION, MAGIC], "<u8").tobytes())


class Reader:
    """Random access to a file of Writer's; `source` has size(), seek() and read()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - TRAILER)
        self.n_docs, self.n_ids, n_blocks, self.bits, self.block, version, magic = map(int, np.frombuffer(source.read(TRAILER), "<u8"))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        numbers = 8 * (self.n_docs + self.n_docs + 1 + n_blocks + 1)
        index = numbers + -(-self.n_docs // 8)
        source.seek(size - TRAILER - index)
        data = source.read(index)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, 8 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, 8 * (2 * self.n_docs + 1)).astype(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(data, np.uint8, offset=numbers), bitorder="little", count=self.n_docs).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, whatever documents they belong to."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            part = data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]]
            out.append(unpack(part, min(self.block, self.n_ids - b * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int, to: str) -> DataFrame:
    """Writes docs as token files below `to` in ascending doc_id order; returns the manifest (shard, path, n_docs, n_ids).

    The table is dealt by ranges of doc_id, one file a task. A file's name holds the task attempt, and only the attempt
    whose row reaches the manifest counts, so a repeated or lost task leaves at worst a file that nothing names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        words, writer, n_docs = encoder(vocabulary_path), None, 0
        bits, end = bits_for(words.vocabulary), np.array([end_id], "<u4")
        path = f"{to}/{context.partitionId():08d}-{context.taskAttemptId()}.tok"
        out = None
        for b in batches:
            if b.num_rows and writer is None:
                fs, place = open_fs(path)
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(place)
                writer = Writer(out, bits)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), words.encode_many(b.column("text").to_pylist()), strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                n_docs += 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [writer.starts[-1]]}, MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return staged(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "token-manifest")


MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files that a manifest names: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, place = open_fs(path)
                with fs.open_input_file(place) as source:
                    r, k = Reader(source), 0
                    while k < r.n_docs:  # about a million ids at once, or one longer document
                        end = max(k + 1, int(np.searchsorted(r.starts, r.starts[k] + (1 << 20), "right")) - 1)
                        ids, s = r.ids(int(r.starts[k]), int(r.starts[end])).tobytes(), r.starts[k : end + 1]
                        crc = [zlib.crc32(ids[4 * (a - s[0]) : 4 * (z - s[0])]) for a, z in zip(s[:-1], s[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[k:end], mask=r.nulls[k:end]), pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(crc, pa.int64())], schema=DIGEST)
                        k = end

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "base")
    # With a number of its own, the exchange isn't folded into a few tasks; a file is read by one.
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary_path: str, end_id: int = 2) -> DataFrame:
    """Encodes docs, writes them below the shared folder and reads them back; see write_tokens and read_digests.

    Null text counts as empty (just the end id); a null doc_id comes first and stays null, and no other id does; rows with
    one doc_id are put in order of a hash of their texts; an empty table gives no file and no row; other columns are ignored.
    """
    return read_digests(write_tokens(docs, vocabulary_path, end_id, scratch(docs.sparkSession, "tokens")))
