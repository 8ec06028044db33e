"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Pieces gather until they fill so many windows; then they are packed. It bounds a worker's memory.
BATCH_WINDOWS = 64


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k parts with nearly equal sums.

    Each size starts as a partial partition: its own part and k - 1 empty ones. The two partial partitions with the
    largest imbalance are merged, the largest part of one with the smallest of the other and so on, until one is left.
    A partial partition is its parts in falling order as (sum, items), empty ones left out.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-s if k > 1 else 0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            parts = a + b
        else:
            first, last = k - len(b), len(a)
            parts = a[:first] + [(a[i][0] + b[k - 1 - i][0], (a[i][1], b[k - 1 - i][1])) for i in range(first, last)] + [b[k - 1 - i] for i in range(last, k)]
        parts.sort(key=lambda p: -p[0])
        n += 1
        heapq.heappush(heap, ((parts[-1][0] if len(parts) == k else 0) - parts[0][0], n, parts))
    out = []
    for _, items in heap[0][2]:
        flat, stack = [], [items]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                flat.append(x)
        out.append(flat)
    return out + [[] for _ in range(k - len(out))]


def whole_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of whole pieces: the fewest the sum allows, and one more as long as the fullest exceeds capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


Piece = tuple[int, int, int]  # a document's number, first id, ids


def full_windows(pieces: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows of exactly capacity ids, and pieces that don't fill another.

    The pieces are differenced into as many windows as they fill. A window that exceeds capacity is cut there, and what is
    cut off, with the pieces of windows below capacity, goes into further windows: the count rises until less than one
    window is left. Since the windows are nearly equal, little is cut.
    """
    done: list[list[Piece]] = []
    while (k := sum(p[2] for p in pieces) // capacity) > 0:
        rest: list[Piece] = []
        for w in differencing([p[2] for p in pieces], k):
            window = sorted((pieces[i] for i in w), key=lambda p: p[2])
            over = sum(p[2] for p in window) - capacity
            if over < 0:
                rest += window
                continue
            while over:
                doc, start, n = window.pop()
                cut = min(n, over)
                over -= cut
                rest.append((doc, start + n - cut, cut))
                if n > cut:
                    window.append((doc, start, n - cut))
            done.append(window)
        pieces = rest
    return done, pieces


def power_windows(pieces: list[Piece]) -> list[list[Piece]]:
    """The rest in windows whose sizes are its powers of two, largest first; such windows need no padding."""
    out: list[list[Piece]] = []
    total, queue = sum(p[2] for p in pieces), sorted(pieces, key=lambda p: p[2])
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        window: list[Piece] = []
        while room:
            doc, start, n = queue.pop()
            take = min(n, room)
            window.append((doc, start, take))
            room -= take
            if n > take:
                queue.append((doc, start + take, n - take))
        out.append(window)
    return out


FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = pa.schema([(f, pa.int64()) for f in FIELDS])


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; see FIELDS.

    A document's whole windows become sequences as they are; what is left of it is packed with others' of its partition,
    BATCH_WINDOWS windows' worth at a time, so nothing is shuffled and a worker holds little. What doesn't fill a window
    goes on to the next batch, and at the end of the partition into windows of powers of two. A sequence's id is made from
    the partition's number, so a task that is run again gives the same rows.

    Null text counts as empty (just the end id), a null doc_id stays null, rows with one doc_id are packed one by one, an
    empty table gives no row, other columns are ignored.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = encoder(vocabulary_path), TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}  # number: doc_id, tokens, first id held, bytes from there
        pieces: list[Piece] = []
        rows: list[tuple] = []
        waiting = number = 0

        def emit(window: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, n in window:
                doc_id, tokens, first, data = held[doc]
                rows.append((doc_id, start, n, zlib.crc32(data[4 * (start - first) : 4 * (start - first + n)]), tokens, sequence, at))
                at += n
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=SCHEMA)
            rows.clear()
            return out

        for b in batches:
            for doc_id, data in zip(b.column("doc_id").to_pylist(), words.encode_many(b.column("text").to_pylist()), strict=True):
                data += end
                n = len(data) // 4
                whole = n - n % capacity
                for s in range(0, whole, capacity):
                    rows.append((doc_id, s, capacity, zlib.crc32(data[4 * s : 4 * (s + capacity)]), n, sequence, 0))
                    sequence += 1
                if n > whole:
                    held[number] = (doc_id, n, whole, data[4 * whole :])
                    pieces.append((number, whole, n - whole))
                    waiting += n - whole
                    number += 1
                if waiting >= BATCH_WINDOWS * capacity:
                    windows, pieces = full_windows(pieces, capacity)
                    for w in windows:
                        emit(w)
                    held = {doc: held[doc] for doc, _, _ in pieces}
                    waiting = sum(p[2] for p in pieces)
            if rows:
                yield flush()
        windows, pieces = full_windows(pieces, capacity)
        for w in windows + power_windows(pieces):
            emit(w)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{f} long" for f in FIELDS))
