"""Quality scores: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, fold, mix64, only, sigmoid, with_scores
from .labels import training_texts

#: Word slots (words share a slot by hash), vector length, non-zeros of an index vector, words to each side of a context.
SLOTS, DIM, NONZERO, REACH = 8192, 32, 2, 2
#: Bound of the fitted sample; hidden units.
MOST_LABELLED, HIDDEN = 12000, 32
_PIECE = re.compile(r"[^\W_]+|[\W_]")
_MEMORY = 300_000
#: Slots in a block of sums, and blocks that one group sums up.
_BLOCK, FAN_IN = 512, 64


class Slots(dict):
    """White-space-free chunk (bytes) to the slots of its words, as little-endian uint16 bytes.

    A chunk gives its words in lower case and its other characters one by one; a word of several capitals has a mark before
    it. So shouting, symbols and separators are words with vectors like others.
    """

    def __missing__(self, chunk: bytes) -> bytes:
        out = []
        for piece in _PIECE.findall(chunk.decode()):
            if len(piece) > 1 and piece.isupper():
                out.append("\x00capitals")
            out.append(piece.lower())
        got = np.array([xxhash.xxh3_64_intdigest(x) % SLOTS for x in out], "<u2").tobytes()
        if len(self) >= _MEMORY:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").encode().split())), "<u2")


_slots = Slots()


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each slot's few non-zeros."""
    h = mix64(np.arange(SLOTS * NONZERO, dtype=np.uint64), 3).reshape(SLOTS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)


def add_contexts(total: np.ndarray, ids: np.ndarray, breaks: np.ndarray) -> None:
    """Adds, to each word's vector, the index vectors of the words up to REACH before and after it in the same text.

    ids: the texts' words one after another; breaks: the number of the text of each.
    """
    places, signs = index_vectors()
    for gap in range(1, REACH + 1):
        a, b = ids[:-gap], ids[gap:]
        same = breaks[:-gap] == breaks[gap:]
        a, b = a[same].astype(np.int64), b[same].astype(np.int64)
        for word, context in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += np.bincount(word * DIM + places[context, k], weights=signs[context, k], minlength=SLOTS * DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """SLOTS x DIM vectors, from the words of all documents.

    A task sums what its texts add in one array, which it gives out in blocks of slots; blocks are summed FAN_IN at a time, in
    as many rounds as the number of tasks needs. The result has a fixed size, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        total, any_row = np.zeros(SLOTS * DIM), False
        for b in batches:
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):  # about a million words at once
                some, lengths = [], []
                while at < len(texts) and sum(lengths) < 1 << 20:
                    some.append(_slots.of(texts[at]))
                    lengths.append(len(some[-1]))
                    at += 1
                add_contexts(total, np.concatenate(some), np.repeat(np.arange(len(some)), lengths))
                any_row = True
        if any_row:
            part = TaskContext.get().partitionId()
            blocks = total.reshape(-1, _BLOCK * DIM)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in blocks], pa.binary())], ["block", "part", "sums"])

    def add(key, t):
        total = np.zeros(_BLOCK * DIM)
        for x in t.column("sums"):
            total += np.frombuffer(x.as_buffer(), "<f8")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, part int, sums binary"
    parts = docs.select("text").mapInArrow(run, kind)
    tasks = docs.select("text").rdd.getNumPartitions()  # planned, not run
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(add, kind)
    out = np.zeros((SLOTS, DIM))
    for r in parts.groupBy("block").applyInArrow(add, kind).collect():  # SLOTS / _BLOCK rows
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["sums"], "<f8").reshape(_BLOCK, DIM)
    out -= out.mean(axis=0) * (np.abs(out).sum(axis=1, keepdims=True) > 0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A document's features: its words' mean vector, that of its distinct words, their spread, and how words repeat."""
    if not len(ids):
        return np.zeros(3 * DIM + 6, np.float32)
    counts = np.bincount(ids, minlength=SLOTS)
    kinds = np.flatnonzero(counts)
    share = counts[kinds] / len(ids)
    v = vectors[kinds]
    mean, even = share @ v, v.mean(axis=0)
    spread = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    next_same = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
    third_same = float((ids[2:] == ids[:-2]).mean()) if len(ids) > 2 else 0.0
    return np.concatenate([mean, even, spread, [np.log1p(len(ids)), len(kinds) / len(ids), share.max(), next_same, third_same, float(np.linalg.norm(mean))]]).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x).astype(np.float64) / self.temperature)


def train(model: Model, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.004, l2: float = 1e-4) -> None:
    """Two layers (tanh, then one logit) by Adam on the log loss."""
    rng = np.random.default_rng(11)
    d = x.shape[1]
    model.layers = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    w1, b1, w2, b2 = model.layers
    adam, z = Adam(model.layers, rate), (x - model.mean) / model.scale
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(z))
        for k in range(0, len(z), batch):
            xb, yb = z[order[k : k + batch]], y[order[k : k + batch]]
            h = np.tanh(xb @ w1 + b1)
            g = (sigmoid(h @ w2 + b2[0]) - yb) / len(xb)
            gh = g[:, None] * w2 * (1 - h * h)
            adam.step([xb.T @ gh + l2 * w1, gh.sum(axis=0), h.T @ g + l2 * w2, np.array([g.sum()])])


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature that gives the least log loss on rows the network wasn't trained on, of a fixed grid."""
    z = model.logits(x).astype(np.float64)
    losses = []
    for t in (grid := np.geomspace(0.25, 8, 61)):
        p = np.clip(sigmoid(z / t), 1e-9, 1 - 1e-9)
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Vectors from all documents; the network from at most about MOST_LABELLED labelled texts of folds 2 to 4, the
    temperature from those of fold 1. Without labels the model gives every text the share of good labels, or 0.5."""
    vectors = word_vectors(docs)
    texts = training_texts(docs, labels, "quality", MOST_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(vectors, _slots.of(t)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("label"), pa.array(x, pa.binary())], ["fold", "label", "x"])

    rows = texts.select(fold("doc_id").cast("int").alias("fold"), "label", "text").mapInArrow(run, "fold int, label int, x binary").toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in rows["x"]]).reshape(len(rows), 3 * DIM + 6).astype(np.float64)
    order = np.lexsort((*x.T[:4], rows["label"], rows["fold"])) if len(rows) else []
    x, y, folds = x[order], rows["label"].to_numpy(float)[order], rows["fold"].to_numpy(int)[order]
    model = Model(vectors, x.mean(axis=0) if len(x) else np.zeros(3 * DIM + 6), x.std(axis=0) + 1e-3 if len(x) else np.ones(3 * DIM + 6))
    if len(set(y)) < 2:
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        model.layers = [np.zeros((3 * DIM + 6, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(p / (1 - p))])]
        return model
    own = folds != 1 if len(set(y[folds != 1])) == 2 else np.ones(len(y), bool)
    train(model, x[own], y[own])
    if (folds == 1).any():
        calibrate(model, x[folds == 1], y[folds == 1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, 0 to 1. Null text counts as empty; every other column stays, but an own column `score` is replaced."""
    return with_scores(docs, lambda texts: model.scores(np.array([pooled(model.vectors, _slots.of(t)) for t in texts]).reshape(len(texts), 3 * DIM + 6)))


#: A text is good from this probability on.
GOOD = 0.3


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= GOOD).

    Labels are learnt from folds 1 to 4. A null doc_id is not held out; rows with one doc_id or text are scored one by one;
    rows without text score as the empty text; an empty table gives no row.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
