"""Approximate nearest neighbours by learned partitions: a balanced partition of a neighbour graph and a classifier that routes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Adam, share, staged

#: Rows a partition is meant to have; partitions at most; vectors that the graph and the classifier are fitted on, at most.
PARTITION_ROWS, MOST_PARTITIONS, MOST_SAMPLE = 400, 512, 16384
#: Neighbours of a vector in the graph; how far a part may exceed the mean; hidden units of the classifier.
GRAPH_K, IMBALANCE, HIDDEN = 32, 0.05, 128
#: One in so many vectors of the sample is held out of the fit; the share of their nearest neighbours that must be found.
HELD_OUT, RECALL = 8, 0.92
#: A partition with more rows than this is searched in blocks, each a task of its own.
BLOCK_ROWS = 8192


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id long, embedding) of the rows that take part: an id, and a vector without nulls or non-finite numbers that isn't zero."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & sound)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows, by brute force in blocks."""
    x = x.astype(np.float32)
    norm, out = (x * x).sum(axis=1), []
    for a in range(0, len(x), 512):
        d = norm[None, :] - 2 * (x[a : a + 512] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, k, axis=1)[:, :k].copy())  # a view would keep the whole block
    return np.concatenate(out)


def _split(x: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    """Cuts rows in two along their main direction, in proportion to the parts on each side, and again."""
    if parts == 1:
        out[rows] = first
        return
    z = x[rows] - x[rows].mean(axis=0)
    v = np.linalg.eigh(z.T @ z)[1][:, -1]
    v = v * np.sign(v[np.argmax(np.abs(v))])
    order, left = rows[np.argsort(z @ v, kind="stable")], parts // 2
    cut = len(rows) * left // parts
    _split(x, order[:cut], left, first, out)
    _split(x, order[cut:], parts - left, first + left, out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row, so that few edges of the neighbour graph are cut and no part exceeds the mean by IMBALANCE.

    It starts from balanced cuts of the vectors; then, round after round, rows in random order move to the part that most of
    their neighbours (in either direction) are in, if there is room. Where that part is full, a row changes places with one
    that wants the opposite way. It ends when few rows move.
    """
    label = np.zeros(len(x), np.int64)
    _split(x, np.arange(len(x)), parts, 0, label)
    most, size = int(np.ceil(len(x) / parts * (1 + IMBALANCE))), np.bincount(label, minlength=parts)
    both: list[list[int]] = [list(r) for r in graph]
    for i, r in enumerate(graph):
        for j in r:
            both[j].append(i)
    near = [np.array(x) for x in both]
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        moved, waiting = 0, {}
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[near[i]], minlength=parts)
            own = label[i]
            if size[to := int(np.argmax(votes))] >= most and votes[to] > votes[own]:
                if others := waiting.get((to, own)):
                    label[i], label[others.pop()] = to, own
                    moved += 2
                    continue
                waiting.setdefault((own, to), []).append(i)
            best = int(np.argmax(np.where(size < most, votes, -1)))
            if votes[best] > votes[own] and best != own and not (waiting.get((own, to)) or [None])[-1] == i:
                size[own] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) / 500:
            break
    return label


@dataclass
class Router:
    """A two-layer classifier from a vector to the probabilities of its partitions."""

    parts: int
    mean: np.ndarray
    scale: float
    layers: list[np.ndarray] = field(default_factory=list)
    #: A query goes to its most probable partitions until they hold this much probability.
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(x), 1))
        w1, b1, w2, b2 = self.layers
        z = np.maximum(np.clip(x / self.scale - self.mean / self.scale, -1e6, 1e6) @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, epochs: int = 16, batch: int = 256, rate: float = 0.004) -> Router:
    """By Adam on the cross entropy with the shares of partitions among a vector and its neighbours."""
    rng, (n, d) = np.random.default_rng(3), x.shape
    router = Router(parts, x.mean(axis=0), float(x.std()) + 1e-12)
    router.layers = [w.astype(np.float32) for w in (rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts))]
    w1, b1, w2, b2 = router.layers
    adam, z = Adam(router.layers, rate), ((x - router.mean) / router.scale).astype(np.float32)
    near = np.concatenate([np.arange(n)[:, None], graph], axis=1)
    goal = np.bincount((np.arange(n)[:, None] * parts + label[near]).ravel(), minlength=n * parts).reshape(n, parts).astype(np.float32) / near.shape[1]
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.95 * epoch / epochs)
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            h = np.maximum(z[rows] @ w1 + b1, 0)
            s = h @ w2 + b2
            s = np.exp(s - s.max(axis=1, keepdims=True))
            g = (s / s.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            gh = (g @ w2.T) * (h > 0)
            adam.step([z[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)])
    return router


def mass_before(p: np.ndarray) -> np.ndarray:
    """For each row and partition, the probability of the partitions that are more probable for that row."""
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_ = np.take_along_axis(p, order, axis=1)
    out = np.empty_like(p)
    np.put_along_axis(out, order, np.cumsum(sorted_, axis=1) - sorted_, axis=1)
    return out


def needed_mass(router: Router, x: np.ndarray, asked: np.ndarray, k: int, recall: float = RECALL) -> float:
    """How much probability the partitions of a query must hold for `recall` of its k nearest rows of x to be among them."""
    where, norm, found = router.probabilities(x).argmax(axis=1), (x * x).sum(axis=1), []
    for a in range(0, len(asked), 256):
        q = asked[a : a + 256]
        near = np.argpartition(norm - 2 * q @ x.T, min(k, len(x)) - 1, axis=1)[:, :k]
        found.append(np.take_along_axis(mass_before(router.probabilities(q)), where[near], axis=1).ravel())
    found = np.sort(np.concatenate(found))
    return float(np.nextafter(found[min(len(found) - 1, int(np.ceil(recall * len(found))))], 2))


def fitted(x: np.ndarray, n: int, k: int) -> Router:
    """A router for n vectors, from a sample x of them; the number of partitions follows n."""
    parts = min(MOST_PARTITIONS, max(round(n / PARTITION_ROWS), min(8, n // 50), 1))
    sizes = np.abs(x).max(axis=1, initial=0)
    unit = float(np.median(sizes)) if len(x) else 1.0
    x = x[sizes < 1e6 * unit] / unit  # what is far larger than most would hide how the others differ
    asked = np.arange(len(x)) % HELD_OUT == 0
    own = x[~asked]
    if parts == 1 or len(own) <= parts:
        return Router(1, np.zeros(x.shape[1]), 1.0)
    graph = neighbour_graph(own, min(GRAPH_K, len(own) - 1))
    router = train_router(own, graph, balanced_partition(own, graph, parts), parts)
    router.mass = needed_mass(router, own, x[asked], k)
    router.mean, router.scale = router.mean * unit, router.scale * unit
    return router


def fit(rows: DataFrame, n: int, dim: int, k: int) -> Router:
    """On at most about MOST_SAMPLE vectors."""
    t = rows.where(share(F.col("vec_id"), MOST_SAMPLE, n)).toArrow().sort_by("vec_id")
    return fitted(matrix(t.column("embedding"), dim), n, k)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from q, of very large and very small numbers too."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = np.abs(x - q)
        plain = np.sqrt((apart * apart).sum(axis=1))
        odd = np.flatnonzero(~((plain > 1e-140) & (plain < 1e150)))
        if len(odd):
            top = apart[odd].max(axis=1)
            scaled = apart[odd] / np.where((top > 0) & np.isfinite(top), top, 1)[:, None]
            plain[odd] = np.where(np.isfinite(top), top * np.sqrt((scaled * scaled).sum(axis=1)), np.inf)
    return plain


def best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and the ids and distances of its k nearest rows, ties by id; rows with the query's id don't count."""
    size = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    safe = 1e-60 < size < 1e60  # else squares could leave the range of a double
    norm = (x * x).sum(axis=1) if safe else None
    for a in range(0, len(q), 256):
        d = norm - 2 * (q[a : a + 256] @ x.T) if safe else None
        for i, name in enumerate(names[a : a + 256]):
            other = ids != name
            near = np.flatnonzero(other)
            if safe and len(near) > k:  # the exact distances of all that may be among the k nearest
                row = np.where(other, d[i], np.inf)
                slack = 1e-9 * size * size * x.shape[1]
                near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack)
            exact = distances(x[near], q[a + i])
            best = np.lexsort((ids[near], exact))[:k]
            yield name, ids[near][best], exact[best]


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """For each row whose vec_id `every` divides, its k nearest rows: query_id, rank from 1, vec_id, score (Euclidean distance).

    Every row is indexed in its most probable partition. A query looks through its several most probable partitions, as many
    as held-out vectors of the fit needed for a recall of RECALL, and through more as long as these have too few rows for k
    results. Distances are exact, ties go to the smaller vec_id, and a row with the query's own id is no result. A partition
    is searched in blocks of about BLOCK_ROWS rows, so copies of one vector spread over tasks; each block gives at most k
    results a query, and what a query merges is bounded.

    Rows without id or with a vector that is null, zero or not finite take no part; a vector is compared with those of its own
    length; of rows with one vec_id the one with the smallest vector is the query, and each is a candidate; a distance above
    the range of a double is infinite and comes last; an empty table gives no row; other columns are ignored.
    """
    rows = staged(valid(vectors), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    found = [searched(rows.where(F.size("embedding") == dim), n, dim, every, k) for dim, n in sorted(sizes.items())]
    found = reduce(DataFrame.unionByName, found) if found else rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(rows: DataFrame, n: int, dim: int, every: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) among n vectors of one length: what each block of a query's partitions finds nearest."""
    router = fit(rows, n, dim, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = router.probabilities(matrix(b.column("embedding"), dim)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *b.columns], ["part", "vec_id", "embedding"])

    indexed = staged(rows.mapInArrow(index, "part int, vec_id long, embedding array<double>"), "index")
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # at most MOST_PARTITIONS rows
    blocks = {p: -(-s // BLOCK_ROWS) for p, s in sizes.items()}
    held = np.array([sizes.get(p, 0) for p in range(router.parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = router.probabilities(matrix(b.column("embedding"), dim))
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.take_along_axis(mass_before(p), order, axis=1)
            rows_before = np.cumsum(held[order], axis=1) - held[order]
            wanted = ((before < router.mass) | (rows_before < 2 * k + 1)) & (held[order] > 0)
            out = [(i, int(q), blk) for i in range(len(p)) for q in order[i][wanted[i]] for blk in range(blocks[int(q)])]
            i = pa.array([o[0] for o in out], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), b.column("vec_id").take(i), b.column("embedding").take(i)], ["part", "block", "vec_id", "embedding"])

    def search(candidates, queries):
        found = [(name, *best) for name, *best in best_of(matrix(candidates.column("embedding"), dim), candidates.column("vec_id").to_numpy(), matrix(queries.column("embedding"), dim), queries.column("vec_id").to_numpy(), k)] if candidates.num_rows and queries.num_rows else []
        names = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        near, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in (1, 2))
        return pa.table({"query_id": pa.array(names), "vec_id": pa.array(near.astype(np.int64)), "score": pa.array(score.astype(np.float64))})

    spread = F.create_map(*(F.lit(v) for p, s in sorted(blocks.items()) for v in (p, s))) if blocks else F.create_map(F.lit(0), F.lit(1))
    placed = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.coalesce(spread[F.col("part")], F.lit(1))).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    routed = queries.mapInArrow(route, "part int, block int, vec_id long, embedding array<double>")
    return placed.groupBy("part", "block").cogroup(routed.groupBy("part", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
