"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct word n-grams. All sets are put in one global order of tokens, rare ones first. Two
sets of sizes x and y with Jaccard similarity t or more share at least o = ceil(t / (1 + t) * (x + y)) tokens; so for any l,
their first x - o + l and y - o + l tokens share at least l. A document's prefix is as long as any partner may need, and it
is lengthened by l - 1 tokens, l being chosen by what its candidates are estimated to cost; a pair must then share l tokens
(the smaller l of the two) within its prefixes before its whole sets are compared.

Large groups of near copies would make a pair of every two. So pairs aren't made of groups: the rows of a token are compared
inside a task, block by block, by sizes, places and sketches, and of the pairs that pass, a task gives out a spanning forest
only, fewer pairs than rows. Where all pairs of a forest turn out to be links, nothing else in its group can matter. Where one
doesn't, the group is looked at again with what is connected by then, for pairs between different components alone.

A sketch has the parities of the tokens' hashes. Two sketches differ in at most as many bits as the sets differ in tokens, so a
pair whose sketches differ more has no link. Rows carry a short one; a pair that passes it is held against sketches of about
a bit for each token. The few pairs left have their whole sets fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, only, staged
from .components import components

#: Tokens that get a rank by frequency (the others count as rare), and classes of equal sets told to all tasks; both bound what is sent.
FREQUENT, LARGE_CLASSES = 1 << 17, 1 << 13
#: A prefix is lengthened to as many matches at most; what a comparison costs, in prefix tokens.
MOST_MATCHES, COMPARISON = 4, 4.0
#: Bits of the sketch that rows of prefixes carry, and of a document's own sketch at most.
SHORT_BITS, LONG_BITS = 256, 1 << 20
#: Rows of one token that are compared with each other in one task; more are dealt in blocks, and each two blocks meet.
BLOCK_ROWS = 2048
#: In a second look, so many candidates of each two components at first, and so many times more in each look that follows.
ROOT_PAIRS = 256
#: Rows that a task works on at once, whole groups if they are smaller.
CHUNK_ROWS = 1 << 15
#: Bits of the filter that tells which documents' sets are needed for comparisons (a prime, so that ids spread).
FILTER_BITS = 33_554_393
_MEMORY = 400_000


class Words(dict):
    """Word (bytes) to a 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes (62 bits) of a text's runs of k words, A-Z lower-cased; of fewer words, all in one; of none, empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(only(_words).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = mix64(out ^ h[i : i + n], i)
    return np.unique(out >> np.uint64(2))


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' hashes in a power of two of bits, about one for each token."""
    bits = min(LONG_BITS, max(SHORT_BITS, 1 << (max(1, len(tokens)) - 1).bit_length()))
    at = (mix64(tokens, 77) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def handle(sig: bytes) -> int:
    """Half of a signature, which stands for the set in rows that travel."""
    return int.from_bytes(sig[:8], "little", signed=True)


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set in `size` bytes, or its own size if that is smaller, as uint64."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _sets_and_counts(k: int):
    """Per document a row (doc_id, n, sig, h, short, sketch); besides, per task, tokens that several of its different sets have (token, seen)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("h", pa.int64()), ("short", pa.binary()), ("sketch", pa.binary()), ("token", pa.int64()), ("seen", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 2], counts[counts > 2]
            known.clear()
            held.clear()
            none = pa.nulls(len(tokens))
            return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], schema=schema)

        for b in batches:
            ids, ns, sigs, sketches = b.column("doc_id"), [], [], []
            for text in b.column("text").to_pylist():
                tokens = shingles(text, k)
                sig = signature(tokens)
                ns.append(len(tokens))
                sigs.append(sig)
                sketches.append(sketch(tokens))
                if sig not in known:
                    known.add(sig)
                    held.append(tokens)
                    size += len(tokens)
            none = pa.nulls(b.num_rows).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int32()), pa.array(sigs, pa.binary()), pa.array(list(map(handle, sigs)), pa.int64()), pa.array([folded(s, SHORT_BITS // 8).tobytes() for s in sketches], pa.binary()), pa.array(sketches, pa.binary()), none, none], schema=schema)
            if size >= 6_000_000:
                yield counted()
                size = 0
        if held:
            yield counted()

    return run


class Order:
    """The global order: token hashes as they are, then the frequent ones from the least frequent on."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((tokens, counts))
        rank = np.empty(len(tokens), np.uint64)
        rank[by_count] = np.arange(len(tokens), dtype=np.uint64)
        by_token = np.argsort(tokens)
        self.tokens, self.rank, self.counts = tokens[by_token], rank[by_token], counts[by_count].astype(np.float64)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The tokens' keys, sorted: keys compare as tokens do in the order."""
        if not len(self.tokens) or not len(tokens):
            return tokens
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        frequent = self.tokens[at] == tokens
        return np.sort(np.where(frequent, self.rank[at] | np.uint64(1 << 62), tokens))

    def matches(self, keys: np.ndarray, base: int) -> tuple[int, int]:
        """How many matches a set asks for whose shortest prefix has `base` tokens, and the frequent tokens in its prefix.

        The cost of asking for l: a row for each of base + l - 1 tokens, and for the documents estimated to share a token of
        them, divided by l as that many must be shared, a comparison.
        """
        top = keys[: base + MOST_MATCHES - 1]
        others = np.zeros(len(top))
        frequent = top >= np.uint64(1 << 62)
        others[frequent] = self.counts[(top[frequent] ^ np.uint64(1 << 62)).astype(np.int64)] - 1
        total, best, least = np.cumsum(others), 1, np.inf
        for m in range(1, MOST_MATCHES + 1):
            if base + m - 1 > len(top):
                break
            cost = base + m - 1 + COMPARISON * total[base + m - 2] / m
            if cost < least:
                best, least = m, cost
        return best, int(frequent[: base + best - 1].sum())


def shortest(n: int, num: int, den: int) -> int:
    """The tokens of a set of n that any partner's prefix may have to meet, for one match."""
    return n - -(-n * num // den) + 1


def shortest(n: int, num: int, den: int) -> int:
    """The tokens of a set of n that any partner's prefix may have to meet, for one match."""
    return n - -(-n * num // den) + 1


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges a-b over n nodes make a spanning forest, the first ones where there is a choice; each node's component."""
    label, chosen = np.arange(n), np.zeros(len(a), bool)
    while len(cross := np.flatnonzero(label[a] != label[b])):
        la, lb = label[a[cross]], label[b[cross]]
        first = np.full(n, len(a))
        np.minimum.at(first, la, cross)
        np.minimum.at(first, lb, cross)
        comps = np.flatnonzero(first < len(a))
        e = first[comps]
        chosen[e] = True
        parent = np.arange(n)
        parent[comps] = np.where(label[a[e]] == comps, label[b[e]], label[a[e]])
        two = comps[(parent[parent[comps]] == comps) & (comps < parent[comps])]  # both chose the same edge
        parent[two] = two
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]
    return chosen, label


class Rows:
    """Rows of prefixes, as arrays: key, block, h (the set), n, l, pos, root (its component), side (1, 2, or 3 for both), and the sketch's words."""

    NAMES = ("key", "block", "h", "n", "l", "pos", "root", "side")

    def __init__(self, table: pa.Table):
        for c in self.NAMES:
            setattr(self, c, table.column(c).to_numpy())
        self.words = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        self.groups = np.flatnonzero(np.r_[True, (self.key[1:] != self.key[:-1]) | (self.block[1:] != self.block[:-1])]) if table.num_rows else np.zeros(0, int)

    def passing(self, num: int, den: int, every_root: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers i, j and the tightness of the pairs within groups that sizes, places and sketches allow a link.

        Unless every_root, a pair is of two components, and one of its rows is on side 1 and the other on side 2.
        """
        end = np.repeat(np.r_[self.groups[1:], len(self.key)], np.diff(np.r_[self.groups, len(self.key)]))
        n, l, pos = (x.astype(np.int64) for x in (self.n, self.l, self.pos))
        out, far, rows = [], 1, np.arange(len(self.key))
        while len(rows := rows[rows + far < end[rows]]):
            i, j = rows, rows + far
            both, m = n[i] + n[j], np.minimum(l[i], l[j])
            need = -(-both * num // (num + den))
            ok = (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & (pos[i] <= n[i] - need + m) & (pos[j] <= n[j] - need + m) & (self.h[i] != self.h[j])
            if not every_root:
                ok &= (self.root[i] != self.root[j]) & (((self.side[i] & 1) & (self.side[j] >> 1)) | ((self.side[j] & 1) & (self.side[i] >> 1))).astype(bool)
            i, j, room = i[ok], j[ok], (both - 2 * need)[ok]
            apart = np.bitwise_count(self.words[i] ^ self.words[j]).sum(axis=1, dtype=np.int64)
            ok = apart <= room
            out.append((i[ok], j[ok], (apart[ok] + 1) / (room[ok] + 1)))
            far += 1
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


class Join:
    """Word n-grams of k words at similarity num / den or more."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.k, self.num, self.den = k, num, den

    def prefixes(self, order: Order, large: dict[bytes, int]) -> DataFrame:
        """(key, h, nlp): the prefix tokens of all different sets; h is the first half of a set's signature, nlp is n, l and pos."""
        k, num, den = self.k, self.num, self.den
        schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("nlp", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: set[bytes] = set()
            for b in batches:
                keys, sigs, packed = [], [], []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    tokens = shingles(text, k)
                    sig = signature(tokens)
                    if not len(tokens) or sig in known or large.get(sig, doc_id) != doc_id:
                        continue
                    if len(known) >= 1 << 18:
                        known.clear()
                    known.add(sig)
                    ordered, base = order.keys(tokens), shortest(len(tokens), num, den)
                    m, _ = order.matches(ordered, base)
                    keys.append(ordered[: base + m - 1])
                    sigs.append(np.full(len(keys[-1]), handle(sig)))
                    packed.append((len(tokens) << 34) + (m << 31) + np.arange(1, len(keys[-1]) + 1))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, sigs, packed)], schema=schema)

        return self.docs.mapInArrow(run, "key long, h long, nlp long")

    @staticmethod
    def shared(prefixes: DataFrame) -> DataFrame:
        """The rows of prefixes whose token several sets have, each once.

        Rows come sorted by token and set. A frequent token is one that several sets have anyway; its rows are spread over
        tasks by set, so none has to take all of them.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, given = np.zeros((3, 0), np.int64), False  # the last row, and whether it has been given out
            for b in batches:
                t = np.concatenate([last, np.stack([c.to_numpy() for c in b.columns])], axis=1)
                t = t[:, np.r_[True, (t[0, 1:] != t[0, :-1]) | (t[1, 1:] != t[1, :-1])]] if t.shape[1] else t
                if not t.shape[1]:
                    continue
                same = t[0, 1:] == t[0, :-1]
                out = np.r_[False, same] | np.r_[same, False] | (t[0] >= 1 << 62)
                end = bool(out[-1])
                out[0] &= not given
                given, last = end, t[:, -1:].copy()
                if out.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in t[:, out]], ["key", "h", "nlp"])

        spread = F.when(F.col("key") >= 1 << 62, F.xxhash64("key", "h")).otherwise(F.xxhash64("key"))
        return prefixes.repartition(spread).sortWithinPartitions("key", "h").mapInArrow(run, "key long, h long, nlp long")

    def candidates(self, rows: DataFrame, most: int | None = None) -> DataFrame:
        """(key, a, b, l, more) of rows (key, block, h, n, l, pos, short, root, side), compared within each block.

        Without `most`, a spanning forest of the pairs that pass; `more` says that there were others. Else, of each two
        components, the `most` tightest pairs; `more` says that there are others.
        """
        num, den, names = self.num, self.den, [*Rows.NAMES, "short"]
        schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("l", pa.int32()), ("more", pa.bool_())])

        def compared(t: pa.Table) -> pa.RecordBatch:
            r = Rows(t)
            i, j, tight = r.passing(num, den, most is None)
            by = np.lexsort((j, i, tight))
            i, j = i[by], j[by]
            if most is None:
                chosen, label = forest(i, j, len(r.key))
                more = np.bincount(label, minlength=len(r.key))[label[i]] > 2
            else:
                x, y = np.minimum(r.root[i], r.root[j]), np.maximum(r.root[i], r.root[j])
                group = np.lexsort((np.arange(len(i)), y, x, r.block[i], r.key[i]))
                cells = [c[group] for c in (r.key[i], r.block[i], x, y)]
                new = np.r_[True, np.any([c[1:] != c[:-1] for c in cells], axis=0)] if len(i) else np.zeros(0, bool)
                first = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                place, size = np.arange(len(i)) - first, np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(i) else np.zeros(0, int)
                chosen, more = np.zeros(len(i), bool), np.zeros(len(i), bool)
                chosen[group], more[group] = place < most, size > most
            i, j, more = i[chosen], j[chosen], more[chosen]
            a, b = np.minimum(r.h[i], r.h[j]), np.maximum(r.h[i], r.h[j])
            return pa.RecordBatch.from_arrays([pa.array(r.key[i]), pa.array(a), pa.array(b), pa.array(np.minimum(r.l[i], r.l[j]), pa.int32()), pa.array(more)], schema=schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                if not b.num_rows:
                    continue
                held.append(b.select(names))
                size += b.num_rows
                if size >= CHUNK_ROWS:
                    t = pa.Table.from_batches(held).combine_chunks()
                    key, block = t.column("key").to_numpy(), t.column("block").to_numpy()
                    cut = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1 if key[0] != key[-1] or block[0] != block[-1] else 0
                    if cut:
                        yield compared(t.slice(0, cut))
                    held, size = t.slice(cut).to_batches(), t.num_rows - cut
            if held:
                yield compared(pa.Table.from_batches(held))

        ordered = rows.select(*names).repartition("key", "block").sortWithinPartitions("key", "block")
        return ordered.mapInArrow(run, "key long, a long, b long, l int, more boolean")

    def sets(self, needed: DataFrame, order: Order) -> DataFrame:
        """(h, id, keys) of the sets in needed (h, id); texts aren't shuffled for it.

        needed becomes a filter of fixed size, a bit for a remainder of the ids; a pass over the texts makes the sets of the
        documents that it lets through.
        """
        bit = F.pmod("id", F.lit(FILTER_BITS)) + 1  # Spark counts bits from 1
        bits = needed.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
        mask = np.zeros(FILTER_BITS // 8 + (1 << 13), np.uint8)
        for r in bits.collect():  # a fixed number of rows of 4 KB
            at = (r["bucket"] - 1) * 4096
            mask[at : at + 4096] |= np.frombuffer(r["bits"], np.uint8)
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64) % FILTER_BITS
                some = b.filter(pa.array((mask[at >> 3] >> (at & 7) & 1).astype(bool)))
                if some.num_rows:
                    found = [shingles(t, k) for t in some.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([handle(signature(t)) for t in found], pa.int64()), pa.array([order.keys(t).tobytes() for t in found], pa.binary())], ["h", "keys"])

        found = self.docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "h long, keys binary")
        return found.groupBy("h").agg(F.first("keys").alias("keys")).join(needed, "h")

    def near(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs (a, b, l) whose own sketches leave room for a link; known: (h, n, sketch)."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (b.column(c).to_pylist() for c in ("x", "y"))
                apart = [int(np.bitwise_count(folded(p, len(q)) ^ folded(q, len(p))).sum(dtype=np.int64)) for p, q in zip(x, y, strict=True)]
                sizes = b.column("nx").to_numpy().astype(np.int64) + b.column("ny").to_numpy()
                t = pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "l")], ["a", "b", "l"])
                yield t.filter(pa.array(np.array(apart, np.int64) <= sizes - 2 * -(-num * sizes // (num + den))))

        one = known.select(F.col("h").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
        two = known.select(F.col("h").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y"))
        return pairs.join(two, "b").join(one, "a").select("a", "b", "l", "nx", "ny", "x", "y").mapInArrow(run, "a long, b long, l int")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs (a, b, l): those that share l prefix tokens and then have the similarity, as (a, b, u, v), u and v being ids."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = []
                for x, y, m in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("l").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    first = np.intersect1d(x[: shortest(len(x), num, den) + m - 1], y[: shortest(len(y), num, den) + m - 1], assume_unique=True)
                    if len(first) < m:
                        good.append(False)
                        continue
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(den * common >= num * (len(x) + len(y) - common))
                t = b.select(["a", "b", "u", "v"])
                yield t.filter(pa.array(good, pa.bool_()))

        one = sets.select(F.col("h").alias("a"), F.col("id").alias("u"), F.col("keys").alias("x"))
        two = sets.select(F.col("h").alias("b"), F.col("id").alias("v"), F.col("keys").alias("y"))
        return pairs.join(two, "b").join(one, "a").select("a", "b", "u", "v", "x", "y", "l").mapInArrow(run, "a long, b long, u long, v long")

    def linked(self, found: DataFrame, known: DataFrame, order: Order) -> DataFrame:
        """Staged (a, b, u, v): the links among candidates."""
        pairs = staged(self.near(found.select("a", "b", "l").distinct(), known), "pairs", together=True)
        if pairs.isEmpty():
            return pairs.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"))
        needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(known.select("h", "id"), "h"), "needed", together=True)
        sets = staged(self.sets(needed, order), "wanted", together=True)
        links = staged(self.verified(pairs, sets), "links", together=True)
        discard(needed, sets, pairs)
        return links

    def attached(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows (key, h, nlp) with the sets' ids and short sketches."""
        field = lambda at, bits: F.shiftright("nlp", at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        return rows.join(known.select("h", "id", "short"), "h").select("key", "h", "id", field(34, 29).alias("n"), field(31, 3).alias("l"), field(0, 31).alias("pos"), "short")

    def cells(self, rows: DataFrame, keys: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of keys, placed so that any two of one key and different components meet in a block.

        In each key, the rows outside of its largest component are on side 1, all are on side 2; a block has rows of one
        part of either side. So a row of the largest component is dealt out once for every BLOCK_ROWS rows outside of it.
        """
        named = roots.select(F.col("node").alias("id"), "root")
        some = self.attached(rows.join(keys, "key", "left_semi"), known).join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = some.groupBy("key", "root").agg(F.count("*").alias("c"))
        whole = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
        parts = whole.select("key", F.col("largest.root").alias("main"), F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("ys"), F.greatest(F.lit(1), F.ceil((F.col("c") - F.col("largest.c")) / BLOCK_ROWS)).cast("int").alias("xs"))
        placed = some.join(parts, "key").withColumn("x", F.pmod(F.xxhash64("h"), F.col("xs")).cast("int")).withColumn("y", F.pmod(F.xxhash64("h", F.lit(1)), F.col("ys")).cast("int"))
        mine = F.when(F.col("root") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda y: F.struct((F.col("x") * F.col("ys") + y).alias("block"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<block:int,side:int>>"))
        other = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda x: F.struct((x * F.col("ys") + F.col("y")).alias("block"), F.lit(2).alias("side")))
        dealt = placed.withColumn("at", F.explode(F.concat(mine, other)))
        return dealt.groupBy("key", F.col("at.block").alias("block"), "h", "n", "l", "pos", "root").agg(F.bit_or("at.side").cast("int").alias("side"), F.first("short").alias("short"))

    @staticmethod
    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        """roots (node, root) after more links (u, v): only the components that these connect are looked at."""
        of = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("u", "v")]
        ends = links.join(of[0], "u", "left").join(of[1], "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        moved = staged(components(ends), "moved", together=True)
        by_root = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        known = roots.join(by_root, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return staged(known.unionByName(moved.join(roots, "node", "left_anti").select("node", "root")), "roots", together=True)

    def run(self) -> DataFrame:
        """Per document: doc_id, n_shingles, component_id."""
        both = staged(self.docs.mapInArrow(_sets_and_counts(self.k), "doc_id long, n int, sig binary, h long, short binary, sketch binary, token long, seen long"), "sets")
        mine = both.where(F.col("sig").isNotNull()).select("doc_id", "n", "sig")
        own = [F.first(c).alias(c) for c in ("n", "h", "short", "sketch")]
        known = staged(both.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), *own), "classes", together=True)
        top = both.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT).toArrow()
        order = Order(top.column("token").to_numpy().view(np.uint64), top.column("seen").to_numpy())
        large = {bytes(r["sig"]): r["id"] for r in known.where("copies > 4").select("sig", "id", "copies").orderBy(F.desc("copies"), "sig").limit(LARGE_CLASSES).collect()}
        named = known.where("id is not null")

        rows = staged(self.shared(self.prefixes(order, large)), "prefixes", together=True)
        big = staged(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK_ROWS), "big", together=True)
        block = F.lit(0) if big.isEmpty() else F.coalesce(F.pmod(F.xxhash64("h"), F.ceil(F.col("c") / BLOCK_ROWS)), F.lit(0)).cast("int")
        start = self.attached(rows, named) if big.isEmpty() else self.attached(rows, named).join(big, "key", "left")
        found = staged(self.candidates(start.withColumn("block", block).withColumn("root", F.lit(0).cast("long")).withColumn("side", F.lit(3))), "candidates", together=True)
        links = self.linked(found, named, order)
        failed = found.where("more").join(links.select("a", "b"), ["a", "b"], "left_anti").select("key")
        keys = staged(failed.unionByName(big.select("key")).distinct(), "keys", together=True)
        most, roots = ROOT_PAIRS, staged(components(links.select("u", "v")), "roots", together=True)
        while not keys.isEmpty():
            discard(found)
            found = staged(self.candidates(self.cells(rows, keys, named, roots), most), "candidates", together=True)
            new = self.linked(found, named, order)
            if not new.isEmpty():
                roots = self.merged(roots, new)
            placed = named.join(roots, named.id == roots.node, "left").select("h", F.coalesce("root", "id").alias("r"))
            of = [placed.select(F.col("h").alias(c), F.col("r").alias(f"r{c}")) for c in ("a", "b")]
            open_ = found.where("more").join(of[0], "a").join(of[1], "b").where("ra <> rb")
            keys = staged(open_.select("key").distinct(), "keys", together=True)
            most *= ROOT_PAIRS
        discard(rows, found)
        component = known.join(roots, known.id == roots.node, "left").select("sig", F.coalesce("root", "id").alias("component"))
        joined = mine.alias("d").join(component.alias("c"), (F.col("d.sig") == F.col("c.sig")) & (F.col("n") > 0), "left")
        own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
        return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links of similarity num / den or more reach).

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A text of fewer than k words is one shingle;
    one without words, or null, has none and is linked with nothing. Equal sets are one class from the start, so copies are
    compared once; rows with one doc_id count as one document each; a text that only rows without id have is linked with
    nothing but its copies, and its component is null; an empty table gives no row; other columns are ignored.
    """
    return Join(docs, k, num, den).run()
