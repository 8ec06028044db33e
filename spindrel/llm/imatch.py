"""Document fingerprints by I-Match: terms within a band of inverse document frequency, hashed under random lexicon subsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64

#: A term is in the lexicon if it is in at least LEAST_DOCS different texts and at most MOST_SHARE of them.
LEAST_DOCS, MOST_SHARE = 3, 0.5
#: Lexicon subsets: EACH of every density 1, 1/4, 1/16, ... A text of few terms differs under the dense ones, a long one under the thin ones.
DENSITIES, EACH = tuple(4.0**-k for k in range(7)), 16
#: Bytes of text that are split into terms at once.
CHUNK = 1 << 20

# Terms are runs of ASCII letters and digits, and of everything beyond ASCII, of the text in lower case.
_IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_VALUES = mix64(np.arange(256, dtype=np.uint64), 21)
_FACTOR = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    """_FACTOR ** 0, 1, ... modulo 2 ** 64."""
    out = np.full(max(1, n), _FACTOR, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each term of data starts, and its hash: a polynomial of its bytes, mixed with its length."""
    codes = np.frombuffer(data, np.uint8)
    inside = _IN_TERM[codes]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    sums = np.add.reduceat(_VALUES[codes[inside]] * _powers(int(length.max()))[place], first)
    return start, mix64(sums ^ mix64(length.astype(np.uint64), 3))


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about CHUNK bytes, cut at white space; a longer run without any stays whole."""
    while len(data) > CHUNK:
        cut = data.rfind(b" ", 0, CHUNK)
        cut = data.find(b" ", CHUNK) if cut <= 0 else cut
        if cut <= 0:
            break
        yield data[:cut]
        data = data[cut:]
    yield data


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def terms_of(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct terms, sorted, as 64-bit hashes."""
    out, held, size = [], [], 0

    def flush() -> None:
        start, found = _hashes(b" ".join(held))
        ends = np.cumsum([len(d) + 1 for d in held])
        out.extend(map(distinct, np.split(found, np.searchsorted(start, ends[:-1]))))
        held.clear()

    for text in texts:
        data = (text or "").lower().encode()
        if held and size + len(data) > CHUNK:
            flush()
            size = 0
        if len(data) > CHUNK:
            out.append(distinct(np.concatenate([distinct(_hashes(p)[1]) for p in _pieces(data)])))
        else:
            held.append(data)
            size += len(data)
    if held:
        flush()
    return out


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def in_band(docs: DataFrame) -> Column:
    """Whether `df` is that of a lexicon term of docs."""
    return F.col("df").between(LEAST_DOCS, max(LEAST_DOCS, int(MOST_SHARE * docs.select(text_hash()).distinct().count())))


#: For each series of subsets (rows) and density (columns), up to which hash a term belongs to the subset. A series' thin
#: subsets are parts of its dense ones; the densest leave out 0 to 15 thirty-seconds of the lexicon.
_LIMITS = np.array([[min(int((d if d < 1 else 1 - k / 32) * 2**64), 2**64 - 1) for d in DENSITIES] for k in range(EACH)], np.uint64)
_SALTS = mix64(np.arange(EACH, dtype=np.uint64), 5)


def codes(kept: list[np.ndarray]) -> np.ndarray:
    """For each text, density and series, the hash (1 to 65535) of the text's terms in that subset, or 0 if it has none.

    kept: each text's distinct lexicon terms, sorted. The hash takes them in this order: each is mixed with its place in the
    subset, and the sum of these is mixed.
    """
    out = np.zeros((len(kept), len(DENSITIES), EACH), np.uint16)
    sizes = np.array([len(k) for k in kept])
    terms, text = np.concatenate([np.zeros(0, np.uint64), *kept]), np.repeat(np.arange(len(kept)), sizes)
    for s in range(EACH):
        drawn, some, of = mix64(terms ^ _SALTS[s]), terms, text
        for k in range(len(DENSITIES)):
            member = drawn <= _LIMITS[s, k]  # a series' thin subsets are parts of its dense ones
            drawn, some, of = drawn[member], some[member], of[member]
            if not len(some):
                break
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            count = np.diff(np.r_[first, len(of)])
            place = np.arange(len(of)) - np.repeat(first, count)
            sums = np.add.reduceat(mix64(some + place.astype(np.uint64) * np.uint64(_FACTOR)), first)
            out[of[first], k, s] = mix64(sums ^ count.astype(np.uint64)) % np.uint64(65535) + np.uint64(1)
    return out


def fingerprints(kept: list[np.ndarray]) -> list[str]:
    """Four hex digits for each lexicon subset, by density."""
    return [c.astype(">u2").tobytes().hex() for c in codes(kept)]


def members(terms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Those of the sorted terms that are among the sorted words."""
    if not len(words) or not len(terms):
        return terms[:0]
    return terms[words[np.minimum(np.searchsorted(words, terms), len(words) - 1)] == terms]


def likeness(a: str, b: str) -> float:
    """The share of subsets with equal hashes among those in which either text has a term, at the density where it is highest.

    Dense subsets of a long text differ after any edit, thin ones of a short text are empty; at the density that suits the
    texts, the share is near that of their common terms. A density counts if four of its subsets have a term, and all subsets
    together do. Equal fingerprints give 1, also those of two texts without lexicon terms.
    """
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(t), ">u2").reshape(-1, EACH) for t in (a, b))
    seen = ((x != 0) | (y != 0)).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    return float(max([same.sum() / max(1, seen.sum()), *(same[seen >= 4] / seen[seen >= 4])]))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many of the first characters of the next (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document's bucket of neighbouring ids, with the first document of the next bucket at its end.

    Buckets are ranges of doc_id at approximate quantiles, as many as shuffle partitions, since a term travels once for each
    bucket that has it; the one document that a bucket needs from the next is sent to both. Texts travel once, compressed. After the last id comes the first again.
    Rows: bucket, extra (0, or 1 for the one from the next bucket), doc_id, data (the compressed text).
    Besides, (bucket, hash): the texts of a bucket that an earlier bucket has as well.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = np.array(sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n))), float)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(np.isnan(x.astype(float)), 0, np.searchsorted(bounds, x.astype(float), "right")), pa.int32()), b.column(0)], ["bucket", "doc_id"])

    # Null ids sort first, as ids below all others do.
    firsts = {r["bucket"]: r["first"] for r in ids.mapInArrow(bucket, "bucket int, doc_id long").groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first")).collect()}
    order = sorted(firsts)
    to = {firsts[b]["doc_id"]: order[k - 1] for k, b in enumerate(order)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids, data = b.column("doc_id").to_pylist(), [codec.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            own = np.searchsorted(bounds, np.array([-np.inf if i is None else i for i in ids]), "right").tolist()
            rows = [(at, 0, i, d) for at, i, d in zip(own, ids, data, strict=True)] + [(to[i], 1, i, d) for i, d in zip(ids, data, strict=True) if i in to]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "extra", "doc_id", "data"])

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, "bucket int, extra int, doc_id long, data binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.searchsorted(bounds, np.array([-np.inf if i is None else i for i in b.column("doc_id").to_pylist()], float), "right")
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("hash")], ["bucket", "hash"])

    hashes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash")).mapInArrow(hashed, "bucket int, hash long").distinct()
    copied = hashes.withColumn("first", F.min("bucket").over(Window.partitionBy("hash"))).where("bucket > first").select("bucket", "hash")
    return sent, copied


def in_order(bucket: pa.Table) -> Iterator[tuple[int, int | None, str]]:
    """(extra, doc_id, text) of a bucket's documents as they follow each other; of those from the next bucket, one."""
    codec, extras = zstandard.ZstdDecompressor(), 0
    by = pc.sort_indices(bucket, sort_keys=[(c, "ascending") for c in ("extra", "doc_id", "data")], null_placement="at_start").to_pylist()
    extra, ids, data = (bucket.column(c) for c in ("extra", "doc_id", "data"))
    for i in by:
        extras += extra[i].as_py()
        if extras > 1:
            return  # further rows of the id that came across
        yield extra[i].as_py(), ids[i].as_py(), codec.decompress(data[i].as_py()).decode()


def together(rows: Iterator[tuple[int, int | None, str]]) -> Iterator[list[tuple[int, int | None, str]]]:
    """The rows in lists of about CHUNK characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def seams(text: str, following: str) -> list[bytes]:
    """The chunks of edited() that may be in neither text: the one at the cut and the last one."""
    half = len(text) // 2
    left, right = text[: len(text) - half].encode(), following[:half].encode()
    last = b"" if not left or left[-1:].isspace() else left.rsplit(None, 1)[-1]
    words = [] if not right or right.isspace() else [right.split(None, 1)[0], right.rsplit(None, 1)[-1]]
    return [last, *words] if right[:1].isspace() or not words else [last + words[0], words[1]]


def kept_terms(sent: DataFrame, copied: DataFrame, band: Column) -> DataFrame:
    """(bucket, term): the lexicon terms that each bucket's documents and edited texts have. A text counts once, in the first
    bucket that has it.

    A bucket gives each of its terms once, with its count, and gets back those in the band, so no task has the whole lexicon.
    """
    fields = pa.schema([("bucket", pa.int32()), ("term", pa.int64()), ("n", pa.int64())])

    def run(bucket: pa.Table, copied: pa.Table) -> pa.Table:
        if not bucket.num_rows:
            return fields.empty_table()
        at, held, odd, n, out, last = bucket.column("bucket")[0].as_py(), [], [], 0, [], None
        known = set(copied.column("hash").to_pylist())

        def summed() -> None:
            terms, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            more = np.setdiff1d(np.concatenate([np.zeros(0, np.uint64), *odd]), terms)
            held.clear()
            odd.clear()
            terms, counts = np.concatenate([terms, more]), np.concatenate([counts, np.zeros(len(more), np.int64)])
            out.append(pa.table([pa.array(np.full(len(terms), at, np.int32)), pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], schema=fields))

        for some in together(in_order(bucket)):
            texts = [text for _, _, text in some]
            odd.extend(terms_of([b" ".join(seams(x, y)).decode() for x, y in zip([last, *texts], texts, strict=False) if x is not None]))
            last = texts[-1]
            for (extra, _, text), own in zip(some, terms_of(texts), strict=True):
                digest = int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64))  # as Spark's xxhash64
                if extra or digest in known:  # counted in its own bucket, or before
                    odd.append(own)
                else:
                    known.add(digest)
                    held.append(own)
                n += len(own)
            if n >= 4_000_000:
                summed()
                n = 0
        summed()
        return pa.concat_tables(out)

    found = sent.groupBy("bucket").cogroup(copied.groupBy("bucket")).applyInArrow(run, "bucket int, term long, n long")
    return found.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).where(band).select("bucket", "term")


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow each other by doc_id: null first, equal ids in order of their compressed texts; the first follows the
    last, and a table of one row follows itself. Null text counts as empty; a text without lexicon terms, as an empty one, has
    a fingerprint of zeros, which is like itself alone; an empty table gives no row; other columns are ignored.
    """
    sent, copied = with_next(docs)
    terms = kept_terms(sent, copied, in_band(docs))

    def run(bucket: pa.Table, kept: pa.Table) -> pa.Table:
        words, before, rows = distinct(kept.column("term").to_numpy().view(np.uint64)), None, []
        for some in together(in_order(bucket)) if bucket.num_rows else ():
            texts = [text for _, _, text in some]
            own = fingerprints([members(t, words) for t in terms_of(texts)])
            line = [*([before] if before else []), *((doc_id, text, f) for (_, doc_id, text), f in zip(some, own, strict=True))]
            changed = [edited(x[1], y[1]) for x, y in zip(line, line[1:], strict=False)]
            others = fingerprints([members(t, words) for t in terms_of(changed)])
            for (doc_id, text, mine), (_, _, following), new, other in zip(line, line[1:], changed, others, strict=False):
                rows.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), mine, other, likeness(mine, other), likeness(mine, following)))
            before = line[-1]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS) if rows else _FIELDS.empty_table()

    both = sent.groupBy("bucket").cogroup(terms.groupBy("bucket"))
    return both.applyInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
