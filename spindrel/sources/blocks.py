"""Postings of many documents at once. A task takes in Arrow batches of analysed documents and gathers for each field and term
of some documents one row with all of its postings; rows that lie in one range of (field, term, doc_id) go on as one packed
row. So tokens are neither dealt nor sorted by Spark, and what is dealt is about as large as the postings' files.

gathered  field, term, docs, shards, tfs, lens, positions: lists, where each document has `tf` positions after those before it
packed    bucket, size, data: the number of a range, and gathered rows of a field as written(), compressed; or with bucket -1
          field, shard_id, doc_count, sum_len: documents with tokens in a field
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import Analyzer, Registry
from ..mapping import FieldMapping, FieldType, term_form, typed

#: Positions between the values of a text field with several.
GAP = 100
#: Documents with about so many tokens are put in order at a time, at least one.
MOST_TOKENS = 600_000
#: One Arrow batch holds at most so many documents, so that very long ones stay small in a Python worker; so many are kept.
BATCH_ROWS, MOST_BATCHES = 512, 500
#: A bound between ranges rests on so many postings of a sample, of so many documents.
POSTINGS_A_BOUND, DOCUMENTS_A_BOUND = 100, 40

INTS = pa.list_(pa.int32())
GATHERED = pa.schema([("field", pa.string()), ("term", pa.string()), ("docs", pa.list_(pa.string())), *((n, INTS) for n in ("shards", "tfs", "lens", "positions"))])
PACKED = "bucket int, size long, data binary, field string, shard_id int, doc_count long, sum_len long"
POSTINGS = "field string, term string, doc_id string, shard_id int, tf int, len int, positions array<int>"
Bound = tuple[int, str, str]


def native(analyzer: Analyzer) -> Analyzer:
    """What Spark does of an analysis; where words are stemmed, the steps from synonyms on are left to the batches."""
    return replace(analyzer, synonyms={}, stems=False, beginnings=None) if analyzer.stems else analyzer


def value_lists(docs: DataFrame, f: FieldMapping, analyzers: Registry) -> Column:
    """array<array<struct<term, pos>>>: the tokens of each value of a field; one list for all values that aren't text."""
    kind = docs.schema[f.name].dataType
    many = isinstance(kind, T.ArrayType)
    if f.type is not FieldType.TEXT:
        kind = kind.elementType if many else kind
        values = F.filter(F.col(f.name) if many else F.array(f.name), lambda x: x.isNotNull())
        return F.array(F.transform(values, lambda x, i: F.struct(term_form(f, typed(f, x, kind)).alias("term"), i.alias("pos"))))
    analyzer = native(analyzers[f.index_analyzer()])
    if not many:
        return F.array(analyzer.column(F.col(f.name).cast("string")))
    return F.transform(F.filter(F.col(f.name).cast("array<string>"), lambda x: x.isNotNull()), analyzer.column)


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def tokens_of(column: pa.Array) -> np.ndarray:
    """How many tokens each document has."""
    values = np.repeat(np.arange(len(column)), lengths(column))
    return np.bincount(values, lengths(pc.list_flatten(column)), len(column)).astype(np.int64)


def some_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with about MOST_TOKENS tokens, whatever the batches hold."""

    def cut(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        before, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + MOST_TOKENS, "right")))
            yield batch.slice(at, to - at)
            at = to

    held, sizes = [], []
    for batch in batches:
        held.append(batch)
        sizes.append(sum((tokens_of(c) for c in batch.columns[2:]), np.zeros(batch.num_rows, np.int64)))
        if sum(int(x.sum()) for x in sizes) >= MOST_TOKENS or len(held) >= MOST_BATCHES:
            yield from cut(pa.concat_batches(held), np.concatenate(sizes))
            held, sizes = [], []
    if held:
        yield from cut(pa.concat_batches(held), np.concatenate(sizes))


def inverted(name: str, ids: pa.Array, shards: np.ndarray, column: pa.Array, last: Analyzer | None, positions: bool) -> tuple[pa.RecordBatch, np.ndarray]:
    """Gathered rows of one field of some documents, in order of terms, and how many tokens each document has in it."""
    n_values, inner = lengths(column), pc.list_flatten(column)
    n_tokens, flat = lengths(inner), pc.list_flatten(inner)
    value = np.repeat(np.arange(len(inner)), n_tokens)
    words = pc.struct_field(flat, "term").dictionary_encode()
    code, pos, terms = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.struct_field(flat, "pos").to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    if last:  # a word becomes some terms, all at its position
        made = [last.ending(w) for w in terms.to_pylist()]
        some = np.array([len(m) for m in made], np.int64)
        begin, times = np.cumsum(some) - some, some[code] if len(code) else np.zeros(0, np.int64)
        token = np.repeat(np.arange(len(code)), times)
        ahead = np.arange(len(token)) - np.repeat(np.cumsum(times) - times, times)
        again = pa.array([x for m in made for x in m], pa.string()).dictionary_encode()
        code = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[begin[code[token]] + ahead]
        value, pos, terms = value[token], pos[token], again.dictionary
        n_tokens = np.bincount(value, minlength=len(inner))
    doc_of_value = np.repeat(np.arange(len(column)), n_values)
    if len(inner) and n_values.max() > 1:  # values follow each other, GAP apart
        used = np.full(len(inner), GAP, np.int64)
        has = n_tokens > 0
        used[has] += pos[np.cumsum(n_tokens)[has] - 1] + 1
        before, first = np.cumsum(used) - used, np.cumsum(n_values) - n_values
        pos = pos + (before - before[first[doc_of_value]])[value]
    doc = doc_of_value[value]
    length = np.bincount(doc, minlength=len(column))
    order = pc.sort_indices(terms).to_numpy().astype(np.int64)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    key = rank[code] * len(column) + doc
    by = np.argsort(key, kind="stable")
    key = key[by]
    runs = lambda x: np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))  # noqa: E731  where runs begin, and the end
    at = runs(key)
    term, own = key[at[:-1]] // len(column), key[at[:-1]] % len(column)
    block = runs(term)
    lists = lambda x, ends=block: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
    docs = pa.ListArray.from_arrays(pa.array(block, pa.int32()), ids.take(pa.array(own)))
    where = lists(pos[by], at[block]) if positions else lists([], np.zeros(len(block)))
    rows = [pa.repeat(pa.scalar(name), len(block) - 1), terms.take(pa.array(order[term[block[:-1]]])), docs, lists(shards[own]), lists(np.diff(at)), lists(length[own]), where]
    return pa.RecordBatch.from_arrays(rows, schema=GATHERED), length


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """Numbers from 0 on in the bytes that the largest needs, all first bytes first: so they compress well."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return kind, x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


def widened(kind: str, data: bytes) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, len(data) // width).T).view(kind).ravel().astype(np.int64)


def ends(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def gaps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each run of rising numbers as its first and the differences."""
    out = np.diff(x, prepend=0)
    out[ends(sizes)[:-1]] = x[ends(sizes)[:-1]]
    return out


def summed(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """gaps(), undone."""
    total = np.cumsum(x)
    first = ends(sizes)[:-1]
    return total - np.repeat(total[first] - x[first], sizes)


def written(rows: pa.RecordBatch) -> bytes:
    """Gathered rows of one field, as numbers in few bytes and texts end to end."""
    flat = {c: pc.list_flatten(rows.column(c)) for c in ("docs", "shards", "tfs", "lens", "positions")}
    number = {c: flat[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shards", "tfs", "lens", "positions")}
    texts = []
    for x in (rows.column("term"), flat["docs"]):
        texts += [narrow(pc.binary_length(x).to_numpy(zero_copy_only=False)), pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([x]).cast(pa.binary())), b"")[0].as_py()]
    places = gaps(number["positions"], number["tfs"]) if len(number["positions"]) else number["positions"]
    return pickle.dumps((rows.column("field")[0].as_py(), narrow(lengths(rows.column("docs"))), *texts, *(narrow(number[c]) for c in ("shards", "tfs", "lens")), narrow(places)), 5)


def read(data: bytes) -> pa.Table:
    """written(), undone."""
    name, n, terms, term_text, docs, doc_text, shards, tfs, lens, places = pickle.loads(data)
    n, terms, docs, shards, tfs, lens, places = (widened(*x) for x in (n, terms, docs, shards, tfs, lens, places))
    text = lambda sizes, data: pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends(sizes).astype(np.int32)), pa.py_buffer(data))
    lists = lambda x, at=ends(n): pa.ListArray.from_arrays(pa.array(at, pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, pa.int32()))  # noqa: B008, E731
    where = lists(summed(places, tfs), ends(tfs)[ends(n)]) if len(places) else lists([], np.zeros(len(n) + 1))
    return pa.table([pa.repeat(pa.scalar(name), len(n)), text(terms, term_text), lists(text(docs, doc_text)), lists(shards), lists(tfs), lists(lens), where], schema=GATHERED)


def gathered(docs: DataFrame, fields: list[FieldMapping], analyzers: Registry, schema: str, give: Callable[[int, pa.RecordBatch, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What `give` makes of the gathered rows of a field's place, the shards and the lengths of some documents. docs are doc_id,
    shard_id and the fields; their ids are distinct."""
    some = docs.select("doc_id", F.col("shard_id").cast("int"), *(value_lists(docs, f, analyzers).alias(f"f{i}") for i, f in enumerate(fields)))
    chains = [analyzers[f.index_analyzer()] for f in fields]
    plans = [(f.name, a if a.stems else None, f.positions) for f, a in zip(fields, chains, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_at_a_time(batches):
            ids, shards = b.column(0).cast(pa.string()), b.column(1).to_numpy(zero_copy_only=False)
            for i, (name, last, positions) in enumerate(plans):
                yield from give(i, *inverted(name, ids, shards, b.column(2 + i), last, positions), shards)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return some.mapInArrow(run, schema)


def totals(name: str, lengths: np.ndarray, shards: np.ndarray) -> Iterator[tuple[str, int, int, int]]:
    """field, shard_id, doc_count, sum_len."""
    has = lengths > 0
    for s in np.unique(shards[has]):
        own = lengths[has & (shards == s)]
        yield name, int(s), len(own), int(own.sum())


def packed(docs: DataFrame, fields: list[FieldMapping], analyzers: Registry, bounds: list[Bound]) -> DataFrame:
    """Packed rows of documents; a bucket's rows are not below its bound, (place of the field, term, doc_id)."""
    names = [f.name for f in fields]
    schema = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("data", pa.binary()), ("field", pa.string()), ("shard_id", pa.int32()), ("doc_count", pa.int64()), ("sum_len", pa.int64())])

    def give(place: int, rows: pa.RecordBatch, lengths: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = [(-1, None, None, *t) for t in totals(names[place], lengths, shards)]
        terms, docs = rows.column("term"), rows.column("docs")
        key = lambda i: (place, terms[i].as_py(), docs[i][0].as_py())
        at, n = 0, rows.num_rows
        while at < n:
            bucket = bisect.bisect_right(bounds, key(at))
            to = bisect.bisect_left(range(n), bounds[bucket], at + 1, n, key=key) if bucket < len(bounds) else n
            data = written(rows.slice(at, to - at))
            out.append((bucket, len(data), pa.compress(data, "zstd", asbytes=True), None, None, None, None))
            at = to
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 64], strict=True), schema, strict=True)], schema=schema)

    return gathered(docs, fields, analyzers, PACKED, give)


def sampled_bounds(docs: DataFrame, fields: list[FieldMapping], analyzers: Registry, n: int) -> list[Bound]:
    """Bounds that split the postings into about n equal ranges. Any bounds give the same postings."""
    if n < 2:
        return []
    share = DOCUMENTS_A_BOUND * n / max(1, docs.count())

    def give(place: int, rows: pa.RecordBatch, lengths: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
        times = rows.column("docs").value_lengths()
        which = pa.array(np.repeat(np.arange(rows.num_rows), times))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(place, pa.int32()), len(which)), rows.column("term").take(which), rows.column("docs").flatten()], ["place", "term", "doc_id"])

    found = gathered(docs.sample(share, 7) if share < 1 else docs, fields, analyzers, "place int, term string, doc_id string", give)
    less = POSTINGS_A_BOUND * n / max(1, found.count())
    rows = sorted(tuple(r) for r in (found.sample(less, 7) if less < 1 else found).collect())
    return sorted({rows[len(rows) * i // n] for i in range(1, n)}) if rows else []


def rows(packed: DataFrame, fields: list[FieldMapping], n: int) -> DataFrame:
    """Postings, a row for each document of a term, in ranges and in order of (field, term, doc_id)."""
    placed = {f.name for f in fields if f.positions}

    def flat(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables).combine_chunks()
        first = pc.list_element(t["docs"], 0)
        t = t.take(pc.sort_indices(pa.table([t["field"], t["term"], first], ["f", "t", "d"]), [("f", "ascending"), ("t", "ascending"), ("d", "ascending")]))
        sizes = np.cumsum(pc.list_value_length(t["docs"]).to_numpy())
        at = 0
        while at < t.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 20_000, "right")))
            b = t.slice(at, to - at).combine_chunks()
            which = pa.array(np.repeat(np.arange(to - at), pc.list_value_length(b["docs"]).to_numpy()))
            one = lambda c: pc.list_flatten(b[c]).combine_chunks()  # noqa: B023, E731
            tf = one("tfs")
            if b["field"][0].as_py() in placed:
                where = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf.to_numpy())), pa.int32()), one("positions"))
            else:
                where = pa.nulls(len(tf), INTS)
            whole = lambda c: b[c].take(which).combine_chunks()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([whole("field"), whole("term"), one("docs"), one("shards"), tf, one("lens"), where], ["field", "term", "doc_id", "shard_id", "tf", "len", "positions"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for bucket, size, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "size", "data")), strict=True):
                if bucket != now:
                    for name in sorted(held):
                        yield from flat(held[name])
                    now, held = bucket, {}
                table = read(pa.decompress(data, size, "zstd", asbytes=True))
                held.setdefault(table["field"][0].as_py(), []).append(table)
        for name in sorted(held):
            yield from flat(held[name])

    dealt = packed.where("bucket >= 0").select("bucket", "size", "data").repartitionByRange(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, POSTINGS)


def measured(packed: DataFrame) -> DataFrame:
    """field, shard_id, doc_count, sum_len."""
    return packed.where("bucket = -1").groupBy("field", "shard_id").agg(F.sum("doc_count").alias("doc_count"), F.sum("sum_len").alias("sum_len"))


def shares(docs: DataFrame, fields: list[FieldMapping], analyzers: Registry) -> DataFrame:
    """field, term, df of some documents at a time; or without a term field, shard_id, doc_count, sum_len."""
    names = [f.name for f in fields]
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("shard_id", pa.int32()), ("doc_count", pa.int64()), ("sum_len", pa.int64())])

    def give(place: int, rows: pa.RecordBatch, lengths: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays([rows.column("field"), rows.column("term"), rows.column("docs").value_lengths().cast(pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        if found := [(name, None, None, *rest) for name, *rest in totals(names[place], lengths, shards)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return gathered(docs, fields, analyzers, "field string, term string, df long, shard_id int, doc_count long, sum_len long", give)
