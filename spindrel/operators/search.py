"""Searches: matches, access, order, pages and what comes with them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.ast import Boolean, Clause, MatchAll, Occur, Query
from ..plans.compiler import Compiler
from ..plans.parser import Parser
from ..sources.files import Folder
from ..sources.index import Index
from ..sources.scratch import scratch
from . import facets as facet_operators
from .facets import Facet
from .highlight import Highlight, matchers, passages

#: Offset pages reach so far; beyond, pages follow each other by search_after.
DEEPEST = 1000
#: A scroll reads so many hits at a time, or a page.
MOST_READ = 5000


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class SearchRequest:
    query: str | Query | None = None
    filter: str | Query | None = None
    start: int = 0
    size: int = 10
    sort: tuple[Sort, ...] = ()
    facets: tuple[Facet, ...] = ()
    highlight: Highlight | None = None
    search_after: tuple | None = None
    search_type: str = "dfs_query_then_fetch"
    fields: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.start < 0 or self.size < 0 or self.start + self.size > DEEPEST:
            raise ValueError(f"start and size are at least 0 and together at most {DEEPEST}")
        if self.search_type not in ("query_then_fetch", "dfs_query_then_fetch"):
            raise ValueError(f"no search type {self.search_type!r}")

    @property
    def order(self) -> tuple[Sort, ...]:
        return self.sort or (Sort("_score", True),)


@dataclass
class Hit:
    doc_id: str
    score: float
    shard_id: int
    fields: dict
    sort_values: tuple
    highlights: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class SearchResponse:
    hits: list[Hit]
    total: int
    max_score: float
    facets: dict[str, list[dict]]
    shards_failed: int = 0
    lower_bound: bool = False


def allowed(index: Index, matches: DataFrame, principals: list[str] | None) -> DataFrame:
    """Matches that the principals may see: with None all, else those without groups or with one of theirs."""
    if principals is None:
        return matches
    open_ = F.col("acl").isNull() | (F.size("acl") == 0)
    mine = F.arrays_overlap("acl", F.array(*map(F.lit, principals))) if principals else F.lit(False)
    return matches.join(index.docs.where(open_ | F.coalesce(mine, F.lit(False))).select("doc_id"), "doc_id", "left_semi")


def parse(index: Index, query: str | Query | None) -> Query:
    return query if isinstance(query, Query) else Parser(index.mapping, index.analyzers).parse(query)


def whole_query(index: Index, request: SearchRequest) -> Query:
    """The query, with the filter as a clause that doesn't score."""
    main = parse(index, request.query)
    if request.filter is None:
        return main
    return Boolean((Clause(Occur.MUST, main), Clause(Occur.FILTER, parse(index, request.filter))))


def matches(index: Index, request: SearchRequest, principals: list[str] | None = None) -> DataFrame:
    """(doc_id, score) of all matches that may be seen."""
    found = Compiler(index, request.search_type == "query_then_fetch").compile(whole_query(index, request))
    return allowed(index, found, principals)


def sort_key(index: Index, s: Sort) -> Column:
    if s.field == "_score":
        return F.col("score")
    if s.field == "_id":
        return F.col("doc_id")
    if f"{s.field}__num" in index.docs.columns:
        return F.col(f"{s.field}__num")
    if f"{s.field}__kw" in index.docs.columns:
        return F.get(f"{s.field}__kw", F.lit(0))
    return F.lit(None).cast("string")  # no values to sort by: the order of ids


def keyed(index: Index, found: DataFrame, order: tuple[Sort, ...]) -> DataFrame:
    """Matches with the columns s0, s1, ... that they are ordered by."""
    if any(s.field not in ("_score", "_id") for s in order):
        needed = [c for s in order for c in (f"{s.field}__num", f"{s.field}__kw") if c in index.docs.columns]
        found = found.join(index.docs.select("doc_id", *dict.fromkeys(needed)), "doc_id")
    return found.select("doc_id", "score", *(sort_key(index, s).alias(f"s{i}") for i, s in enumerate(order)))


def ordering(order: tuple[Sort, ...]) -> list[Column]:
    """Null comes after everything, so first where the order falls; equal documents follow by id."""
    return [F.col(f"s{i}").desc_nulls_first() if s.descending else F.col(f"s{i}").asc_nulls_last() for i, s in enumerate(order)] + [F.col("doc_id").asc()]


def after(order: tuple[Sort, ...], cursor: tuple) -> Column:
    """Documents that come after a cursor: the values of the order, and perhaps the id, without which equal ones are passed."""
    names = [(f"s{i}", s.descending) for i, s in enumerate(order)] + [("doc_id", False)] * (len(cursor) > len(order))
    tests, same = [], F.lit(True)
    for (name, falling), value in zip(names, cursor, strict=False):
        x = F.col(name)
        if value is None:
            beyond, equal = (x.isNotNull() if falling else F.lit(False)), x.isNull()
        else:
            beyond, equal = (x < value if falling else (x > value) | x.isNull()), x.eqNullSafe(F.lit(value))
        tests.append(same & F.coalesce(beyond, F.lit(False)))
        same = same & equal
    return reduce(lambda a, b: a | b, tests)


def page(index: Index, found: DataFrame, request: SearchRequest) -> DataFrame:
    """The rows of a page, in order: doc_id, score, s0, ..."""
    rows = keyed(index, found, request.order)
    if request.search_after is not None:
        rows = rows.where(after(request.order, request.search_after))
    return rows.orderBy(*ordering(request.order)).offset(request.start).limit(request.size)


def shown(index: Index, request: SearchRequest) -> list[str]:
    """Fields that a page reads of its documents."""
    stored = [f.name for f in index.mapping.fields if f.stored and f.name in index.docs.columns and (request.fields is None or f.name in request.fields)]
    return stored + [f for f in (request.highlight.fields if request.highlight else ()) if f in index.docs.columns and f not in stored]


def fetched(index: Index, rows: DataFrame, request: SearchRequest) -> DataFrame:
    """A page's rows with stored fields. The page's ids are known first, so that the scan of the documents, which lie in
    ranges of their ids, skips all row groups without one of them."""
    found = rows.collect()  # a page
    index.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(DEEPEST))
    rows = index.spark.createDataFrame(found, rows.schema)
    docs = index.docs.where(F.col("doc_id").isin([r["doc_id"] for r in found]))
    return docs.select("doc_id", "shard_id", *shown(index, request)).join(F.broadcast(rows), "doc_id").orderBy(*ordering(request.order))


def paged(index: Index, request: SearchRequest, principals: list[str] | None = None) -> DataFrame:
    """All pages that follow each other by search_after, from the request's first on: doc_id, score, s0, ..., shard_id and stored
    fields, with `place` in the order (from 0) and `page`. The matches are found and put in order once for all pages."""
    rows = keyed(index, matches(index, request, principals), request.order)
    if request.search_after is not None:
        rows = rows.where(after(request.order, request.search_after))
    uri = scratch(index.spark, "pages")
    rows.orderBy(*ordering(request.order)).withColumn("_at", F.monotonically_increasing_id()).write.parquet(uri)
    rows, before, sums = index.spark.read.parquet(uri), 0, []
    part, rank = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each sorted partition
        sums.append((r["part"], before - request.start))
        before += r["count"]
    sums = index.spark.createDataFrame(sums, "_part long, _before long")
    rows = rows.withColumn("_part", part).join(F.broadcast(sums), "_part").withColumn("place", F.col("_before") + rank).where("place >= 0")
    rows = rows.withColumn("page", F.floor(F.col("place") / request.size).cast("int")).drop("_at", "_part", "_before")
    return index.docs.select("doc_id", "shard_id", *shown(index, request)).join(rows, "doc_id")


def scroll(index: Index, request: SearchRequest, principals: list[str] | None = None) -> Iterator[SearchResponse]:
    """The pages of paged() that have hits, with the totals and facets of all matches."""
    if not request.size:
        return
    whole, uri = search(index, replace(request, start=0, size=0, highlight=None), principals), scratch(index.spark, "scroll")
    try:
        paged(index, request, principals).repartitionByRange("place").sortWithinPartitions("place").write.parquet(uri)
        rows, at = index.spark.read.parquet(uri), 0
        some = max(1, MOST_READ // request.size)
        while found := rows.where(F.col("page").between(at, at + some - 1)).orderBy("place").collect():  # at most MOST_READ or a page
            for n in range(0, len(found), request.size):
                yield replace(whole, hits=hits(index, request, found[n : n + request.size]))
            at += some
    finally:
        Folder(index.spark, uri).delete("")


def hits(index: Index, request: SearchRequest, rows: list[Row]) -> list[Hit]:
    """Hits of fetched rows, with highlights."""
    stored = [f.name for f in index.mapping.fields if request.fields is None or f.name in request.fields]
    out = []
    for r in rows:
        d = r.asDict()
        keys = tuple(d[f"s{i}"] for i in range(len(request.order))) + (d["doc_id"],)
        hit = Hit(d["doc_id"], d["score"], d["shard_id"], {n: d[n] for n in stored if n in d}, keys)
        if request.highlight:
            main = parse(index, request.query)
            for name in request.highlight.fields:
                if isinstance(d.get(name), str) and (ms := matchers(main, name)):
                    analyzer = index.analyzers[index.mapping.by_name[name].index_analyzer()]
                    if got := passages(d[name], ms, analyzer, request.highlight):
                        hit.highlights[name] = got
        out.append(hit)
    return out


def search(index: Index, request: SearchRequest, principals: list[str] | None = None) -> SearchResponse:
    """One page of hits with totals, facets and highlights. The matches are computed once and kept while this runs."""
    query = whole_query(index, request)
    found = matches(index, request, principals).persist()
    try:
        sums = found.agg(F.count("*").alias("n"), F.max("score").alias("top")).first()
        found_rows = fetched(index, page(index, found, request), request).collect() if request.size else []
        named = {}
        for f in request.facets:
            docs = index.docs if isinstance(query, MatchAll) and principals is None else index.docs.join(found.select("doc_id"), "doc_id", "left_semi")
            rows = facet_operators.ranges(docs, f) if f.ranges else facet_operators.terms(docs, index.mapping, f)
            named[f.name] = [r.asDict() for r in rows.collect()]
        return SearchResponse(hits(index, request, found_rows), sums["n"], sums["top"] or 0.0, named)
    finally:
        found.unpersist()


def count(index: Index, query: str | Query | None, principals: list[str] | None = None) -> int:
    return matches(index, SearchRequest(query, size=0), principals).count()
