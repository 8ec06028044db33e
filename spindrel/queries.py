"""The registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import SearchEngine
from .functions.analysis import Analyzer, Registry, exploded, synonym_groups
from .functions.hashing import murmur3_column
from .mapping import FieldMapping, FieldType, IndexMapping
from .operators import facets, search, suggest
from .operators.highlight import Highlight, matchers, passages
from .operators.search import SearchRequest, Sort
from .plans.ast import Boolean, Boost, Clause, ConstantScore, Occur, Query, Term, Terms
from .sources.index import Index, build
from .sources.scratch import scratch
from .sources.store import latest
from .streaming.changes import ChangeFeed

T = FieldType
DOCUMENTS = IndexMapping(
    "documents",
    (
        FieldMapping("text", T.TEXT, "simple"),
        FieldMapping("lang", T.KEYWORD, doc_values=True),
        FieldMapping("source", T.KEYWORD, doc_values=True),
        FieldMapping("n_chars", T.LONG, doc_values=True),
    ),
    shards=4,
)
ENGLISH = IndexMapping("english", (FieldMapping("text", T.TEXT, "english"),))
PARTS = IndexMapping(
    "parts",
    (
        FieldMapping("p_name", T.TEXT, "suggest", "simple", suggest=True),
        FieldMapping("p_brand", T.KEYWORD, doc_values=True),
        FieldMapping("p_type", T.TEXT, "simple", boost=2.0),
        FieldMapping("p_size", T.LONG, doc_values=True),
        FieldMapping("p_retailprice", T.DOUBLE, doc_values=True),
    ),
    default="p_type",
)
ORDERS = IndexMapping("orders", (FieldMapping("o_orderstatus", T.KEYWORD, doc_values=True), FieldMapping("o_orderpriority", T.KEYWORD, doc_values=True), FieldMapping("o_orderdate", T.DATE, doc_values=True), FieldMapping("o_totalprice", T.DOUBLE, doc_values=True)))
TALKS = IndexMapping("talks", (FieldMapping("texts", T.TEXT, "simple"), FieldMapping("roles", T.KEYWORD, doc_values=True)))

_built: dict[tuple[str, str, str], Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, mapping: IndexMapping) -> DataFrame:
    """The documents of a mapping, from the driver's tables."""
    if mapping.name in ("documents", "english"):
        docs = table(spark, sf_dir, "documents")
        return docs.withColumn("acl", F.when(F.col("source").isin("src0", "src1"), F.array("source")).otherwise(F.array().cast("array<string>")))
    if mapping.name == "parts":
        return table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
    if mapping.name == "orders":
        return table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("t.text").alias("texts"), F.col("t.role").alias("roles"))


def index(spark: SparkSession, sf_dir: str, mapping: IndexMapping) -> Index:
    """Built once for a session and folder, as written tables; later queries only read them."""
    key = (spark.sparkContext.applicationId, sf_dir, mapping.name)
    if key not in _built:
        uri = scratch(spark, f"index-{mapping.name}")
        build(source(spark, sf_dir, mapping), mapping, path=f"{uri}/build").save(uri)
        _built[key] = Index.load(spark, uri, mapping)
    return _built[key]


def _page(mapping: IndexMapping, request: SearchRequest, *columns: str, principals: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """doc_id, score to six places, and columns of a page."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = index(spark, sf_dir, mapping)
        rows = search.page(ix, search.matches(ix, request, principals), request)
        found = search.fetched(ix, rows, request) if columns else rows
        return found.select("doc_id", F.round("score", 6).alias("score"), *columns)

    return run


def _all(mapping: IndexMapping, query: str | Query, filter_: str | Query | None = None, principals: list[str] | None = None, kind: str = "dfs_query_then_fetch") -> Callable[[SparkSession, str], DataFrame]:
    """doc_id and score to six places of all matches."""
    return lambda spark, sf: search.matches(index(spark, sf, mapping), SearchRequest(query, filter_, search_type=kind), principals).select("doc_id", F.round("score", 6).alias("score"))


def _terms_of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = exploded(table(spark, sf_dir, "documents"), "text", Registry()[name], "doc_id")
        return tokens.groupBy("term").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("sum_pos"))

    return run


def _facet(mapping: IndexMapping, facet: facets.Facet, query: str | None = None, by_shard: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = index(spark, sf_dir, mapping)
        docs = ix.docs if query is None else ix.docs.join(search.matches(ix, SearchRequest(query)).select("doc_id"), "doc_id", "left_semi")
        if facet.ranges:
            return facets.ranges(docs, facet)
        return (facets.terms_by_shard if by_shard else facets.terms)(docs, mapping, facet)

    return run


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = index(spark, sf_dir, DOCUMENTS)
    return ix.stats.where("field is not null").groupBy("field").agg(F.sum("doc_count").alias("doc_count"), F.sum("sum_len").alias("sum_len"))


def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(index(spark, sf_dir, DOCUMENTS), SearchRequest("the tion er")).agg(F.count("*").alias("total"), F.round(F.max("score"), 6).alias("max_score"))


def suggest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.completions(index(spark, sf_dir, PARTS), "p_name", "sm", 10).select("text", "frequency")


def suggest_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.corrections(index(spark, sf_dir, DOCUMENTS), "teh", 10)


def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id")).withColumn("hash", murmur3_column("doc_id"))
    return hashed.withColumn("shard_id", F.col("hash") % 8)


def versions(events: DataFrame) -> DataFrame:
    """Each user's events as versions of one document; a purchase deletes it."""
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), "event_type", "value", (F.col("event_type") == "purchase").alias("deleted"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(versions(table(spark, sf_dir, "events")).withColumn("deleted", F.lit(False))).select("doc_id", "version", "event_type", "value")


def tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(versions(table(spark, sf_dir, "events"))).select("doc_id", "version", "event_type", "value")


SHOP = IndexMapping("shop", (FieldMapping("text", T.TEXT, "simple"), FieldMapping("lang", T.KEYWORD, doc_values=True)), shards=4)
TRADE = IndexMapping("trade", (FieldMapping("p_type", T.TEXT, "trade"),), synonyms=("promo, economy",))

_engines: dict[tuple[str, str], SearchEngine] = {}


def engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """An engine that has taken in all documents, then changes to a third of them, two of one id in one bulk, and the deletion
    of every fifth, with a refresh after each step. Documents are routed by language."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        made = SearchEngine(spark, scratch(spark, "engine"))
        made.create_index(SHOP)
        made.set_alias("store", "shop")
        docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("lang").alias("routing"))
        made.bulk("store", docs)
        made.refresh("store")
        some = docs.where("doc_id % 3 = 0")
        made.bulk("store", some.withColumn("text", F.lit("passing state")).unionByName(some.withColumn("text", F.concat_ws(" ", F.lit("renewed"), "lang"))))
        made.refresh("store")
        made.delete("store", docs.where("doc_id % 5 = 0").select("doc_id"))
        made.refresh("store")
        _engines[key] = made
    return _engines[key]


def bulk_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search finds through an alias, after upserts and deletions."""
    return search.matches(engine(spark, sf_dir).index("store"), SearchRequest("renewed tion passing")).select("doc_id", F.round("score", 6).alias("score"))


def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the live documents, summed up over segments."""
    stats = engine(spark, sf_dir).index("shop").stats
    return stats.groupBy(F.coalesce("field", F.lit("*")).alias("field")).agg(F.sum("doc_count").alias("doc_count"), F.sum("sum_len").alias("sum_len"))


def routed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shards the documents of a language are in."""
    return engine(spark, sf_dir).index("shop").docs.groupBy(F.get("lang", F.lit(0)).alias("lang")).agg(F.count_distinct("shard_id").alias("shards"), F.count("*").alias("docs"))


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).store("shop").get(*map(str, range(1, 41))).select("doc_id", F.get("text", F.lit(0)).alias("text"))


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of an index made anew from the log alone."""
    store, uri = engine(spark, sf_dir).store("shop"), scratch(spark, "recovered")
    ChangeFeed(store, f"{uri}/index", f"{uri}/checkpoint").drain()
    return Index.load(spark, f"{uri}/index", SHOP).terms.select("field", "term", "df")


def scroll_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches, page after page."""
    request = SearchRequest("renewed", size=500, sort=(Sort("lang", True),), fields=("lang",))
    return engine(spark, sf_dir).pages("shop", request).select("doc_id", F.get("lang", F.lit(0)).alias("lang"), "page")


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered analyzer with synonyms, at indexing and in the query."""
    analyzers = Registry(TRADE.synonyms)
    analyzers.register("trade", Analyzer(lower=True, synonyms=synonym_groups(TRADE.synonyms)))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_type")
    ix = build(docs, TRADE, analyzers)
    return search.matches(ix, SearchRequest("economy")).select("doc_id", F.round("score", 6).alias("score"))


def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of each document of a page."""
    ix = index(spark, sf_dir, DOCUMENTS)
    request = SearchRequest("the tion er", size=20)
    query, spec = search.parse(ix, request.query), Highlight(("text",))
    rows = search.fetched(ix, search.page(ix, search.matches(ix, request), request), request).select("doc_id", "text")
    ms, analyzer = matchers(query, "text"), ix.analyzers["simple"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(i, p) for i, t in zip(b["doc_id"], b["text"], strict=True) for p in passages(t or "", ms, analyzer, spec)]
            yield pd.DataFrame(made, columns=["doc_id", "passage"])

    return rows.mapInPandas(run, "doc_id string, passage string")


def _bool(*clauses: tuple[Occur, Query], min_should: int = 0) -> Boolean:
    return Boolean(tuple(Clause(o, q) for o, q in clauses), min_should)


S, M, N, FL = Occur.SHOULD, Occur.MUST, Occur.NOT, Occur.FILTER
_T = lambda w: Term("text", w)
_SORTED = SearchRequest(None, size=25, sort=(Sort("n_chars", True),))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "analyze_simple": _terms_of("simple"),
    "analyze_standard": _terms_of("standard"),
    "index_stats": index_stats,
    "term_bm25": _all(DOCUMENTS, "tion"),
    "or_bm25": _page(DOCUMENTS, SearchRequest("the tion er", size=20)),
    "and_bm25": _all(DOCUMENTS, "the AND tion"),
    "boost_bm25": _all(DOCUMENTS, "the^2 tion^0.5"),
    "field_boost": _page(PARTS, SearchRequest("p_type:promo", size=20)),
    "constant_score": _all(DOCUMENTS, ConstantScore(Boost(_T("tion"), 3.0), 2.5)),
    "not_query": _all(DOCUMENTS, "+the +tion -er"),
    "filter_score_zero": _all(DOCUMENTS, _bool((S, _T("tion")), (FL, Term("lang", "en")))),
    "query_filter": _all(DOCUMENTS, "the tion", "lang:fr"),
    "min_should_match": _all(DOCUMENTS, _bool((S, _T("the")), (S, _T("tion")), (S, _T("er")), min_should=2)),
    "required_optional": _all(DOCUMENTS, "+the tion"),
    "match_all_sort": _page(DOCUMENTS, _SORTED, "n_chars"),
    "sort_desc_nulls": _page(DOCUMENTS, SearchRequest(None, size=25, sort=(Sort("missing", True), Sort("lang")))),
    "search_after_page": _page(DOCUMENTS, SearchRequest(None, size=25, sort=(Sort("lang", True), Sort("n_chars")), search_after=("es", 1000.0, "5"))),
    "offset_page": _page(DOCUMENTS, SearchRequest("the", start=10, size=10)),
    "prefix": _all(DOCUMENTS, "tio*"),
    "wildcard": _all(DOCUMENTS, "th?r*n"),
    "terms_set": _all(DOCUMENTS, Terms("source", ("src1", "src2", "nowhere"))),
    "term_range": _all(DOCUMENTS, "source:[src1 TO src15}"),
    "numeric_range": _all(DOCUMENTS, "n_chars:{500 TO 2000]"),
    "date_range": _all(ORDERS, "o_orderdate:[1995-01-01 TO 1995-06-30]"),
    "fuzzy_1": _all(DOCUMENTS, "tion~1"),
    "fuzzy_2": _all(DOCUMENTS, "tion~2"),
    "phrase_exact": _all(DOCUMENTS, '"of the"'),
    "phrase_slop": _all(DOCUMENTS, '"of the and"~3'),
    "multivalue_phrase": _all(TALKS, 'texts:"of the"'),
    "facet_terms": _facet(DOCUMENTS, facets.Facet("source", "source", size=8), "tion"),
    "facet_range": _facet(DOCUMENTS, facets.Facet("n", "n_chars", (facets.Range("short", None, 500), facets.Range("mid", 300, 3000), facets.Range("long", 3000, None))), "the"),
    "facet_multivalue": _facet(TALKS, facets.Facet("role", "roles")),
    "facet_numeric": _facet(PARTS, facets.Facet("size", "p_size", size=12)),
    "acl_filter": _all(DOCUMENTS, "tion", principals=["src1"]),
    "total_hits": total_hits,
    "project_fields": _page(DOCUMENTS, SearchRequest("tion", size=15, fields=("lang", "source")), "lang", "source"),
    "suggest_complete": suggest_complete,
    "suggest_correct": suggest_correct,
    "shard_route": shard_route,
    "shard_local_bm25": _all(DOCUMENTS, "the tion", kind="query_then_fetch"),
    "shard_facet_error": _facet(DOCUMENTS, facets.Facet("source", "source", size=3, shard_size=4), by_shard=True),
    "upsert_latest": upsert_latest,
    "tombstone": tombstone,
    "bulk_refresh": bulk_refresh,
    "bulk_delete": bulk_delete,
    "routed_shards": routed_shards,
    "point_get": point_get,
    "recovery": recovery,
    "scroll_all": scroll_all,
    "synonyms": synonyms,
    "prefix_many": _all(DOCUMENTS, "t*"),
    "range_many": _all(DOCUMENTS, "text:[a TO t]"),
    "and_upgrade": _all(DOCUMENTS, "the tion AND er ing"),
    "escapes": _all(DOCUMENTS, r"\"the\" t\ion"),
    "english_bm25": _all(ENGLISH, "searching OR tion"),
    "highlight": highlight,
}

_TOKENS = r"SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Nl}\p{No}\p{Mn}]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Nl}\p{No}\p{Mn}]+'), 1) - 1 AS pos FROM documents"
_STOP = "('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')"
_BASE = f"""
WITH tk AS ({_TOKENS}),
po AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(raw) AS term, count(*) AS tf FROM tk GROUP BY ALL),
ln AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS len FROM tk GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(len) FROM ln) AS avg_len),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT po.doc_id, po.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s
       FROM po JOIN ln USING (doc_id) JOIN dfs USING (term), st),
dc AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, n_chars, text FROM documents)
"""


def _scored(where: str, having: str = "true", weight: str = "s", score: str = "sum") -> str:
    return f"{_BASE} SELECT doc_id, round({score}({weight}), 6) AS score FROM sc WHERE {where} GROUP BY doc_id HAVING {having}"


def _constant(where: str, table_: str = "dc", weight: str = "1.0") -> str:
    return f"{_BASE} SELECT DISTINCT doc_id, CAST({weight} AS DOUBLE) AS score FROM {table_} WHERE {where}"


_LIVE = "(SELECT doc_id, source, lang, n_chars, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', 'renewed', lang) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"


def _murmur(text: str, seed: str = "0") -> str:
    """Murmur3 of an ASCII string, as a DuckDB expression."""
    byte = lambda at: f"ascii(substr({text}, ({at})::INTEGER, 1))::UBIGINT"
    m = "4294967295::UBIGINT"
    turn = lambda x, n: f"(((({x}) << {n}) | (({x}) >> {32 - n})) & {m})"
    mixed = lambda k: f"({turn(f'(({k}) * 3432918353::UBIGINT & {m})', 15)} * 461845907::UBIGINT & {m})"
    block = "+".join(f"{byte(f'4 * i + {j + 1}')} * {256**j}::UBIGINT" for j in range(4))
    blocks = f"list_transform(range(length({text}) // 4), lambda i: {block})"
    step = f"({turn(f'xor(h, {mixed(chr(107))})', 13)} * 5::UBIGINT + 3864292196::UBIGINT) & {m}"
    body = f"list_reduce(list_prepend({seed}::UBIGINT, {blocks}), lambda h, k: {step})"
    at = f"(length({text}) // 4 * 4"
    tail = " + ".join(f"CASE WHEN length({text}) % 4 > {j} THEN {byte(f'{at} + {j + 1})')} * {256**j}::UBIGINT ELSE 0::UBIGINT END" for j in range(3))
    h = f"xor(xor({body}, CASE WHEN length({text}) % 4 > 0 THEN {mixed(tail)} ELSE 0::UBIGINT END), length({text})::UBIGINT)"
    spread = lambda h, by: f"xor({h}, ({h}) >> {by})"
    h = f"(({spread(h, 16)} * 2246822507::UBIGINT) & {m})"
    h = f"(({spread(h, 13)} * 3266489909::UBIGINT) & {m})"
    return spread(h, 16)


def oracle_sql() -> dict[str, str]:
    live = _BASE.replace("FROM documents", f"FROM {_LIVE}")
    fuzzy = lambda most: _scored(f"damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'tion') <= {most}", weight="s * greatest(1 - damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'tion') / 4, 0.1)")
    shard = _murmur("d")
    has = lambda w: f"count(*) FILTER (term = '{w}') > 0"
    keys = "('the', 'tion', 'er')"
    top = lambda values, size: f"SELECT key, count, CAST(0 AS BIGINT) AS error_bound, CAST(total - sum(count) OVER () AS BIGINT) AS other FROM (SELECT *, sum(count) OVER () AS total FROM ({values}) ORDER BY count DESC, key LIMIT {size})"
    return {
        "analyze_simple": f"WITH tk AS ({_TOKENS}) SELECT lower(raw) AS term, count(*) AS n, sum(pos)::BIGINT AS sum_pos FROM tk GROUP BY ALL",
        "analyze_standard": f"WITH tk AS ({_TOKENS}), f AS (SELECT strip_accents(lower(raw)) AS term, pos FROM tk) SELECT term, count(*) AS n, sum(pos)::BIGINT AS sum_pos FROM f WHERE term NOT IN {_STOP} GROUP BY ALL",
        "index_stats": f"WITH tk AS ({_TOKENS}) SELECT 'text' AS field, count(DISTINCT doc_id) AS doc_count, count(*) AS sum_len FROM tk UNION ALL SELECT 'lang', count(lang), count(lang) FROM documents UNION ALL SELECT 'source', count(source), count(source) FROM documents UNION ALL SELECT 'n_chars', count(n_chars), count(n_chars) FROM documents",
        "term_bm25": _scored("term = 'tion'"),
        "or_bm25": f"SELECT * FROM ({_scored(f'term IN {keys}')}) ORDER BY score DESC, doc_id LIMIT 20",
        "and_bm25": _scored("term IN ('the', 'tion')", "count(*) = 2"),
        "boost_bm25": _scored("term IN ('the', 'tion')", weight="CASE term WHEN 'the' THEN 2 ELSE 0.5 END * s"),
        "field_boost": """WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, unnest(string_split(lower(p_type), ' ')) AS term FROM part), po AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), ln AS (SELECT doc_id, count(*) AS len FROM t GROUP BY ALL),
            x AS (SELECT doc_id, tf, len, count(*) OVER () AS df FROM po JOIN ln USING (doc_id) WHERE term = 'promo')
            SELECT doc_id, round(2 * ln(1 + ((SELECT count(*) FROM part) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM ln))), 6) AS score FROM x ORDER BY score DESC, doc_id LIMIT 20""",
        "constant_score": _scored("term = 'tion'", weight="2.5"),
        "not_query": _scored("term IN ('the', 'tion', 'er')", f"{has('the')} AND {has('tion')} AND NOT {has('er')}"),
        "filter_score_zero": f"{_BASE} SELECT dc.doc_id AS doc_id, round(coalesce(s, 0), 6) AS score FROM dc LEFT JOIN sc ON sc.doc_id = dc.doc_id AND term = 'tion' WHERE lang = 'en'",
        "query_filter": f"SELECT q.* FROM ({_scored(chr(116) + 'erm IN (' + repr('the') + ', ' + repr('tion') + ')')}) q JOIN documents d ON CAST(d.doc_id AS VARCHAR) = q.doc_id WHERE lang = 'fr'",
        "min_should_match": _scored(f"term IN {keys}", "count(*) >= 2"),
        "required_optional": _scored("term IN ('the', 'tion')", has("the")),
        "match_all_sort": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score, n_chars FROM documents ORDER BY n_chars DESC NULLS FIRST, CAST(doc_id AS VARCHAR) LIMIT 25",
        "sort_desc_nulls": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score FROM documents ORDER BY lang NULLS LAST, CAST(doc_id AS VARCHAR) LIMIT 25",
        "search_after_page": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang < 'es' OR (lang = 'es' AND (n_chars > 1000 OR (n_chars = 1000 AND CAST(doc_id AS VARCHAR) > '5'))) ORDER BY lang DESC NULLS FIRST, n_chars NULLS LAST, CAST(doc_id AS VARCHAR) LIMIT 25",
        "offset_page": f"""SELECT * FROM ({_scored("term = 'the'")}) ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10""",
        "prefix": _constant("term LIKE 'tio%'", "po"),
        "wildcard": _constant("term LIKE 'th_r%n'", "po"),
        "terms_set": _constant("source IN ('src1', 'src2', 'nowhere')"),
        "term_range": _constant("source >= 'src1' AND source < 'src15'"),
        "numeric_range": _constant("n_chars > 500 AND n_chars <= 2000"),
        "date_range": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 1.0::DOUBLE AS score FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'",
        "fuzzy_1": fuzzy(1),
        "fuzzy_2": fuzzy(2),
        "bulk_refresh": f"{live} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('renewed', 'tion', 'passing') GROUP BY doc_id",
        "bulk_delete": f"{live} SELECT 'text' AS field, count(*) AS doc_count, sum(len)::BIGINT AS sum_len FROM ln UNION ALL SELECT 'lang', count(lang), count(lang) FROM dc UNION ALL SELECT '*', count(*), 0 FROM dc",
        "routed_shards": f"SELECT lang, CAST(CASE WHEN lang IS NULL THEN NULL ELSE 1 END AS BIGINT) AS shards, count(*) AS docs FROM {_LIVE} GROUP BY lang",
        "point_get": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM {_LIVE} WHERE doc_id BETWEEN 1 AND 40",
        "recovery": f"{live} SELECT 'text' AS field, term, df FROM dfs UNION ALL SELECT 'lang', lang, count(*) FROM dc WHERE lang IS NOT NULL GROUP BY lang",
        "scroll_all": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST((row_number() OVER (ORDER BY lang DESC NULLS FIRST, CAST(doc_id AS VARCHAR)) - 1) // 500 AS INTEGER) AS page FROM {_LIVE} WHERE doc_id % 3 = 0",
        "synonyms": """WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, unnest(string_split(lower(p_type), ' ')) AS raw FROM part), x AS (SELECT doc_id, raw AS term FROM t UNION ALL SELECT doc_id, CASE raw WHEN 'promo' THEN 'economy' ELSE 'promo' END FROM t WHERE raw IN ('promo', 'economy')),
            ln AS (SELECT doc_id, count(*) AS len FROM x GROUP BY ALL), po AS (SELECT doc_id, term, count(*) AS tf FROM x WHERE term IN ('promo', 'economy') GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term)
            SELECT doc_id, round(sum(ln(1 + ((SELECT count(*) FROM part) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM ln)))), 6) AS score FROM po JOIN ln USING (doc_id) JOIN dfs USING (term) GROUP BY doc_id""",
        "prefix_many": _constant("term LIKE 't%'", "po"),
        "range_many": _constant("term >= 'a' AND term <= 't'", "po"),
        "and_upgrade": _scored("term IN ('the', 'tion', 'er', 'ing')", "count(*) = 4"),
        "escapes": _scored("term IN ('the', 'tion')"),
        "phrase_slop": f"""{_BASE}, e AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, i, pos - i AS v FROM tk JOIN (VALUES ('of', 0), ('the', 1), ('and', 2)) q(term, i) ON lower(raw) = term),
            m AS (SELECT doc_id, v, {', '.join(f'min(CASE WHEN i = {j} THEN v END) OVER w AS n{j}' for j in range(3))} FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY v, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
            p AS (SELECT doc_id, count(*) AS tf FROM m WHERE n0 IS NOT NULL AND n1 IS NOT NULL AND n2 IS NOT NULL AND greatest(n0, n1, n2) - v <= 3 GROUP BY doc_id)
            SELECT doc_id, round((SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM dfs, st WHERE term IN ('of', 'the', 'and')) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM p JOIN ln USING (doc_id), st""",
        "multivalue_phrase": r"""WITH tk AS (SELECT conv_id, turn, role, text, unnest(regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Nl}\p{No}\p{Mn}]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Nl}\p{No}\p{Mn}]+'), 1) AS pos, r FROM (SELECT *, row_number() OVER () AS r FROM conversations)),
            w AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, r, lower(raw) AS term, pos FROM tk), ln AS (SELECT doc_id, count(*) AS len FROM w GROUP BY doc_id),
            st AS (SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n, (SELECT avg(len) FROM ln) AS avg_len), dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM w WHERE term IN ('of', 'the') GROUP BY term),
            p AS (SELECT a.doc_id, count(*) AS tf FROM w a JOIN w b ON a.r = b.r AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id)
            SELECT doc_id, round((SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM dfs, st) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM p JOIN ln USING (doc_id), st""",
        "shard_route": f"SELECT d AS doc_id, ({shard})::BIGINT AS hash, (({shard}) % 8)::BIGINT AS shard_id FROM (SELECT CAST(doc_id AS VARCHAR) AS d FROM documents)",
        "shard_local_bm25": f"""{_BASE}, sh AS (SELECT d AS doc_id, ({shard}) % 4 AS shard FROM (SELECT CAST(doc_id AS VARCHAR) AS d FROM documents)), sn AS (SELECT shard, count(*) AS n FROM sh GROUP BY shard),
            sl AS (SELECT shard, avg(len) AS avg_len FROM ln JOIN sh USING (doc_id) GROUP BY shard), sd AS (SELECT shard, term, count(*) AS df FROM po JOIN sh USING (doc_id) WHERE term IN ('the', 'tion') GROUP BY ALL)
            SELECT doc_id, round(sum(ln(1 + (sn.n - sd.df + 0.5) / (sd.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / sl.avg_len))), 6) AS score
            FROM po JOIN sh USING (doc_id) JOIN sn USING (shard) JOIN sl USING (shard) JOIN sd USING (shard, term) JOIN ln USING (doc_id) GROUP BY doc_id""",
        "shard_facet_error": f"""WITH c AS (SELECT ({shard}) % 4 AS shard, source AS key, count(*) AS count FROM (SELECT CAST(doc_id AS VARCHAR) AS d, source FROM documents WHERE source IS NOT NULL) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY count DESC, key) AS place FROM c),
            k AS (SELECT key, sum(count)::BIGINT AS count FROM r WHERE place <= 4 GROUP BY key), top AS (SELECT * FROM k ORDER BY count DESC, key LIMIT 3)
            SELECT key, count, (SELECT coalesce(sum(count), 0)::BIGINT FROM r WHERE place = 5) AS error_bound, ((SELECT sum(count) FROM c) - sum(count) OVER ())::BIGINT AS other FROM top""",
        "suggest_complete": r"""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}\p{Mn}]+')) AS w FROM part), x AS (SELECT doc_id, substr(w, 1, n::INTEGER) AS term FROM t, range(1, 21) r(n) WHERE n <= length(w)),
            ln AS (SELECT doc_id, count(*) AS len FROM x GROUP BY doc_id), po AS (SELECT doc_id, count(*) AS tf FROM x WHERE term = 'sm' GROUP BY doc_id), sc AS (SELECT doc_id, ln(1 + ((SELECT count(*) FROM part) - (SELECT count(*) FROM po) + 0.5) / ((SELECT count(*) FROM po) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM ln))) AS s FROM po JOIN ln USING (doc_id)),
            top AS (SELECT * FROM sc ORDER BY s DESC, doc_id LIMIT 50)
            SELECT p_name AS text, count(*) AS frequency FROM top JOIN part ON CAST(p_partkey AS VARCHAR) = top.doc_id WHERE lower(p_name) LIKE 'sm%' OR lower(p_name) LIKE '% sm%' GROUP BY p_name ORDER BY frequency DESC, max(s) DESC, length(p_name), p_name LIMIT 10""",
        "phrase_exact": f"""{_BASE}, w AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(raw) AS term, pos FROM tk),
            p AS (SELECT a.doc_id, count(*) AS tf FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id)
            SELECT doc_id, round((SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM dfs, st WHERE term IN ('of', 'the')) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM p JOIN ln USING (doc_id), st""",
        "facet_terms": top(f"{_BASE} SELECT source AS key, count(*) AS count FROM dc WHERE doc_id IN (SELECT doc_id FROM po WHERE term = 'tion') GROUP BY ALL", 8),
        "facet_range": f"{_BASE}, m AS (SELECT n_chars FROM dc WHERE doc_id IN (SELECT doc_id FROM po WHERE term = 'the')) SELECT 0 AS place, 'short' AS key, count(*) AS count FROM m WHERE n_chars < 500 UNION ALL SELECT 1, 'mid', count(*) FROM m WHERE n_chars >= 300 AND n_chars < 3000 UNION ALL SELECT 2, 'long', count(*) FROM m WHERE n_chars >= 3000",
        "facet_multivalue": top("SELECT role AS key, count(*) AS count FROM conversations GROUP BY ALL", 10),
        "facet_numeric": top("SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS count FROM part GROUP BY ALL", 12),
        "acl_filter": f"""SELECT q.* FROM ({_scored("term = 'tion'")}) q JOIN documents d ON CAST(d.doc_id AS VARCHAR) = q.doc_id WHERE source <> 'src0'""",
        "total_hits": f"SELECT count(*) AS total, max(score) AS max_score FROM ({_scored(f'term IN {keys}')})",
        "project_fields": f"""SELECT q.doc_id AS doc_id, score, lang, source FROM ({_scored("term = 'tion'")}) q JOIN documents d ON CAST(d.doc_id AS VARCHAR) = q.doc_id ORDER BY score DESC, q.doc_id LIMIT 15""",
        "suggest_correct": f"{_BASE} SELECT term AS text, df AS frequency, 1 / (1 + damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'teh')) AS score FROM dfs WHERE damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'teh') <= 1 ORDER BY score DESC, frequency DESC, text LIMIT 10",
        "upsert_latest": "SELECT user_id AS doc_id, event_id AS version, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
        "tombstone": "SELECT user_id AS doc_id, event_id AS version, event_type, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'purchase'",
    }
