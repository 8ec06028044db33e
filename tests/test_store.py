import pytest

from spindrel.engine import SearchEngine
from spindrel.mapping import FieldMapping, FieldType, IndexMapping
from spindrel.operators.search import SearchRequest, Sort
from spindrel.sources.files import Conflict, Folder
from spindrel.sources.index import Index, build

T = FieldType
MAPPING = IndexMapping("shop", (FieldMapping("title", T.TEXT, "simple"), FieldMapping("price", T.LONG, doc_values=True)), shards=2)


def test_bulk_refresh_search_delete(spark, tmp_path):
    engine = SearchEngine(spark, f"file://{tmp_path}")
    engine.create_index(MAPPING)
    engine.set_alias("now", "shop")
    docs = spark.createDataFrame([("a", "red fox", 3, None), ("b", "brown dog", 5, None), ("c", "bad", 1, "x"), (None, "no id", 1, None)], "doc_id string, title string, price int, other string")
    result = engine.bulk("now", docs)
    assert result.accepted == 2 and {r["doc_id"] for r in result.errors.collect()} == {"c", None}
    engine.refresh("now")
    assert engine.search("now", SearchRequest("fox")).total == 1
    old = engine.index("shop")
    engine.bulk("shop", spark.createDataFrame([("a", "green fox", 9)], "doc_id string, title string, price long"))
    engine.delete("shop", spark.createDataFrame([("b",)], "doc_id string"))
    assert engine.search("now", SearchRequest("dog")).total == 1  # not visible before a refresh
    engine.refresh("shop")
    assert [h.fields["title"] for h in engine.search("now", SearchRequest(None)).hits] == [["green fox"]]
    assert {r["doc_id"] for r in engine.store("shop").get("a", "b").collect()} == {"a"}
    assert old.docs.count() == 2  # a search that runs keeps its generation
    engine.refresh("shop")  # nothing new
    with pytest.raises(ValueError):
        engine.create_index(MAPPING)
    with pytest.raises(ValueError):
        engine.set_alias("shop", "shop")
    with pytest.raises(KeyError):
        engine.set_alias("x", "nosuch")
    engine.drop_index("shop")
    assert engine.catalog()["aliases"] == {}


def test_scroll_sees_each_document_once(spark, tmp_path):
    engine = SearchEngine(spark, f"file://{tmp_path}")
    engine.create_index(MAPPING)
    engine.bulk("shop", spark.createDataFrame([(f"doc-{i:02d}", f"widget number {i}", i // 4) for i in range(14)], "doc_id string, title string, price long"))
    engine.refresh("shop")
    pages = list(engine.scroll("shop", SearchRequest("widget", size=5, sort=(Sort("price"),))))
    seen = [h.doc_id for p in pages for h in p.hits]
    assert seen == [f"doc-{i:02d}" for i in range(14)] and [len(p.hits) for p in pages] == [5, 5, 4]


def test_saved_index_scores_alike(spark, tmp_path):
    from spindrel.operators.search import matches

    index = build(spark.createDataFrame([("1", "alpha beta", 1), ("2", "alpha alpha gamma", 2)], "doc_id string, title string, price long"), MAPPING)
    uri = f"file://{tmp_path}/ix"
    assert index.save(uri) == 1
    again = Index.load(spark, uri, MAPPING)
    get = lambda ix, kind: sorted(map(tuple, matches(ix, SearchRequest("alpha", search_type=kind)).collect()))
    for kind in ("dfs_query_then_fetch", "query_then_fetch"):
        assert get(index, kind) == get(again, kind)
    with pytest.raises(FileNotFoundError):
        Index.load(spark, uri, MAPPING, 7)
    with pytest.raises(ValueError):
        Index.load(spark, uri, IndexMapping("other", MAPPING.fields))


def test_a_version_is_committed_once(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/m")
    folder.commit(1, {"x": 1})
    with pytest.raises(Conflict):
        folder.commit(1, {"x": 2})
    assert folder.manifest(1) == {"x": 1}


def test_mapping_rules():
    with pytest.raises(ValueError):
        IndexMapping("x", ())
    assert MAPPING.default_field == "title"
    assert IndexMapping("x", (FieldMapping("k", T.KEYWORD),)).default_field == "k"


def test_the_last_row_of_a_bulk_wins_and_late_batches_lose(spark, tmp_path):
    engine = SearchEngine(spark, f"file://{tmp_path}")
    engine.create_index(MAPPING)
    kind = "doc_id string, title string, price long"
    engine.bulk("shop", spark.createDataFrame([("1", "old words", 1), ("2", "two", 2), ("1", "new words", 3)], kind).coalesce(1))
    engine.refresh("shop")
    assert [h.fields["title"] for h in engine.search("shop", SearchRequest("words")).hits] == [["new words"]]
    store, feed = engine.store("shop"), engine.feed("shop")
    late = store.log().where("doc_id = '2'")
    engine.delete("shop", spark.createDataFrame([("2",)], "doc_id string"))
    engine.refresh("shop")
    assert engine.count("shop", None) == 1
    feed.publish(late, 99)  # an older version that comes late brings nothing back
    assert engine.count("shop", None) == 1 and feed.batches == []


def test_routing_is_kept_and_registered_analyzers_index(spark, tmp_path):
    from spindrel.functions.analysis import Analyzer

    mapping = IndexMapping("own", (FieldMapping("t", T.TEXT, "whole"),), shards=8)
    engine = SearchEngine(spark, f"file://{tmp_path}")
    engine.create_index(mapping)
    engine.register_analyzer("whole", Analyzer(whole=True))
    engine.bulk("own", spark.createDataFrame([(str(i), "Red Fox", "one") for i in range(6)], "doc_id string, t string, routing string"))
    engine.refresh("own")
    index = engine.index("own")
    assert {r["shard_id"] for r in index.docs.collect()} == {r["shard_id"] for r in engine.store("own").log().collect()}
    assert len({r["shard_id"] for r in index.docs.collect()}) == 1 and {r["term"] for r in index.terms.collect()} == {"Red Fox"}


def test_segments_count_as_one_index(spark, tmp_path, monkeypatch):
    import random

    from spindrel.operators.search import matches
    from spindrel.streaming import changes

    monkeypatch.setattr(changes, "MOST_SEGMENTS", 3)
    rng, engine, live = random.Random(3), SearchEngine(spark, f"file://{tmp_path}"), {}
    engine.create_index(MAPPING)
    for _ in range(5):
        rows = {str(rng.randrange(30)): " ".join(rng.choices(["ash", "birch", "cedar"], k=rng.randint(1, 5))) for _ in range(12)}
        live |= rows
        engine.bulk("shop", spark.createDataFrame([(i, t, 1) for i, t in rows.items()], "doc_id string, title string, price long"))
        gone = rng.sample(sorted(live), 3)
        engine.delete("shop", spark.createDataFrame([(i,) for i in gone], "doc_id string"))
        live = {i: t for i, t in live.items() if i not in gone}
        engine.refresh("shop")
        whole = build(spark.createDataFrame([(i, t, 1) for i, t in live.items()], "doc_id string, title string, price long"), MAPPING)
        index = engine.index("shop")
        get = lambda ix: {r["doc_id"]: round(r["score"], 9) for r in matches(ix, SearchRequest("ash cedar")).collect()}
        assert get(index) == get(whole)
        assert {(r["field"], r["term"], r["df"]) for r in index.terms.collect()} == {(r["field"], r["term"], r["df"]) for r in whole.terms.collect()}
        names = ("field", "shard_id", "doc_count", "sum_len")
        assert {tuple(r[n] for n in names) for r in index.stats.collect()} == {tuple(r[n] for n in names) for r in whole.stats.collect()}


def test_an_index_of_another_kind_is_refused(spark, tmp_path):
    uri = f"file://{tmp_path}/ix"
    build(spark.createDataFrame([("1", "a", 1)], "doc_id string, title string, price long"), MAPPING).save(uri)
    with pytest.raises(ValueError, match="mapping"):
        Index.load(spark, uri, IndexMapping("shop", MAPPING.fields[:1], shards=2))
    folder = Folder(spark, uri)
    folder.commit(2, folder.manifest(1) | {"format": 1})
    with pytest.raises(ValueError, match="format"):
        Index.load(spark, uri, MAPPING)


def test_numbers_are_taken_once(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/v")
    assert [folder.take() for _ in range(12)] == list(range(1, 13)) and len(folder.versions()) <= 10


def test_scroll_finds_its_matches_once(spark, tmp_path, monkeypatch):
    from spindrel.operators import search as operators

    engine = SearchEngine(spark, f"file://{tmp_path}")
    engine.create_index(MAPPING)
    engine.bulk("shop", spark.createDataFrame([(f"doc-{i:02d}", "widget", i % 3 or None) for i in range(20)], "doc_id string, title string, price long"))
    engine.refresh("shop")
    request, runs = SearchRequest("widget", size=3, sort=(Sort("price", True),), start=2, fields=("price",)), []
    found = operators.matches
    monkeypatch.setattr(operators, "matches", lambda *a: runs.append(1) or found(*a))
    monkeypatch.setattr(operators, "MOST_READ", 6)
    pages = list(engine.scroll("shop", request))
    assert len(runs) == 2  # for totals and for the order, whatever the number of pages
    order = sorted(range(20), key=lambda i: (-(i % 3 or 9), f"doc-{i:02d}"))[2:]
    assert [[h.doc_id for h in p.hits] for p in pages] == [[f"doc-{i:02d}" for i in order[n : n + 3]] for n in range(0, 18, 3)]
    assert {p.total for p in pages} == {20} and pages[0].hits[-1].sort_values == (None, f"doc-{order[2]:02d}")
    rest = list(engine.scroll("shop", SearchRequest("widget", size=3, sort=request.sort, search_after=pages[0].hits[-1].sort_values)))
    assert [h.doc_id for p in rest for h in p.hits] == [f"doc-{i:02d}" for i in order[3:]]
    framed = {(r["doc_id"], r["page"]) for r in engine.pages("shop", request).collect()}
    assert framed == {(h.doc_id, n) for n, p in enumerate(pages) for h in p.hits}
