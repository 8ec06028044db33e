"""Neighbours, mixing, packing, n-gram joins, shards and token files."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from spindrel.llm import jaccard, mixing, neighbours, packing, sharding, tokenbin
from spindrel.llm.common import scratch, staged
from spindrel.llm.components import components
from spindrel.llm.tokens import encoder, public_vocabulary


# Neighbours


def vectors(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("part", T.StringType())])
    return spark.createDataFrame([(i, v, "own") for i, v in rows], kind)


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k]
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(230)]
    rows += [(300, None), (400, [0.0] * 8), (500, [float("nan")] * 8), (600, [1.0, None] * 4), (700, [1.0]), (None, [1.0] * 8), (301, rows[0][1]), (302, rows[0][1]), (800, [float("inf")] * 8)]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute(rows, 100, 10)
    assert got.keys() == want.keys() == {0, 100, 200}
    for q, best in want.items():
        assert [got[q][i + 1][1] for i in range(10)] == [i for _, i in best]
        assert [got[q][i + 1][0] for i in range(10)] == pytest.approx([d for d, _ in best], abs=1e-12)
    assert neighbours.nearest(vectors(spark, rows[:4])).count() == 3 and neighbours.nearest(vectors(spark, [])).count() == 0


def test_partitions_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PARTITION_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8)]) for i in range(1500)]
    found = neighbours.nearest(vectors(spark, rows), every=25).toPandas().groupby("query_id")["vec_id"].apply(set)
    want = {q: {i for _, i in best} for q, best in brute(rows, 25, 10).items()}
    assert np.mean([len(found[q] & w) / 10 for q, w in want.items()]) >= 0.9


def routed(x, every, k):
    """Recall and the share of rows that are looked at, with the registered parameters."""
    router = neighbours.fitted(x, len(x), k)
    where = router.probabilities(x).argmax(axis=1)
    asked = np.arange(0, len(x), every)
    wanted = neighbours.mass_before(router.probabilities(x[asked])) < router.mass
    d = ((x[asked][:, None, :] - x[None]) ** 2).sum(axis=2)
    d[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(d, axis=1)[:, :k]
    return np.take_along_axis(wanted, where[near], axis=1).mean(), (wanted * np.bincount(where, minlength=router.parts)).sum(axis=1).mean() / len(x)


def test_registered_parameters_reach_the_recall_and_skip_what_they_can():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 32)) * 2
    recall, share = routed(centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 32)), 20, 10)
    assert recall >= 0.9 and share < 0.4
    recall, share = routed(rng.normal(size=(3000, 32)), 20, 10)  # without any structure most has to be looked at
    assert recall >= 0.9 and share < 1


def test_nothing_finite_is_left_out(spark):
    rows = [(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, 1.0]), (3, [1e200, 1e200]), (4, [1e-200, 1e-200]), (200, [3.0]), (5, [1.0]), (100, [0.0, 2.0])]
    kind = "vec_id long, embedding array<double>, score string"
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], kind)).collect()}
    assert [got[100, i][0] for i in (1, 2, 3, 4)] == [1, 2, 4, 3]  # of two rows with the query's id the smaller one asks
    assert got[100, 4][1] == pytest.approx(2**0.5 * 1e200) and got[200, 1] == (5, 2.0) and len(got) == 5


def test_ties_across_blocks_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    rows = [(i, [1.0, 1.0, float(i == 0)]) for i in range(300)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 11)]


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(200, 4)) + 12 * c for c in np.eye(4)])
    graph = neighbours.neighbour_graph(x, 8)
    label = neighbours.balanced_partition(x, graph, 4)
    assert np.bincount(label).max() <= 210 and (label[graph] == label[:, None]).mean() > 0.9


# Mixing


def test_targets_stop_at_three_times_a_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    limits = {"a": 30, "b": 3000, "c": 300, "d": 0, None: 1500}
    left, open_, want = 1610.0, set(weights), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > limits[s]}
        if not over:
            break
        for s in over:
            want[s], left = float(limits[s]), left - limits[s]
        open_ -= over
    want |= {s: weights[s] * level for s in open_}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1610)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    rows += [(1000, None, "b"), (1001, "\t x\u00a0y \n", "c"), (1000, None, "b"), (None, "one", "a")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs)
    pdf = got.toPandas()
    assert len(pdf) == len(rows) and (pdf["taken"] <= 3 * pdf["size"]).all() and (pdf["taken"] == pdf["copies"] * pdf["size"]).all()
    assert pdf[pdf["doc_id"] == 1001]["size"].tolist() == [1]  # a no-break space isn't white space here
    for _, g in pdf.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 60 and g["source_size"].iloc[0] == g["size"].sum()
    key = lambda p: sorted(map(str, p[["doc_id", "copies"]].values.tolist()))
    assert key(pdf) == key(mixing.mix(docs.repartition(7)).toPandas())
    assert mixing.mix(docs.limit(0)).count() == 0


# Tokens, packing and files


TEXTS = ["Hello, wörld!  it's 42", None, "", "\x0b\u00a0x\x1c<|endoftext|> y", "ﬁ İstanbul ﬀ 1²³ ÅÅ é", "a" * 5000, "word " * 3000]


def test_words_give_the_ids_of_whole_texts():
    words = encoder(public_vocabulary())
    rng = random.Random(8)
    letters = list(" \t\nabZß'’s,.-_!<|>19²éÉœŒÿŸ日ا😀́") + ["the", "'ll", "İ"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for text, data in zip(texts, words.encode_many(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def ids_of(text, end):
    return np.array([*encoder(public_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def token_docs(spark):
    rows = [(10 - i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 2), (100, "again", 3), (100, "again", 3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, offset int")


def test_packing_is_a_partition_of_all_ids(spark):
    rows, docs = token_docs(spark)
    pieces = packing.pack(docs, public_vocabulary(), capacity=64).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for doc_id, text, _ in rows:
        ids = ids_of(text, 1)
        copies = 2 if doc_id == 100 else 1
        own = sorted(by_doc[doc_id], key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == copies * len(ids) and all(p["doc_tokens"] == len(ids) for p in own)
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        if copies == 1:
            assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total == 64 or total & (total - 1) == 0
    assert packing.pack(docs.limit(0), public_vocabulary()).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(9)
    assert sorted(sum(x) for x in [[[8, 7, 6, 5, 4][i] for i in p] for p in packing.differencing([8, 7, 6, 5, 4], 2)]) == [14, 16]
    for k in (1, 3, 10):
        sizes = [rng.randint(1, 500) for _ in range(200)]
        parts = packing.differencing(sizes, k)
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(200)) and max(sums) - min(sums) < 25
    assert len(packing.differencing([5], 3)) == 3 and packing.differencing([], 2) == [[], []]


def test_whole_windows_rise_until_they_fit():
    sizes = [60, 60, 60, 50, 50, 20]
    windows = packing.whole_windows(sizes, 100)
    assert all(sum(sizes[i] for i in w) <= 100 for w in windows) and len(windows) > 3


@pytest.mark.parametrize("vocabulary", [1, 2, 300, 49408, 65536, 65537, 1 << 20])
def test_bit_packing_round_trip(vocabulary):
    rng = np.random.default_rng(1)
    bits = tokenbin.bits_for(vocabulary)
    assert vocabulary <= 1 << bits and (vocabulary == 1 or vocabulary > 1 << (bits - 1) or bits == 1)
    ids = rng.integers(0, vocabulary, 1001).astype(np.uint32)
    data = tokenbin.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and np.array_equal(tokenbin.unpack(data, len(ids), bits), ids)


def test_random_access(tmp_path):
    from pyarrow import fs

    rng, local = np.random.default_rng(3), fs.LocalFileSystem()
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 700, 33, 2000, 0)]
    with local.open_output_stream(str(tmp_path / "x.tok")) as out:
        w = tokenbin.Writer(out, 13, block=256)
        for i, d in enumerate(docs):
            w.add(i, d)
        w.close()
    with local.open_input_file(str(tmp_path / "x.tok")) as f:
        r, all_ids = tokenbin.Reader(f), np.concatenate(docs)
        assert r.doc_ids.tolist() == list(range(6)) and all(np.array_equal(r.document(i), d) for i, d in enumerate(docs))
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(all_ids) + 1, 2).tolist())
            assert np.array_equal(r.ids(a, b), all_ids[a:b])


def test_every_id_survives_and_each_file_is_read_by_a_task_of_its_own(spark):
    rows = [(-(1 << 63), "lowest"), (None, "none"), ((1 << 63) - 1, "highest"), *((i, f"text {i}") for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenbin.token_files(docs, public_vocabulary()).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -(1 << 63), *range(300), (1 << 63) - 1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenbin.write_tokens(docs, public_vocabulary(), 2, scratch(spark, "tokens"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and tokenbin.read_digests(manifest).rdd.getNumPartitions() == manifest.count()


def test_token_files_round_trip(spark):
    rows, docs = token_docs(spark)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.token_files(docs, public_vocabulary()).collect())
    at, want = 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text, 2)
        want.append((at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert tokenbin.token_files(docs.limit(0), public_vocabulary()).count() == 0


# N-gram joins


def plain_components(rows, k, num, den):
    def shingles(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_groups_against_all_pairs(spark, k, num, den):
    rng = random.Random(k)
    common = [f"c{i}" for i in range(60)]
    rows, base = [], [f"b{i}" for i in range(140)]
    for _ in range(60):  # a large group of near copies of one text, some too far from it
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append(w)
    for _ in range(30):  # short texts around a common passage
        rows.append(common[: rng.randint(40, 60)] + [f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 12))])
    for _ in range(30):  # chains
        rows.append(base[: rng.randint(60, 140)])
    for _ in range(40):
        rows.append([f"r{rng.randrange(300)}" for _ in range(rng.randint(1, 30))])
    texts = [" ".join(w) for w in rows] + ["", None, "one", "ONE", "two words", "two  words\n", "Éa éa"] + [" ".join(base)] * 5
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, sig string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs.repartition(5), k, num, den).collect()}
    assert got == plain_components(rows, k, num, den)


def test_no_documents_and_no_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.near_duplicates(docs).orderBy("n_shingles").collect()] == [(None, 0, None), (None, 1, None)]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_more_matches_are_asked_for_where_candidates_are_many():
    order = jaccard.Order(np.arange(10, 40, dtype=np.uint64), np.full(30, 500))
    few = order.keys(np.arange(1000, 1040, dtype=np.uint64))
    many = order.keys(np.concatenate([np.arange(10, 40), np.arange(1000, 1010)]).astype(np.uint64))
    assert order.matches(few, 5)[0] == 1
    assert order.matches(many, 15)[0] > 1
    assert (many[:10] >= 1000).all() and many[10] >= 1 << 62


def test_a_large_group_gives_few_candidates(spark, monkeypatch):
    """2,000 near copies of one text, dealt in blocks: candidates stay below a multiple of the rows, components are right."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 300)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    made, plain = [], jaccard.Join.candidates

    def counted(self, df, most=None):
        made.append(found := staged(plain(self, df, most), "counted"))
        return found

    monkeypatch.setattr(jaccard.Join, "candidates", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 1, 9, 10).collect()}
    assert sum(c.count() for c in made) < 40_000  # of 2 million pairs
    sets = np.zeros((2000, 100), np.float32)
    for i, t in rows:
        sets[i, [int(w[1:]) + (60 if w[0] == "e" else 0) for w in set(t.split())]] = 1
    common, n = sets @ sets.T, sets.sum(axis=1)
    links = np.argwhere(10 * common >= 9 * (n[:, None] + n[None, :] - common))
    root = list(range(2000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert got == {i: find(i) for i in range(2000)}


def test_forest_spans_and_has_no_cycle():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (30, 20), (40, 400), (500, 600)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        chosen, label = jaccard.forest(a, b, n)
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in np.flatnonzero(chosen):
            assert find(a[i]) != find(b[i])
            root[find(a[i])] = find(b[i])
        assert all(find(x) == find(y) for x, y in zip(a, b, strict=True))
        assert len(set(label)) == len({find(i) for i in range(n)}) and all((label[x] == label[y]) for x, y in zip(a, b, strict=True))


def test_sketches_fold_and_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 200, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[: size // 2], rng.integers(0, 1 << 62, size // 3).astype(np.uint64)]))
        p, q = jaccard.sketch(x), jaccard.sketch(y)
        apart = np.bitwise_count(jaccard.folded(p, len(q)) ^ jaccard.folded(q, len(p))).sum()
        assert apart <= len(np.setxor1d(x, y))
        assert len(jaccard.folded(p, 32)) == 4


def test_very_long_texts_are_linked(spark):
    words = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(words), " ".join([*words[:30_000], "odd", *words[30_001:]]), " ".join(words[:20_000]), "short text"]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs).collect())
    assert got == [(0, 59_996, 0), (1, 59_996, 0), (1, 59_996, 0), (2, 19_996, 2), (3, 1, 3)]


def test_components_against_a_plain_search(spark):
    rng = random.Random(12)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, x) for x in range(501, 520)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    near = {}
    for u, v in links:
        if u is not None and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want = {}
    for start in sorted(near):
        stack = [start] if start not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += near[x]
    assert got == want


# Shards


def test_store_appends_compacts_and_keeps_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=60_000, smallest=8_000, shard_rows=40)
    kind = "doc_id long, text string, path string, rows int"
    made = []
    for batch in range(3):
        rows = [(1000 * batch + i, random.Random(i).randbytes(60).hex() if i % 9 else None, "p", i) for i in range(200)]
        made += rows
        store.append(spark.createDataFrame(rows + rows[:1], kind).repartition(3))
        made += rows[:1]
    before = store.manifest()
    after = store.compact()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.read()) == key(spark.createDataFrame(made, kind)) == key(store.read(before["version"]))
    assert len(after["shards"]) < len(before["shards"]) / 3 and sum(s.rows for s in after["shards"]) == len(made)
    assert sharding.plan_merges(after["shards"], 60_000, 4, 8_000) == []
    with pytest.raises(sharding.CommitConflict):
        store.commit(before, before["shards"], before["schema"])
    assert store.vacuum(keep=1) == len(before["shards"]) and key(store.read()) == key(spark.createDataFrame(made, kind))
    empty = sharding.compacted(spark.createDataFrame([], kind), f"file://{tmp_path}/e")
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "path", "rows"]


def test_writers_that_meet_keep_their_work_and_schemas_grow(spark, tmp_path):
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/s", target=60_000, smallest=8_000, shard_rows=10) for _ in range(2))
    store.append(spark.createDataFrame([(i, "x" * 50) for i in range(60)], "id long, t string"))
    plain = store.commit
    met = []

    def commit(base, shards, schema):
        if not met:  # another writer is first, once
            met.append(other.append(spark.createDataFrame([(100 + i, None, (1, "n")) for i in range(5)], "id long, t string, `a.b` struct<u int, v string>")))
        return plain(base, shards, schema)

    store.commit = commit
    store.append(spark.createDataFrame([(200, "late")], "id long, t string"))
    met.clear()
    store.compact()
    got = {r["id"]: (r["t"], r["a.b"]) for r in store.read().collect()}
    assert set(got) == {*range(60), *range(100, 105), 200} and got[100] == (None, (1, "n")) and got[200] == ("late", None)
    with pytest.raises(ValueError, match="column id"):
        store.append(spark.createDataFrame([("x",)], "id string"))


def test_merges_are_of_similar_sizes():
    shards = [sharding.Shard(f"s{i}", 1, 5) for i in range(3)] + [sharding.Shard(f"m{i}", 1, 40) for i in range(4)] + [sharding.Shard("l", 1, 190)]
    assert [sorted(s.path for s in g) for g in sharding.plan_merges(shards, 200, 4, 10)] == [["m0", "m1", "m2", "m3"]]
    assert Counter(len(g) for g in sharding.plan_merges([sharding.Shard(f"s{i:02d}", 1, 5) for i in range(90)], 200, 4, 10)) == {44: 2}

