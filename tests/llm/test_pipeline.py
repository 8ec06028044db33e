"""The pipeline's stages, each on its own input, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from test_selection import ids_of, plain_components

import corpus_pipeline
from spindrel.llm import components, jaccard, mixing, tokens


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents and labels: clean, shouted, toxic ones, near copies, odd rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(8, 90))]
        kind = ("toxic", "bad", "clean", "clean", "clean", "clean")[i % 6]
        if kind == "bad":
            text = [f"{w.upper()}!!" for w in text]
        if kind == "toxic":
            text.insert(0, "zorgo" + rng.choice(words))
        docs.append((i, " ".join(text), "en", f"s{i % 3}" if i % 2 else "s0", 1))
        labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    clean = [d for d in docs if d[0] % 6 == 2 and len(d[1].split()) > 60]
    docs += [(2000 + i, f"{d[1]} end", "en", "s1", 1) for i, d in enumerate(clean[:20])] + [(3000 + i, clean[0][1], None, None, None) for i in range(30)]
    docs += [(5000, None, None, None, None), (5001, "", "en", "s2", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "mixing", "packing"]


@pytest.mark.parametrize(("stage", "rejected"), [(corpus_pipeline.keep_good, 1), (corpus_pipeline.drop_toxic, 0)])
def test_filters_keep_clean_documents(spark, folder, stage, rejected):
    docs = documents(spark, folder).withColumn("score", F.lit(1))
    out = stage(spark, docs, folder)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    left = {r["doc_id"] for r in out.select("doc_id").collect()}
    of = lambda kind: {i for i in range(900) if i % 6 == kind}
    assert len(left & of(rejected)) <= 3 and len(left & of(3)) >= 147 and {2000, 3000} <= left


def test_one_document_of_each_group_stays(spark, folder):
    docs = documents(spark, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(i for i, (_, c) in plain_components(rows, 5, 4, 5).items() if i == c)
    out = corpus_pipeline.one_of_each(spark, docs.unionByName(docs.where("doc_id < 5")), folder)
    assert out.columns == list(corpus_pipeline.COLUMNS) and sorted(r["doc_id"] for r in out.collect()) == want


def test_mix_gives_each_document_its_copies(spark, folder):
    docs = documents(spark, folder)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    out = corpus_pipeline.mix_sources(spark, docs, folder)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_rows_are_told_apart_by_more_than_their_ids(spark, folder):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d") + " end"), (3, text("d")), (None, text("b")), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, folder).collect()]
    assert sorted(kept, key=str) == sorted([(None, text("a")), (None, text("b")), (5, text("c")), (3, text("d")), (None, None)], key=str)
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    assert {t for _, t in rows if t} == {r["text"] for r in mixed.collect() if r["text"]}


def test_many_partitions_are_staged_in_few_files(spark, folder, monkeypatch):
    """As on a table whose groups are dealt over many partitions that nothing puts together again."""
    files, plain = {}, jaccard.staged

    def counted(df, name, **how):
        found = plain(df, name, **how)
        files.setdefault(name, []).append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(jaccard, "staged", counted)
    monkeypatch.setattr(components, "staged", counted)
    settings = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    want = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, documents(spark, folder), folder).collect())
    files.clear()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, documents(spark, folder), folder).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want and {"classes", "prefixes", "candidates", "edges"} <= set(files)
    assert max(n for each in files.values() for n in each) <= 4 * spark.sparkContext.defaultParallelism < 30


def test_a_worker_remembers_words_for_one_operator():
    jaccard.shingles("some words", 3)
    assert jaccard._words
    assert tokens.encoder(tokens.public_vocabulary()).encode_many(["some words"]) and tokens._encoders
    assert not jaccard._words
    same = tokens.encoder(tokens.public_vocabulary())
    assert same is tokens.encoder(tokens.public_vocabulary()) and same
    jaccard.shingles("some words", 3)
    assert jaccard._words and not tokens._encoders


def test_packing_holds_all_ids(spark, folder):
    docs = documents(spark, folder).where("doc_id < 100 or doc_id >= 5000")
    out = corpus_pipeline.pack_windows(spark, docs, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in out} == {r["doc_id"]: len(ids_of(r["text"], 1)) for r in docs.collect()}


def test_run_applies_all_stages(spark, folder):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert len(got & {i for i in range(900) if i % 6 == 1}) <= 3
    assert not got & set(range(3000, 3030)) and len(got & {i for i in range(900) if i % 6 == 3}) > 60


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_odd_rows_and_empty_tables(spark, folder):
    rows = [(None, "one", "en", "s0", 1), (None, "two", "en", None, 1), (90007, "same", None, "s0", None), (90007, "same", None, "s0", None), (90008, None, "en", "s1", 0), (90009, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage, kept in ((corpus_pipeline.keep_good, 6), (corpus_pipeline.drop_toxic, 6), (corpus_pipeline.one_of_each, 5), (corpus_pipeline.mix_sources, None)):
        out = stage(spark, docs, folder)
        assert out.columns == list(corpus_pipeline.COLUMNS) and kept in (None, out.count())
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.pack_windows(spark, docs.limit(0), folder).count() == 0
