"""Postings from blocks against those of documents that are dealt by id."""

import random

import pytest
from pyspark.sql import functions as F

from spindrel.functions.analysis import Analyzer, Registry, synonym_groups
from spindrel.mapping import FieldMapping, FieldType, IndexMapping
from spindrel.sources import blocks
from spindrel.sources import index as indexes
from spindrel.sources.index import build

T = FieldType
MAPPING = IndexMapping(
    "mixed",
    (
        FieldMapping("title", T.TEXT, "english"), FieldMapping("parts", T.TEXT, "standard"), FieldMapping("both", T.TEXT, "all"), FieldMapping("start", T.TEXT, "suggest"),
        FieldMapping("kind", T.KEYWORD, doc_values=True), FieldMapping("marks", T.KEYWORD, positions=False), FieldMapping("price", T.DOUBLE, doc_values=True), FieldMapping("at", T.DATE, doc_values=True),
    ),
    shards=3,
    synonyms=("fast, quick",),
)
KIND = "doc_id string, title string, parts array<string>, both array<string>, start string, kind string, marks array<string>, price double, at timestamp"


def analyzers():
    made = Registry(MAPPING.synonyms)
    made.register("all", Analyzer(lower=True, stop=True, stems=True, synonyms=synonym_groups(("fast, quick",)), beginnings=(2, 5)))
    return made


def some(spark, n=90):
    from datetime import datetime

    rng = random.Random(5)
    words = ["running", "runs", "the", "fast", "quick", "Über", "ox", "a", "𝒳𝒴", "of", "ß"]
    text = lambda: rng.choice([None, "", "the", " ".join(rng.choices(words, k=rng.randint(1, 30)))])
    many = lambda: rng.choice([None, [], [text() for _ in range(rng.randint(1, 4))]])
    rows = [(f"d{i}", text(), many(), many(), text(), rng.choice([None, "", "x", "y"]), rng.choice([None, ["p", "p", "q"], [None, "r"]]), rng.choice([None, 1.0, 2.5]), rng.choice([None, datetime(2020, 1, 1 + i % 9)])) for i in range(n)]
    return spark.createDataFrame(rows, KIND).repartition(5)


def told(index):
    plain = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in r)
    return (sorted(map(plain, index.postings.collect()), key=str), sorted(map(plain, index.terms.collect()), key=str), sorted(((r["field"], r["shard_id"], r["doc_count"], r["sum_len"]) for r in index.stats.collect()), key=str))


@pytest.mark.parametrize("tokens", [25, 600_000])
def test_blocks_hold_the_same_postings(spark, tmp_path, monkeypatch, tokens):
    monkeypatch.setattr(blocks, "MOST_TOKENS", tokens)
    monkeypatch.setattr(indexes, "pieces", lambda spark, size: 7)
    docs = some(spark).cache()
    made = build(docs, MAPPING, analyzers(), path=f"file://{tmp_path}/b")
    assert told(made) == told(build(docs, MAPPING, analyzers()))
    again = [r for f in sorted((tmp_path / "b" / "postings").glob("part-*.parquet")) for r in spark.read.parquet(f"file://{f}").collect()]
    assert len([f for f in (tmp_path / "b" / "postings").glob("part-*.parquet")]) > 3  # ranges of terms, not one task
    order = [(r["field"], r["term"].encode()) for r in again]
    assert order == sorted(order)


def test_repeated_ids_are_summed_up(spark, tmp_path):
    docs = some(spark, 20).cache()
    twice = docs.unionByName(docs.where("doc_id = 'd3'"))
    assert told(build(twice, MAPPING, analyzers(), path=f"file://{tmp_path}/b")) == told(build(twice, MAPPING, analyzers()))


def test_empty_tables(spark, tmp_path):
    made = build(some(spark).where("false"), MAPPING, analyzers(), path=f"file://{tmp_path}/b")
    assert told(made) == ([], [], [])


def test_nothing_sorts_or_deals_tokens(spark, tmp_path):
    """F4 to F12: a group of tokens by document and term sorted, and spilled, all tokens of a task."""
    fields = list(MAPPING.fields)
    docs = some(spark).withColumn("shard_id", F.lit(0))
    plan = blocks.packed(docs, fields, analyzers(), [])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan and plan.count("Exchange ") <= 1  # that of repartition() here
    assert "ArrowEvalPython" not in plan  # stems of all words of 10,000 texts as Python objects
