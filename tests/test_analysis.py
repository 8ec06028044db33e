import pytest
from pyspark.sql import functions as F

from spindrel.functions.analysis import Registry, folding_table
from spindrel.functions.distance import osa
from spindrel.functions.hashing import murmur3
from spindrel.functions.porter2 import stem

CASES = [
    ("standard", "The Naïve SEARCH of a Fox", ["naive", "search", "fox"]),
    ("english", "Distributed searching systems", ["distribut", "search", "system"]),
    ("keyword", "Home & Garden", ["Home & Garden"]),
    ("simple", "model 3 x1000 v2", ["model", "3", "x1000", "v2"]),
    ("simple", "... -- !!", []),
    ("standard", "résumé Zürich øre", ["resume", "zurich", "øre"]),
    ("suggest", "go", ["g", "go"]),
    ("keyword", "", []),
]


@pytest.mark.parametrize(("name", "text", "terms"), CASES)
def test_query_side(name, text, terms):
    assert Registry()[name].terms(text) == terms


def test_column_side_gives_the_same_tokens(spark):
    registry = Registry(("tv, television, telly",))
    texts = [c[1] for c in CASES] + ["the quick the fox", "cheap tv", None, "a_b-c'd 𝒳𝒴 é́x"]
    for name in ("keyword", "simple", "standard", "english", "suggest", "synonym"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", registry[name].column(F.col("t")).alias("x")).collect()
        for r in rows:
            want = [(t.term, t.position) for t in registry[name].tokens(texts[r["i"]] or "")]
            assert [(t["term"], t["pos"]) for t in r["x"] or []] == want, (name, texts[r["i"]])


def test_stop_words_leave_gaps():
    assert [(t.term, t.position) for t in Registry()["standard"].tokens("the quick the fox")] == [("quick", 1), ("fox", 3)]


def test_synonyms_share_a_position():
    r = Registry(("tv, television, telly", "# none", "alone"))
    assert [t.position for t in r["synonym"].tokens("cheap tv")] == [0, 1, 1, 1]
    assert "televis" in r["synonym"].terms("cheap tv")


def test_names_are_checked():
    assert Registry()["STANDARD"]
    with pytest.raises(KeyError):
        Registry()["nosuch"]


@pytest.mark.parametrize(("word", "want"), [("searches", "search"), ("searched", "search"), ("distributed", "distribut"), ("skies", "sky"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("consistency", "consist"), ("knightly", "knight"), ("by", "by"), ("ties", "tie"), ("gas", "gas"), ("agreed", "agre"), ("happy", "happi"), ("say", "say")])
def test_stems(word, want):
    assert stem(word) == want


def test_folding_table_covers_marks():
    source, to = folding_table()
    assert len(source) > len(to) and dict(zip(source, to, strict=False))["é"] == "e"


@pytest.mark.parametrize(("text", "seed", "want"), [("", 0, 0), ("", 1, 0x514E28B7), ("", 0xFFFFFFFF, 0x81F16F39), ("a", 0x9747B28C, 0x7FA09EA6), ("aaaa", 0x9747B28C, 0x5A97808A), ("abcd", 0x9747B28C, 0xF0478627), ("Hello, world!", 0x9747B28C, 0x24884CBA), ("abc", 0, 0xB3DD93FA)])
def test_murmur_vectors(text, seed, want):
    assert murmur3(text, seed) == want


def test_osa_against_its_recurrence():
    from functools import cache
    from itertools import product

    words = ["".join(w) for n in range(4) for w in product("abc", repeat=n)]

    def plain(a, b):
        @cache
        def d(i, j):
            if not i or not j:
                return i + j
            best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d(i - 2, j - 2) + 1)
            return best

        return d(len(a), len(b))

    for a, b in product(words, words):
        for most in (0, 1, 2):
            assert osa(a, b, most) == min(plain(a, b), most + 1), (a, b, most)
    assert osa("ca", "abc", 3) == 3
