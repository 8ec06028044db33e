"""URL filters: rules by host and path, and for the rest naive Bayes over words that Viterbi segmentation finds in names.

Nothing is cut by a size: words are counted in all pages, and names, words and tokens meet by joins. The classifier learns what
the rules say of the URLs that they judge.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# The rules of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: A word of a name has so many letters at most; this bounds what is looked up for each letter of a name.
LONGEST = 32
LETTERS = r"\p{L}+"
_MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (what follows the first ://, up to / ? # or the end, A-Z lower-cased) and path (from there to ? # or the end)."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return lower_ascii(host), re.match(r"[^?#]*", rest[len(host) :])[0]


class Rules:
    """Longest match first: a rule fits its host and all its subdomains, where the path starts with the rule's."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((f"/{path}", rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        labels = host.split(".") if host else []
        for k in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best


def segment(name: str, found: Iterable[tuple[int, int, int]], total: int) -> list[str]:
    """The split of a name with the highest probability (Viterbi). found: (start, length, count) of the known words in it.

    A known word's probability is its share of all counted words; a piece that isn't known is less likely the longer it is,
    ten times for each letter.
    """
    counts = {(start, start + length): n for start, length, n in found}
    best, came = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = counts.get((start, end))
            cost = best[start] + math.log(total + 1) + (-math.log(n) if n else (end - start) * math.log(10))
            if cost < best[end]:
                best[end], came[end] = cost, start
    out, end = [], len(name)
    while end:
        out.append(name[came[end] : end])
        end = came[end]
    return out[::-1]


def runs(text: Column) -> Column:
    """The runs of letters of a text, in lower case; digits and marks only separate."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n) over the text of all pages, without markup."""
    words = pages.select(F.explode(runs(F.regexp_replace("html", _MARKUP, " "))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segments(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words array) of distinct names. The pieces of each name are looked up among all words by a join."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start")
    pieces = names.select("name", places).select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("start") + 1))).alias("length"))
    pieces = pieces.withColumn("word", F.substring("name", F.col("start"), F.col("length")))
    known = pieces.join(words, "word").groupBy("name").agg(F.collect_list(F.struct(F.col("start") - 1, "length", "n")).alias("found"))  # bounded by the name's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[tuple(f.values()) for f in fs or ()] for fs in b.column("found").to_pylist()]
            split = [segment(n, f, total) for n, f in zip(b.column("name").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return names.join(known, "name", "left").select("name", "found").mapInArrow(run, "name string, words array<string>")


def tokens(places: DataFrame, words: DataFrame) -> DataFrame:
    """(host, path, token) for each token of distinct places (host, path): segmented words, those of the path after a slash."""
    marked = lambda text, mark: F.transform(runs(F.col(text)), lambda r: F.struct(F.lit(mark).alias("mark"), r.alias("name")))
    names = places.select("host", "path", F.explode(F.concat(marked("host", ""), marked("path", "/"))).alias("r")).select("host", "path", "r.mark", "r.name")
    split = staged(segments(names.select("name").distinct(), words), "segments")
    return names.join(split, "name").select("host", "path", F.explode("words").alias("word"), "mark").select("host", "path", F.concat("mark", "word").alias("token"))


def held_out() -> Column:
    """A fifth of all places, which the classifier doesn't learn from."""
    return F.crc32(F.concat("host", "path")) % 5 == 0


def weights(found: DataFrame, judged: DataFrame) -> tuple[DataFrame, float]:
    """Multinomial naive Bayes with add-one smoothing: (token, weight), positive where it speaks for blocking, and the prior.

    found: tokens of places; judged: (host, path, blocked) of the places learnt from. A token that none of these has weighs
    nothing, so URLs of unknown words alone are judged by the shares of the classes.
    """
    counts = staged(found.join(judged, ["host", "path"]).groupBy("token").agg(F.count_if("blocked").alias("b"), F.count_if(~F.col("blocked")).alias("a")), "tokens")
    t = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    n = judged.agg(F.count_if("blocked").alias("b"), F.count_if(~F.col("blocked")).alias("a")).first()
    base = math.log((t["a"] + t["v"] + 1) / (t["b"] + t["v"] + 1))
    return counts.select("token", (F.log(F.col("b") + 1) - F.log(F.col("a") + 1) + base).alias("weight")), math.log((n["b"] + 1) / (n["a"] + 1))


def log_odds(places: DataFrame, found: DataFrame, model: tuple[DataFrame, float]) -> DataFrame:
    """(host, path, z) of distinct places: the log odds of blocking."""
    weight, prior = model
    sums = found.join(weight, "token").groupBy("host", "path").agg(F.sum("weight").alias("z"))
    return places.join(sums, ["host", "path"], "left").select("host", "path", (F.coalesce("z", F.lit(0.0)) + prior).alias("z"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block), score (probability of blocking, where no rule fits).

    A null URL, or one without ://, has an empty host and path and no rule, and is judged by the shares of the classes, as are
    URLs without a known word; where these are even, it is allowed. html may be null; rows that are equal are judged alike,
    each in a row of its own, and count once in training; an empty table gives no row; other columns are ignored.
    """
    table = Rules(rules)
    fields = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_url(u) for u in b.column("url").to_pylist()]
            found = [table.find(*s) or (None, None) for s in split]
            columns = [[x[0] for x in split], [x[1] for x in split], [x[0] for x in found], [x[1] for x in found]]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], schema=fields)

    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(ruled, "page_id long, host string, path string, rule string, verdict string")
    parsed = staged(parsed, "urls")
    places = staged(parsed.groupBy("host", "path").agg(F.first("verdict").alias("verdict")), "places")
    found = staged(tokens(places, staged(unigrams(pages), "words")), "url-tokens")
    judged = places.where(F.col("verdict").isNotNull() & ~held_out()).select("host", "path", (F.col("verdict") == "block").alias("blocked"))
    scored = log_odds(places.where("verdict is null"), found, weights(found, judged))
    out = parsed.join(scored, ["host", "path"], "left")
    score = F.when(F.col("rule").isNull(), 1 / (1 + F.exp(-F.col("z"))))
    verdict = F.coalesce("verdict", F.when(F.col("z") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
