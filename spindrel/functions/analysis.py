"""Analysis chains, twice with one meaning: over text columns (native expressions) and over a query's few words (Python)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter2 import stem

#: Letters, numbers and non-spacing marks; everything else separates.
TOKEN = r"[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Nl}\p{No}\p{Mn}]+"
_TOKEN = regex.compile(TOKEN)

# The English stop words.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def fold(text: str) -> str:
    """Without the marks that canonical decomposition splits off."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@cache
def folding_table() -> tuple[str, str]:
    """For translate(): characters of the basic plane and what they fold to, then those that go. Hangul folds to itself."""
    one, gone = {}, []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or (to := fold(c)) == c:
            continue
        if to:
            one[c] = to[0]
        else:
            gone.append(c)
    return "".join(one) + "".join(gone), "".join(one.values())


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    return stem(word) or word


_TOKENS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType())]))


def _stemmed(synonyms: dict[str, list[str]]) -> Callable[[Column], Column]:
    """Stems of a document's tokens, after their synonyms; each worker remembers some of the stems it has seen."""

    @F.pandas_udf(_TOKENS)
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: [{"term": _stem(w), "pos": t["pos"]} for t in ts for w in (t["term"], *synonyms.get(t["term"], ()))])

    return run


@dataclass(frozen=True)
class Token:
    term: str
    position: int
    start: int
    end: int


def synonym_groups(rules: tuple[str, ...]) -> dict[str, list[str]]:
    """Word to the others of its groups; a rule is words with commas between, `#` starts a comment."""
    out: dict[str, list[str]] = {}
    for rule in rules:
        if rule.strip().startswith("#"):
            continue
        group = list(dict.fromkeys(w.strip().lower() for w in rule.split(",") if w.strip()))
        if len(group) > 1:
            for w in group:
                out.setdefault(w, []).extend(x for x in group if x != w and x not in out.get(w, []))
    return out


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer and filters, in this order: lower case, folding, stop words, synonyms, stems, beginnings."""

    whole: bool = False
    lower: bool = False
    folding: bool = False
    stop: bool = False
    synonyms: dict[str, list[str]] = field(default_factory=dict, hash=False)
    stems: bool = False
    beginnings: tuple[int, int] | None = None

    def tokens(self, text: str) -> list[Token]:
        found = [Token(text, 0, 0, len(text))] if self.whole and text else [] if self.whole else [Token(m[0], i, m.start(), m.end()) for i, m in enumerate(_TOKEN.finditer(text))]
        out = []
        for t in found:
            w = t.term.lower() if self.lower else t.term
            w = fold(w) if self.folding else w
            if self.stop and w in STOPWORDS:
                continue
            out.extend(replace(t, term=x) for x in self.ending(w))
        return out

    def ending(self, word: str) -> list[str]:
        """The last filters, from synonyms on: the terms that a word becomes."""
        out = []
        for w in (word, *self.synonyms.get(word, ())):
            w = _stem(w) if self.stems else w
            out.extend([w[:n] for n in range(self.beginnings[0], min(self.beginnings[1], len(w)) + 1)] if self.beginnings else [w])
        return out

    def terms(self, text: str) -> list[str]:
        return [t.term for t in self.tokens(text)]

    def column(self, text: Column) -> Column:
        """array<struct<term, pos>> of a text column; null text has no tokens."""
        if self.whole:
            found = F.when(text != "", F.array(F.struct(text.alias("term"), F.lit(0).alias("pos")))).otherwise(F.array().cast("array<struct<term:string,pos:int>>"))
        else:
            found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        change = lambda f: F.transform(found, lambda t: F.struct(f(t["term"]).alias("term"), t["pos"].alias("pos")))
        if self.lower or self.folding:
            low = (lambda x: F.lower(x)) if self.lower else (lambda x: x)
            folded = lambda x: F.when(F.octet_length(x) > F.length(x), F.translate(x, *folding_table())).otherwise(x)  # noqa: E731  most words are ASCII
            found = change((lambda x: folded(low(x))) if self.folding else low)
        if self.stop:
            found = F.filter(found, lambda t: ~t["term"].isin(*STOPWORDS))
        if self.stems:
            found = _stemmed(self.synonyms)(found)
        elif self.synonyms:
            table = F.create_map(*(x for w, others in self.synonyms.items() for x in (F.lit(w), F.array(F.lit(w), *map(F.lit, others)))))
            found = F.flatten(F.transform(found, lambda t: F.transform(F.coalesce(table[t["term"]], F.array(t["term"])), lambda w: F.struct(w.alias("term"), t["pos"].alias("pos")))))
        if self.beginnings:
            lo, hi = self.beginnings
            some = F.filter(found, lambda t: F.length(t["term"]) >= lo)  # sequence() would count down for shorter ones
            found = F.flatten(F.transform(some, lambda t: F.transform(F.sequence(F.lit(lo), F.least(F.lit(hi), F.length(t["term"]))), lambda n: F.struct(F.substring(t["term"], F.lit(1), n).alias("term"), t["pos"].alias("pos")))))
        return found


class Registry:
    """Analyzers by name, without regard to case."""

    def __init__(self, synonyms: tuple[str, ...] = ()):
        standard = Analyzer(lower=True, folding=True, stop=True)
        self._by_name = {
            "keyword": Analyzer(whole=True),
            "simple": Analyzer(lower=True),
            "standard": standard,
            "english": replace(standard, stems=True),
            "suggest": Analyzer(lower=True, folding=True, beginnings=(1, 20)),
        }
        if synonyms:
            self._by_name["synonym"] = replace(standard, synonyms=synonym_groups(synonyms), stems=True)

    def register(self, name: str, analyzer: Analyzer) -> None:
        self._by_name[name.lower()] = analyzer

    def __getitem__(self, name: str) -> Analyzer:
        try:
            return self._by_name[name.lower()]
        except KeyError:
            raise KeyError(f"no analyzer is named {name!r}; there are {', '.join(sorted(self._by_name))}") from None


def exploded(df: DataFrame, text: str, analyzer: Analyzer, *keep: str) -> DataFrame:
    """A row for each token: keep, term, pos."""
    return df.select(*keep, F.explode(analyzer.column(F.col(text))).alias("t")).select(*keep, F.col("t.term").alias("term"), F.col("t.pos").alias("pos"))

