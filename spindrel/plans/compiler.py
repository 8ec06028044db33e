"""Query nodes to plans over index tables: each node becomes a frame (doc_id, score) with a row for each match."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import similarity, within
from ..functions.scoring import idf, tf_factor
from ..sources.index import Index
from .ast import Boolean, Boost, ConstantScore, Fuzzy, MatchAll, MatchNone, NumericRange, Occur, Phrase, Prefix, Query, Term, TermRange, Terms, Wildcard


def back(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def sweep(positions: list[list[int]], slop: int) -> int:
    """How often the terms stand together: positions less their place in the phrase, one of each term at a time; where they
    spread over at most slop it counts, and then the smallest (the first of equals) moves on."""
    lists = [[p - i for p in ps] for i, ps in enumerate(positions)]
    at, found = [0] * len(lists), 0
    while True:
        now = [ps[k] for ps, k in zip(lists, at, strict=True)]
        low = min(now)
        found += max(now) - low <= slop
        i = now.index(low)
        at[i] += 1
        if at[i] == len(lists[i]):
            return found


@dataclass
class Statistics:
    """Numbers that scores need, for all documents (shard None) or for each shard: documents, mean lengths, document frequencies."""

    by_shard: bool
    docs: dict[int | None, int]
    means: dict[tuple[str, int | None], float]
    dfs: Counter = field(default_factory=Counter)

    def shards(self) -> list[int | None]:
        return sorted(self.docs) if self.by_shard else [None]

    def _by_shard(self, value) -> Column:
        """A value for each shard, as a column of shard_id; a literal if there is one for all."""
        if not self.by_shard:
            return F.lit(float(value(None)))
        some = [x for s in self.shards() for x in (F.lit(s), F.lit(float(value(s))))]
        return F.create_map(*some)[F.col("shard_id")] if some else F.lit(0.0)

    def docs_in_shard(self) -> Column:
        return self._by_shard(lambda s: self.docs.get(s, 0))

    def idf(self, name: str, *terms: str) -> Column:
        return self._by_shard(lambda s: sum(idf(self.docs.get(s, 0), self.dfs[name, t, s]) for t in terms))

    def mean(self, name: str) -> Column | float:
        if not self.by_shard:
            return self.means.get((name, None), 0.0)
        return self._by_shard(lambda s: self.means.get((name, s), 0.0) or 1e300)


class Compiler:
    def __init__(self, index: Index, by_shard: bool = False):
        self.index, self.mapping = index, index.mapping
        if (by_shard, "statistics") not in index.memo:
            index.memo[by_shard, "statistics"] = self._statistics(by_shard)
        self.stats: Statistics = index.memo[by_shard, "statistics"]

    def _statistics(self, by_shard: bool) -> Statistics:
        rows = self.index.stats.collect()  # a row for each field and shard
        docs, sums = Counter(), {}
        for r in rows:
            s = r["shard_id"] if by_shard else None
            if r["field"] is None:
                docs[s] += r["doc_count"]
            else:
                n, total = sums.get((r["field"], s), (0, 0))
                sums[r["field"], s] = n + r["doc_count"], total + r["sum_len"]
        return Statistics(by_shard, docs, {k: total / n for k, (n, total) in sums.items() if n})

    def compile(self, query: Query) -> DataFrame:
        """(doc_id, score) of the matches."""
        self._learn(set(query.lookups()))
        return self._node(query, 1.0)

    def _learn(self, pairs: set[tuple[str, str]]) -> None:
        """Document frequencies of the terms that a query names, in one job."""
        new = [p for p in pairs if (*p, "seen") not in self.stats.dfs]
        if not new:
            return
        self.stats.dfs.update({(*p, "seen"): 1 for p in new})
        by_field: dict[str, list[str]] = {}
        for name, term in new:
            by_field.setdefault(name, []).append(term)
        wanted = reduce(lambda a, b: a | b, ((F.col("field") == n) & F.col("term").isin(ts) for n, ts in by_field.items()))
        if self.stats.by_shard:
            rows = self.index.postings.where(wanted).groupBy("field", "term", "shard_id").agg(F.count("*").alias("df")).collect()
        else:
            rows = self.index.terms.where(wanted).select("field", "term", F.lit(None).cast("int").alias("shard_id"), "df").collect()
        for r in rows:
            self.stats.dfs[r["field"], r["term"], r["shard_id"]] = r["df"]

    def _node(self, q: Query, weight: float) -> DataFrame:
        return getattr(self, f"_{type(q).__name__.lower()}")(q, weight)

    def _boosted(self, name: str, weight: float) -> float:
        return weight * self.mapping.by_name[name].boost

    def _matchall(self, q: MatchAll, weight: float) -> DataFrame:
        return self.index.docs.select("doc_id", F.lit(weight).alias("score"))

    def _matchnone(self, q: MatchNone, weight: float) -> DataFrame:
        return self.index.docs.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))

    def _term(self, q: Term, weight: float) -> DataFrame:
        rows = self.index.postings.where((F.col("field") == q.field) & (F.col("term") == q.term))
        return rows.select("doc_id", self._bm25(q.field, q.term, weight).alias("score"))

    def _bm25(self, name: str, term: str, weight: float) -> Column:
        return F.lit(self._boosted(name, weight)) * self.stats.idf(name, term) * tf_factor(F.col("tf"), F.col("len"), self.stats.mean(name))

    def _boost(self, q: Boost, weight: float) -> DataFrame:
        return self._node(q.inner, weight * q.boost)

    def _constantscore(self, q: ConstantScore, weight: float) -> DataFrame:
        return self._node(q.inner, 1.0).select("doc_id", F.lit(q.score * weight).alias("score"))

    def _boolean(self, q: Boolean, weight: float) -> DataFrame:
        """All clauses' matches in one table and one aggregate over it, whatever their number. Plain optional or required
        terms of one field come from a single scan."""
        need, frames = q.needed(), []
        count = Counter(c.occur for c in q.clauses)
        if not count[Occur.MUST] + count[Occur.FILTER] + count[Occur.SHOULD] or count[Occur.SHOULD] < need:
            return self._matchnone(MatchNone(), weight)
        plain: dict[str, list[tuple[int, str]]] = {}
        for i, c in enumerate(q.clauses):
            if isinstance(c.query, Term) and c.query.term not in [t for _, t in plain.get(c.query.field, [])]:
                plain.setdefault(c.query.field, []).append((i, c.query.term))
                continue
            scored = c.occur in (Occur.MUST, Occur.SHOULD)
            frames.append(self._node(c.query, weight).select("doc_id", F.lit(i).alias("clause"), (F.col("score") if scored else F.lit(0.0)).alias("score")))
        for name, some in plain.items():
            rows = self.index.postings.where((F.col("field") == name) & F.col("term").isin([t for _, t in some]))
            clause, score = F.lit(None).cast("int"), F.lit(0.0)
            for i, t in some:
                clause = F.when(F.col("term") == t, i).otherwise(clause)
                if q.clauses[i].occur in (Occur.MUST, Occur.SHOULD):
                    score = F.when(F.col("term") == t, self._bm25(name, t, weight)).otherwise(score)
            frames.append(rows.select("doc_id", clause.alias("clause"), score.alias("score")))
        of = lambda *kinds: [i for i, c in enumerate(q.clauses) if c.occur in kinds]
        counted = lambda kinds: F.count_if(F.col("clause").isin(kinds)) if kinds else F.lit(0)
        required, optional, excluded = of(Occur.MUST, Occur.FILTER), of(Occur.SHOULD), of(Occur.NOT)
        grouped = reduce(DataFrame.unionByName, frames).groupBy("doc_id").agg(F.sum("score").alias("score"), counted(required).alias("r"), counted(optional).alias("o"), counted(excluded).alias("x"))
        return grouped.where((F.col("r") == len(required)) & (F.col("o") >= need) & (F.col("x") == 0)).select("doc_id", "score")

    def _phrase(self, q: Phrase, weight: float) -> DataFrame:
        f = self.mapping.by_name[q.field]
        if not f.positions:
            raise ValueError(f"field {q.field!r} is indexed without positions")
        rows = self.index.postings.where((F.col("field") == q.field) & F.col("term").isin(sorted(set(q.terms))))
        each = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(q.terms)]
        rows = rows.groupBy("doc_id", "shard_id", "len").agg(*each).where(" and ".join(f"p{i} is not null" for i in range(len(q.terms))))
        columns = [F.col(f"p{i}") for i in range(len(q.terms))]
        analyzer = self.index.analyzers[f.index_analyzer()]
        if q.slop or analyzer.synonyms or analyzer.beginnings:
            slop = q.slop

            @F.pandas_udf("int")
            def windows(ps: pd.Series) -> pd.Series:
                return ps.map(lambda p: sweep([list(x) for x in p], slop))

            tf = windows(F.array(*columns))
        else:  # positions of a term are distinct: count those at which all others follow in place
            tf = F.size(reduce(F.array_intersect, (back(c, i) for i, c in enumerate(columns))))
        rows = rows.withColumn("tf", tf).where("tf > 0")
        score = F.lit(self._boosted(q.field, weight)) * self.stats.idf(q.field, *q.terms) * tf_factor(F.col("tf"), F.col("len"), self.stats.mean(q.field))
        return rows.select("doc_id", score.alias("score"))

    def _matching(self, name: str, matching: Column, weight: float) -> DataFrame:
        """Documents with any term that matches, with a constant score."""
        rows = self.index.postings.where((F.col("field") == name) & matching)
        return rows.select("doc_id").distinct().select("doc_id", F.lit(self._boosted(name, weight)).alias("score"))

    def _prefix(self, q: Prefix, weight: float) -> DataFrame:
        return self._matching(q.field, F.col("term").startswith(q.prefix), weight)

    def _terms(self, q: Terms, weight: float) -> DataFrame:
        return self._matching(q.field, F.col("term").isin(list(q.values)), weight)

    def _wildcard(self, q: Wildcard, weight: float) -> DataFrame:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in q.pattern)
        start = re.match(r"[^*?]*", q.pattern)[0]  # the scan may skip what doesn't start like it
        return self._matching(q.field, F.col("term").startswith(start) & F.col("term").rlike(f"(?s)^{pattern}$"), weight)

    def _termrange(self, q: TermRange, weight: float) -> DataFrame:
        t, inside = F.col("term"), F.lit(True)
        if q.lower is not None:
            inside &= t >= q.lower if q.with_lower else t > q.lower
        if q.upper is not None:
            inside &= t <= q.upper if q.with_upper else t < q.upper
        return self._matching(q.field, inside, weight)

    def _numericrange(self, q: NumericRange, weight: float) -> DataFrame:
        name = f"{q.field}__num"
        if name not in self.index.docs.columns:
            return self._matchnone(MatchNone(), weight)
        x = F.col(name)
        inside = x.isNotNull()
        if q.lower is not None:
            inside &= x >= q.lower if q.with_lower else x > q.lower
        if q.upper is not None:
            inside &= x <= q.upper if q.with_upper else x < q.upper
        return self.index.docs.where(inside).select("doc_id", F.lit(weight).alias("score"))

    def _fuzzy(self, q: Fuzzy, weight: float) -> DataFrame:
        """Every expansion is scored as a term, times its likeness to the query's."""
        some = self.index.terms.where((F.col("field") == q.field) & F.col("term").startswith(q.term[: q.prefix]))
        found = within(some, "term", q.term, q.edits).select("term", similarity(F.col("distance"), q.term).alias("like"), "df")
        rows = self.index.postings.where(F.col("field") == q.field)
        if self.stats.by_shard:
            found = found.drop("df")
            dfs = rows.join(found, "term", "left_semi").groupBy("term", "shard_id").agg(F.count("*").alias("df"))
            scored = rows.join(found, "term").join(dfs, ["term", "shard_id"])
        else:
            scored = rows.join(found, "term")
        n = self.stats.docs_in_shard()
        weightless = F.log(1 + (F.greatest(n, F.col("df")) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf_factor(F.col("tf"), F.col("len"), self.stats.mean(q.field))
        score = F.sum(F.lit(self._boosted(q.field, weight)) * weightless * F.col("like"))
        return scored.groupBy("doc_id").agg(score.alias("score"))
