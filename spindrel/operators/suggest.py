"""Completions of what is being typed, and corrections where there is none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import fold, folding_table
from ..functions.distance import within
from ..plans.ast import Term
from ..plans.compiler import Compiler
from ..sources.index import Index
from .search import allowed


@dataclass(frozen=True)
class Suggestion:
    text: str
    score: float
    frequency: int
    correction: bool = False


def completions(index: Index, name: str, text: str, size: int = 5, principals: list[str] | None = None) -> DataFrame:
    """(text, frequency, score): stored values that start with the text, or of which a word does, among the best documents."""
    f = index.mapping.by_name[name]
    if not f.suggest:
        raise ValueError(f"field {name!r} isn't for suggestions")
    typed = fold(text.strip().lower())
    matches = allowed(index, Compiler(index).compile(Term(name, typed)), principals)
    top = matches.orderBy(F.desc("score"), "doc_id").limit(max(5 * size, 20))
    stored = index.docs.join(F.broadcast(top), "doc_id")
    value = F.explode(F.col(name)) if dict(index.docs.dtypes)[name].startswith("array") else F.col(name)
    values = stored.select(value.alias("text"), "score")
    low = F.translate(F.lower("text"), *folding_table())
    fits = F.startswith(low, F.lit(typed)) | F.exists(F.split(low, " "), lambda w: F.startswith(w, F.lit(typed)))
    found = values.where(fits).groupBy("text").agg(F.count("*").alias("frequency"), F.max("score").alias("score"))
    return found.orderBy(F.desc("frequency"), F.desc("score"), F.length("text"), "text").limit(size)


def corrections(index: Index, text: str, size: int = 5) -> DataFrame:
    """(text, frequency, score): terms of the default field few edits away; none, one or two for lengths to 2, to 4, above."""
    typed = fold(text.strip().lower())
    most = 0 if len(typed) <= 2 else 1 if len(typed) <= 4 else 2
    some = within(index.terms.where(F.col("field") == index.mapping.default_field), "term", typed, most)
    found = some.select(F.col("term").alias("text"), F.col("df").alias("frequency"), (1 / (1 + F.col("distance"))).alias("score"))
    return found.orderBy(F.desc("score"), F.desc("frequency"), "text").limit(size)


def suggest(index: Index, name: str, text: str, size: int = 5, correct: bool = True, principals: list[str] | None = None) -> list[Suggestion]:
    if not index.mapping.by_name[name].suggest:
        raise ValueError(f"field {name!r} isn't for suggestions")
    if not text.strip():
        return []
    found = [Suggestion(r["text"], r["score"], r["frequency"]) for r in completions(index, name, text, size, principals).collect()]
    if found or not correct:
        return found
    return [Suggestion(r["text"], r["score"], r["frequency"], True) for r in corrections(index, text, size).collect()]
