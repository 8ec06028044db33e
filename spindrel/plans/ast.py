"""Query nodes. describe() prints the canonical form; lookups() gives the (field, term) pairs whose statistics are needed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum


class Occur(Enum):
    SHOULD, MUST, NOT, FILTER = "", "+", "-", "#"


def plain(x: float | None) -> str:
    return "*" if x is None else str(int(x)) if x == int(x) else repr(x)


class Query:
    def describe(self) -> str:
        raise NotImplementedError

    def lookups(self) -> Iterator[tuple[str, str]]:
        return iter(())


@dataclass(frozen=True)
class MatchAll(Query):
    def describe(self) -> str:
        return "*:*"


@dataclass(frozen=True)
class MatchNone(Query):
    def describe(self) -> str:
        return "()"


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str

    def describe(self) -> str:
        return f"{self.field}:{self.term}"

    def lookups(self) -> Iterator[tuple[str, str]]:
        yield self.field, self.term


@dataclass(frozen=True)
class Boost(Query):
    inner: Query
    boost: float

    def describe(self) -> str:
        return f"{self.inner.describe()}^{plain(self.boost)}"

    def lookups(self) -> Iterator[tuple[str, str]]:
        return self.inner.lookups()


@dataclass(frozen=True)
class ConstantScore(Query):
    inner: Query
    score: float = 1.0

    def describe(self) -> str:
        return f"ConstantScore({self.inner.describe()})"

    def lookups(self) -> Iterator[tuple[str, str]]:
        return self.inner.lookups()


@dataclass(frozen=True)
class Clause:
    occur: Occur
    query: Query


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[Clause, ...]
    min_should: int = 0

    def describe(self) -> str:
        return "(" + " ".join(c.occur.value + c.query.describe() for c in self.clauses) + ")"

    def lookups(self) -> Iterator[tuple[str, str]]:
        for c in self.clauses:
            if c.occur is not Occur.NOT:
                yield from c.query.lookups()

    def needed(self) -> int:
        """Optional clauses that must match: as told, else none beside required ones, else one."""
        return self.min_should or int(not any(c.occur in (Occur.MUST, Occur.FILTER) for c in self.clauses))


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    terms: tuple[str, ...]
    slop: int = 0

    def describe(self) -> str:
        return f'{self.field}:"{" ".join(self.terms)}"' + (f"~{self.slop}" if self.slop else "")

    def lookups(self) -> Iterator[tuple[str, str]]:
        return ((self.field, t) for t in self.terms)


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str

    def describe(self) -> str:
        return f"{self.field}:{self.prefix}*"


@dataclass(frozen=True)
class Terms(Query):
    field: str
    values: tuple[str, ...]

    def describe(self) -> str:
        return f"{self.field}:({' OR '.join(self.values)})"

    def lookups(self) -> Iterator[tuple[str, str]]:
        return ((self.field, t) for t in self.values)


@dataclass(frozen=True)
class Wildcard(Query):
    field: str
    pattern: str

    def describe(self) -> str:
        return f"{self.field}:{self.pattern}"


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str
    term: str
    edits: int = 2
    prefix: int = 0

    def describe(self) -> str:
        return f"{self.field}:{self.term}~{self.edits}"


@dataclass(frozen=True)
class NumericRange(Query):
    field: str
    lower: float | None = None
    upper: float | None = None
    with_lower: bool = True
    with_upper: bool = True

    def describe(self) -> str:
        return f"{self.field}:{'[' if self.with_lower else '{'}{plain(self.lower)} TO {plain(self.upper)}{']' if self.with_upper else '}'}"


@dataclass(frozen=True)
class TermRange(Query):
    field: str
    lower: str | None = None
    upper: str | None = None
    with_lower: bool = True
    with_upper: bool = True

    def describe(self) -> str:
        star = lambda x: "*" if x is None else x
        return f"{self.field}:{'[' if self.with_lower else '{'}{star(self.lower)} TO {star(self.upper)}{']' if self.with_upper else '}'}"
