"""Highlights of the few documents of a page."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.analysis import Analyzer, Token
from ..functions.distance import osa
from ..plans.ast import Boolean, Boost, ConstantScore, Fuzzy, Occur, Phrase, Prefix, Query, Term, Terms, Wildcard


@dataclass(frozen=True)
class Highlight:
    fields: tuple[str, ...] = ()
    before: str = "<em>"
    after: str = "</em>"
    size: int = 160
    most: int = 3


Matcher = Callable[[str], bool]


def matchers(query: Query, name: str) -> list[Matcher]:
    """What a query looks for in a field: terms, prefixes, patterns and near terms; not ranges, nor what it excludes."""
    match query:
        case Term(f, t):
            return [t.__eq__] if f == name else []
        case Phrase(f, ts, _) | Terms(f, ts):
            return [set(ts).__contains__] if f == name else []
        case Prefix(f, p):
            return [lambda t: t.startswith(p)] if f == name else []
        case Wildcard(f, p):
            rx = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), re.S)
            return [lambda t: bool(rx.fullmatch(t))] if f == name else []
        case Fuzzy(f, w, k, n):
            return [lambda t: t[:n] == w[:n] and osa(t, w, k) <= k] if f == name else []
        case Boost(inner, _) | ConstantScore(inner, _):
            return matchers(inner, name)
        case Boolean(clauses, _):
            return [m for c in clauses if c.occur is not Occur.NOT for m in matchers(c.query, name)]
    return []


def passages(text: str, found: list[Matcher], analyzer: Analyzer, spec: Highlight) -> list[str]:
    """The best passages: windows around matches that aren't in an earlier one, most matches first."""
    hits: list[Token] = []
    for t in analyzer.tokens(text):
        if any(m(t.term) for m in found) and (not hits or t.start >= hits[-1].end):
            hits.append(t)
    windows, i = [], 0
    while i < len(hits):
        start = max(0, hits[i].start - spec.size // 2)
        end = min(len(text), max(start + spec.size, hits[i].end))
        own = [h for h in hits[i:] if h.end <= end]
        i += len(own)
        while 0 < start < own[0].start and not text[start - 1].isspace():
            start += 1
        while own[-1].end < end < len(text) and not text[end].isspace():
            end -= 1
        windows.append((start, end, own))
    windows.sort(key=lambda w: (-len(w[2]), w[0]))
    out = []
    for start, end, own in windows[: spec.most]:
        parts, at = [], start
        for h in own:
            parts += [text[at : h.start], spec.before, text[h.start : h.end], spec.after]
            at = h.end
        out.append("".join([*parts, text[at:end]]).strip())
    return out
