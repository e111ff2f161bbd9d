"""Boolean trigram queries of regexes: which three-letter strings a text must hold to match.

A query is a set of clauses, one of which must hold in full: a set of sets of trigrams. None: any text may match. Letters
are compared in lower case, so that one index serves rules with and without regard to case."""

from __future__ import annotations

import re
from itertools import product

#: Strings that one part of a regex is written out to at most; beyond it the part is left open.
STRINGS = 24

Query = frozenset[frozenset[str]] | None


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x, y in product(a, b)) if len(a) * len(b) <= STRINGS else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _join(parts: list[set[str] | None]) -> tuple[set[str] | None, Query]:
    """Strings of a sequence (None: unknown), and the query of its known stretches."""
    query, run, whole = None, {""}, True
    for p in parts:
        both = None if p is None else {a + b for a, b in product(run, p)}
        if both is None or len(both) > STRINGS:
            query, whole = _and(query, _of_strings(run)), False
            run = {""} if p is None else p
        else:
            run = both
    return (run if whole else None), _and(query, _of_strings(run))


def _walk(items) -> tuple[set[str] | None, Query]:
    parts: list[set[str] | None] = []
    query: Query = None
    for op, value in items:
        name, strings, more = str(op), None, None
        if name == "LITERAL":
            strings = {chr(value).lower()}
        elif name == "IN":
            strings = set()
            for kind, x in value:
                if str(kind) == "LITERAL":
                    strings.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < STRINGS:
                    strings |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    strings = None
                    break
        elif name == "SUBPATTERN":
            strings, more = _walk(value[-1])
        elif name == "BRANCH":
            found = [_walk(b) for b in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*[s for s, _ in found])
            more = None if any(q is None for _, q in found) else frozenset().union(*[q for _, q in found])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = value
            inner, inner_query = _walk(sub)
            if inner is not None and high <= 2:
                strings = {"".join(t) for n in range(low, high + 1) for t in product(inner, repeat=n)}
            more = inner_query if low else None
            if strings is None and inner is not None and low and len(inner) ** low <= STRINGS:
                parts.append({"".join(t) for t in product(inner, repeat=low)})
        elif name in ("AT", "ASSERT_NOT"):
            strings = {""}
        if strings is not None and len(strings) > STRINGS:
            strings = None
        parts.append(strings)
        query = _and(query, more)
    strings, own = _join(parts)
    return strings, _and(query, own)


def query_of(regex: str) -> Query:
    strings, query = _walk(re._parser.parse(regex))
    return _and(query, _of_strings(strings) if strings else None)
