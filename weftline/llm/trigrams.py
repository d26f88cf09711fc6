"""Boolean trigram queries of regular expressions.

A query is a disjunction of conjunctions of trigrams: a set of sets. A text (lower-cased) that matches the expression has all trigrams of
at least one of the inner sets. The query that holds for every text is {{}}: the expression has no mandatory trigram.
"""

from __future__ import annotations

import re
from itertools import product

Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])
#: At most so many strings or conjunctions are followed at once; beyond that a part counts as unknown, which only widens a query.
MOST = 64


def _or(*some: Query) -> Query:
    every = frozenset().union(*some)
    return frozenset(a for a in every if not any(b < a for b in every))


def _and(a: Query, b: Query) -> Query:
    both = _or(frozenset(x | y for x, y in product(a, b)))
    return both if len(both) <= MOST else a


def _of_strings(strings: frozenset[str]) -> Query:
    return _or(*(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings))


def _class(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            out.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> tuple[frozenset[str] | None, Query]:
    """(the strings that the expression matches, if they are few; its query)."""
    exact: frozenset[str] = frozenset([""])
    query, whole = ALWAYS, True
    for kind, value in tree:
        name, strings, more = str(kind), None, ALWAYS
        if name == "LITERAL":
            strings = frozenset([chr(value).lower()])
        elif name == "IN":
            strings = _class(value)
        elif name == "SUBPATTERN":
            strings, more = _walk(value[-1])
        elif name == "BRANCH":
            parts = [_walk(x) for x in value[1]]
            if all(p[0] is not None for p in parts):
                strings = frozenset().union(*(p[0] for p in parts))
            more = _or(*(p[1] if p[0] is None else _of_strings(p[0]) for p in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            inner, need = _walk(body)
            if inner is not None and high == 1:
                strings = inner | {""} if low == 0 else inner
            elif low > 0:
                more = need if inner is None else _of_strings(inner)
        if strings is not None and len(strings) * len(exact) <= MOST:
            exact = frozenset(a + b for a, b in product(exact, strings))
        else:
            query, exact, whole = _and(_and(query, _of_strings(exact)), more), frozenset([""]), False
    return exact if whole else None, _and(query, _of_strings(exact))


def trigram_query(pattern: str) -> Query:
    """The query of a pattern; letters count in either case."""
    return _walk(re._parser.parse(pattern))[1]
