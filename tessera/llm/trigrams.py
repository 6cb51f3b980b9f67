"""Boolean trigram queries that a text has to meet if a regular expression is to match in it.

A query is in disjunctive form: a list of sets of trigrams, of which one has to be in the lower-cased text as a whole.
``[frozenset()]`` asks for nothing: the expression has no mandatory trigram.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

#: Strings that an expression may be spelled out into, and members of a character class likewise.
MOST_STRINGS, MOST_CHARS = 64, 8

Query = list[frozenset[str]]
ANY: Query = [frozenset()]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(q: list[frozenset[str]]) -> Query:
    """Without alternatives that another one covers."""
    return [a for i, a in enumerate(q) if not any(b < a or (b == a and j < i) for j, b in enumerate(q))]


def _both(a: Query, b: Query) -> Query:
    out = _least([x | y for x in a for y in b])
    return out if len(out) <= MOST_STRINGS else a


def _of_strings(strings: set[str]) -> Query:
    return _least([trigrams(s) for s in strings])


def _times(a: set[str], b: set[str] | None) -> set[str] | None:
    out = {x + y for x in a for y in b} if b is not None and len(a) * len(b) <= MOST_STRINGS else None
    return out


def _class(members: list) -> set[str] | None:
    out: set[str] = set()
    for kind, v in members:
        if kind is C.LITERAL:
            out.add(chr(v).lower())
        elif kind is C.RANGE and v[1] - v[0] < MOST_CHARS:
            out |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _strings(kind, v) -> set[str] | None:
    """All lower-cased strings that a part can match, if they are few."""
    if kind is C.LITERAL:
        return {chr(v).lower()}
    if kind is C.IN:
        return _class(v)
    if kind is C.AT:
        return {""}
    if kind is C.SUBPATTERN:
        return _sequence_strings(v[3])
    if kind is C.BRANCH:
        found = [_sequence_strings(x) for x in v[1]]
        out = set().union(*found) if None not in found else None
        return out if out is not None and len(out) <= MOST_STRINGS else None
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = v
        one = _sequence_strings(inner)
        if one is None or high is C.MAXREPEAT or high > 4:
            return None
        out: set[str] = set()
        now: set[str] | None = {""}
        for k in range(high + 1):
            out |= now if k >= low else set()
            now = _times(now, one)
            if now is None:
                return None
        return out if len(out) <= MOST_STRINGS else None
    return None


def _sequence_strings(items) -> set[str] | None:
    out: set[str] | None = {""}
    for kind, v in items:
        out = _times(out, _strings(kind, v))
        if out is None:
            return None
    return out


def _inner(kind, v) -> Query:
    if kind is C.SUBPATTERN:
        return _sequence(v[3])
    if kind is C.BRANCH:
        return _least([x for branch in v[1] for x in _sequence(branch)])
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and v[0] >= 1:
        return _sequence(v[2])
    return ANY


def _sequence(items) -> Query:
    query, run = ANY, {""}
    for kind, v in items:
        strings = _strings(kind, v)
        longer = _times(run, strings)
        if longer is not None:
            run = longer
            continue
        query = _both(query, _of_strings(run))
        query, run = (query, strings) if strings is not None else (_both(query, _inner(kind, v)), {""})
    return _both(query, _of_strings(run))


def query(pattern: str) -> Query:
    return sorted(_sequence(_parser.parse(pattern)), key=sorted)
