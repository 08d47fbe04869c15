"""Boolean trigram queries: what every text that a regex matches must hold.

``query(pattern)`` gives ``True`` (no mandatory trigram, so every text is a
candidate), a trigram, or ``("and" | "or", parts)``. Letters are in lower case,
for an index over lower-cased texts.
"""

from __future__ import annotations

import itertools
from re import _constants as c
from re import _parser

#: Exact strings that a part of a pattern may stand for before the set is given up.
MOST = 48
#: Members of a character class that are spelled out.
MOST_CLASS = 6


def _join(kind: str, parts: list):
    flat: list = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "or" and True in flat:
        return True
    flat = [p for i, p in enumerate(flat) if p is not True and p not in flat[:i]]
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, flat)


def _of(strings: set[str]):
    """The query of one of ``strings``; those that hold the trigrams of another add nothing."""
    if any(len(s) < 3 for s in strings):
        return True
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(o < s for o in sets)]
    return _join("or", [_join("and", sorted(s)) for s in sorted(least, key=sorted)])


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            found.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < 2 * MOST_CLASS:
            found |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CLASS else None


def _one(op, arg) -> tuple[set[str] | None, object]:
    """The exact strings of one item, None if there are too many, and its query besides."""
    if op is c.LITERAL:
        return {chr(arg).lower()}, True
    if op is c.IN:
        return _class(arg), True
    if op is c.SUBPATTERN:
        return _sequence(arg[3])
    if op is c.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST:
            return set().union(*(e for e, _ in parts)), True
        return None, _join("or", [_join("and", [_of(e) if e is not None else True, q]) for e, q in parts])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, item = arg
        exact, q = _sequence(item)
        if low == 0:
            return ({""} | exact if high == 1 and exact is not None and q is True else None), True
        if exact is not None and q is True and low == high and len(exact) ** int(low) <= MOST:
            return {"".join(p) for p in itertools.product(exact, repeat=int(low))}, True
        return None, q if exact is None else _join("and", [_of(exact), q])
    if op is c.AT:
        return {""}, True
    return None, True


def _sequence(items) -> tuple[set[str] | None, object]:
    run, queries, whole = {""}, [], True
    for op, arg in items:
        exact, q = _one(op, arg)
        queries.append(q)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        queries.append(_of(run))
        whole = False
        run = exact if exact is not None else {""}
    if whole and _join("and", queries) is True:
        return run, True
    return None, _join("and", [*queries, _of(run)])


def query(pattern: str):
    exact, q = _sequence(_parser.parse(pattern))
    return _of(exact) if exact is not None else q


def trigrams(q) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))
