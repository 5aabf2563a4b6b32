"""From a regular expression to the Boolean trigram query that every match satisfies.

The driver parses each rule once.  A node of the syntax tree gives either the finite set of strings that it can match
(while that stays small) or a query: ALL (nothing is mandatory) or an OR of ANDs of trigrams.  Strings are ASCII
lower-cased, as is the index, so case-insensitive rules need no special treatment.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

MOST_STRINGS = 64
ALL: frozenset[frozenset[str]] = frozenset([frozenset()])  # one branch without a mandatory trigram


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simplify(query: frozenset[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Drop branches that a weaker branch implies."""
    return frozenset(b for b in query if not any(o < b for o in query))


def _of_strings(strings: set[str]) -> frozenset[frozenset[str]]:
    return _simplify(frozenset(trigrams(s) for s in strings))


def _both(a, b):
    return _simplify(frozenset(x | y for x in a for y in b))


def _class_strings(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 8:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _sequence(nodes) -> tuple[set[str] | None, frozenset]:
    exact: set[str] | None = {""}
    run: set[str] = {""}  # what the exact nodes since the last inexact one can spell
    query = ALL
    for node in nodes:
        strings, sub = _node(node)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query = _both(query, _of_strings(run))
        exact, run = None, {""}
        query = _both(query, sub if strings is None else _of_strings(strings))
    if exact is not None:
        return run, _of_strings(run)
    return None, _both(query, _of_strings(run))


def _node(node) -> tuple[set[str] | None, frozenset]:
    op, value = node
    if op is C.LITERAL:
        low = chr(value).lower()
        return ({low}, ALL) if len(low) == 1 else (None, ALL)
    if op is C.IN:
        strings = _class_strings(value)
        return (strings, ALL) if strings else (None, ALL)
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            strings = set().union(*(s for s, _ in parts))
            return strings, _of_strings(strings)
        return None, _simplify(frozenset().union(*((q if s is None else _of_strings(s)) for s, q in parts)))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = value
        strings, sub = _sequence(body)
        if least == 0:
            return (strings | {""}, ALL) if most == 1 and strings is not None else (None, ALL)
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, _of_strings(out)
        return None, sub if strings is None else _of_strings(strings)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, ALL
    return None, ALL


def mandatory(pattern: str) -> list[list[str]]:
    """Branches of trigrams: a match needs all trigrams of some branch.  An empty list: the rule scans every text."""
    _, query = _sequence(_parser.parse(pattern, re.NOFLAG))
    branches = sorted(sorted(b) for b in query)
    return [] if any(not b for b in branches) else branches
