"""Texts that every match of a pattern contains, read off the parsed pattern: a cheap test before a search.

Letter case is left out on both sides: a folded text contains one of a rule's literals wherever the
rule matches with case ignored, so the test never hides a match.
"""

from __future__ import annotations

import re

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_constants as _c
    import sre_parse as _parser

MOST = 400
#: Letters that match i and s with case ignored, though they are not so in lower case.
ODD_LETTERS, PLAIN_LETTERS = "İıſ", "iis"


def folded(text: str) -> str:
    for odd, letter in zip(ODD_LETTERS, PLAIN_LETTERS, strict=True):
        text = text.replace(odd, letter)
    return text.lower()


def literals(pattern: str) -> tuple[str, ...] | None:
    """Folded strings of which every match has one; nothing where the pattern tells none."""
    found = _sequence(_parser.parse(pattern))[1]
    return tuple(sorted(found)) if found else None


def _sequence(items) -> tuple[set[str] | None, set[str] | None]:  # noqa: ANN001
    """All strings that a sequence can be, if they are few, and strings of which one is in each match."""
    run: set[str] = {""}
    needs: list[set[str]] = []
    whole = True
    for op, arg in items:
        exact, need = _item(op, arg)
        if need:
            needs.append(need)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        needs.append(run)
        run, whole = exact if exact is not None else {""}, False
    needs.append(run)
    told = [n for n in needs if "" not in n]
    return run if whole else None, max(told, key=lambda n: (min(map(len, n)), -len(n))) if told else None


def _item(op, arg) -> tuple[set[str] | None, set[str] | None]:  # noqa: ANN001
    if op is _c.LITERAL:
        return {folded(chr(arg))}, None
    if op is _c.IN:
        plain = all(o is _c.LITERAL for o, _ in arg) and len(arg) <= 8
        return ({folded(chr(a)) for _, a in arg} if plain else None), None
    if op is _c.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _c.BRANCH:
        ways = [_sequence(way) for way in arg[1]]
        exact = set().union(*(e for e, _ in ways)) if all(e is not None for e, _ in ways) else None
        each = [n or (e if e and "" not in e else None) for e, n in ways]
        return exact if exact and len(exact) <= MOST else None, set().union(*each) if all(each) else None
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, inner = arg
        exact, need = _sequence(inner)
        if low == high == 1:
            return exact, need
        if low == 0 and high == 1 and exact is not None:
            return exact | {""}, None
        return None, (need or (exact if exact and "" not in exact else None)) if low else None
    if op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
        return {""}, None
    return None, None


def ways(pattern: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    found, depth, at, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            found.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*found, pattern[at:]]


def plan(pattern: str) -> tuple[tuple[str, ...], list[str]]:
    """Literals of the alternatives that have some, and the alternatives that have none."""
    told: set[str] = set()
    rest: list[str] = []
    for way in ways(pattern):
        some = literals(way)
        if some and min(map(len, some)) > 1:
            told.update(some)
        else:
            rest.append(way)
    # a literal within a longer one makes the longer one superfluous
    return tuple(sorted(x for x in told if not any(y != x and y in x for y in told))), rest


class Prefilter:
    """Which rules a text may match: by literals, all looked up in one pass, or by alternatives that have none."""

    def __init__(self, rules: dict[str, str]):
        plans = {name: plan(pattern) for name, pattern in rules.items()}
        self.rest = [(name, re.compile(way, re.I)) for name, (_, rest) in plans.items() for way in rest]
        self.names: dict[str, set[str]] = {}
        for name, (told, _) in plans.items():
            for x in told:
                self.names.setdefault(x, set()).add(name)
        try:
            import ahocorasick
        except ImportError:
            self.automaton = None
        else:
            self.automaton = ahocorasick.Automaton()
            for x, names in self.names.items():
                self.automaton.add_word(x, names)
            self.automaton.make_automaton()

    def __call__(self, plain: str) -> set[str]:
        low = folded(plain)
        if self.automaton is None:
            hits = (names for x, names in self.names.items() if x in low)
        else:
            hits = (names for _, names in self.automaton.iter(low))
        found = set().union(*hits)
        found.update(name for name, way in self.rest if name not in found and way.search(plain))
        return found
