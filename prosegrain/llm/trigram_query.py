"""Boolean trigram queries that every match of a regular expression satisfies.

A query is a list of clauses; a text can match only if, for each clause, it
holds at least one of the clause's trigrams (lower case). An empty list says
nothing, so the rule scans every text.

The reader below knows the syntax that Java and Python share: literals and
escapes, classes, groups with or without flags, alternatives and repeats. What
it does not know (``\\Q``, classes within classes, the flag x) gives an empty query.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

MOST = 64  # strings kept in an exact set before it turns into clauses
MOST_LISTED = 8  # largest class of characters whose members are kept
#: Escapes that stand for one character, and those that match between characters.
SINGLE = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "a": "\a", "e": "\x1b"}
BETWEEN = set("bBAzZG")
#: Escapes for a class of characters or for several; their strings are not listed.
MANY = set("dDwWsShHvVRX")


class Unknown(ValueError):
    """The expression uses syntax that the reader does not know."""


class Part(NamedTuple):
    """What a stretch of the expression matches: its strings, lower case, or None for too many, and clauses that hold."""

    exact: set[str] | None
    known: list[frozenset[str]] = []


def _clauses(exact: set[str]) -> list[frozenset[str]]:
    """What a text that holds one of ``exact`` must hold: trigrams of the strings, place by place from the left."""
    if not exact or min(map(len, exact)) < 3:
        return []
    out = [frozenset(s[i : i + 3] for s in exact) for i in range(min(map(len, exact)) - 2)]
    return out + [frozenset(s[-3:] for s in exact)]


def _in_turn(parts: Iterable[Part]) -> Part:
    whole = True
    known: list[frozenset[str]] = []
    run: set[str] = {""}  # strings of the stretch that ends here
    for exact, clauses in parts:
        known += clauses
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        known += _clauses(run)
        run, whole = exact or {""}, False
    return Part(run if whole else None, known + _clauses(run))


def _either(parts: list[Part]) -> Part:
    if len(parts) == 1:
        return parts[0]
    if all(p.exact is not None for p in parts):
        return Part(set().union(*[p.exact for p in parts]))
    # One clause: the union of each alternative's first.
    return Part(None, [frozenset().union(*[p.known[0] for p in parts])] if all(p.known for p in parts) else [])


def _repeated(part: Part, least: int, most: int | None) -> Part:
    if least == 0:
        return Part({""} | part.exact) if most == 1 and part.exact is not None else Part(None)
    if part.exact is not None and least == most and len(part.exact) ** least <= MOST:
        return _in_turn([Part(part.exact)] * least)._replace(known=[])
    return Part(None, part.known)


class _Reader:
    def __init__(self, regex: str):
        self.regex, self.at = regex, 0

    def ahead(self, s: str) -> bool:
        return self.regex.startswith(s, self.at)

    def take(self, s: str = "") -> str:
        """The next character, or ``s``, which must come next."""
        if not (self.ahead(s) if s else self.at < len(self.regex)):
            raise Unknown(self.regex)
        self.at += len(s) or 1
        return self.regex[self.at - (len(s) or 1) : self.at]

    def until(self, end: str) -> str:
        found = self.regex.find(end, self.at)
        if found < 0:
            raise Unknown(self.regex)
        out, self.at = self.regex[self.at : found], found + len(end)
        return out

    def alternatives(self) -> Part:
        branches = [self.sequence()]
        while self.ahead("|"):
            self.take()
            branches.append(self.sequence())
        return _either(branches)

    def sequence(self) -> Part:
        parts = []
        while self.at < len(self.regex) and not self.ahead("|") and not self.ahead(")"):
            parts.append(self.repeats(self.atom()))
        return _in_turn(parts)

    def repeats(self, part: Part) -> Part:
        if self.ahead("{"):
            self.take()
            least, comma, most = self.until("}").partition(",")
            if not least.isdecimal() or most and not most.isdecimal():
                raise Unknown(self.regex)
            bounds = int(least), (int(most) if most else None) if comma else int(least)
        elif self.at < len(self.regex) and self.regex[self.at] in "*+?":
            bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.take()]
        else:
            return part
        if self.ahead("?") or self.ahead("+"):  # lazy or possessive
            self.take()
        return self.repeats(_repeated(part, *bounds))

    def atom(self) -> Part:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.one_of()
        if c == "\\":
            return self.escape()
        if c in "^$":
            return Part({""})
        if c == ".":
            return Part(None)
        if c in "*+?{":
            raise Unknown(self.regex)
        return Part({c.lower()})

    def group(self) -> Part:
        around = False
        if self.ahead("?"):
            self.take()
            if self.ahead("P<") or self.ahead("<") and not self.ahead("<=") and not self.ahead("<!"):
                self.until(">")
            elif around := next((s for s in ("<=", "<!", "=", "!") if self.ahead(s)), False):
                self.take(around)
            elif self.ahead(">"):
                self.take()
            else:  # flags, for the group or for the rest
                flags = ""
                while not self.ahead(":") and not self.ahead(")"):
                    flags += self.take()
                if set(flags) - set("imsuUda-"):
                    raise Unknown(self.regex)
                if self.take() == ")":
                    return Part({""})
        inner = self.alternatives()
        self.take(")")
        return Part({""}) if around else inner

    def code(self, c: str) -> str | None:
        """The character that an escape by ``c`` stands for."""
        if c in "xu":
            digits = self.regex[self.at : self.at + (2 if c == "x" else 4)]
            try:
                out = chr(int(digits, 16))
            except ValueError:
                raise Unknown(self.regex) from None
            self.at += len(digits)
            return out
        return SINGLE.get(c) or (None if c.isalnum() else c)

    def escape(self) -> Part:
        c = self.take()
        if c in BETWEEN:
            return Part({""})
        if c in MANY or c in "123456789":  # a class, or what a group matched
            return Part(None)
        one = self.code(c)
        if one is None:
            raise Unknown(self.regex)
        return Part({one.lower()})

    def one_of(self) -> Part:
        listed, members = not self.ahead("^"), []
        if not listed:
            self.take()
        while not self.ahead("]") or not members:
            c = self.take()
            if c == "[" or c == "&" and self.ahead("&"):
                raise Unknown(self.regex)
            if c == "\\":
                c = self.take()
                one = None if c in MANY else self.code(c)
                if one is None and c not in MANY:
                    raise Unknown(self.regex)
                listed = listed and one is not None
                c = one or c
            elif c == "-" and members and not self.ahead("]"):
                listed = False  # a range
            members.append(c)
        self.take("]")
        return Part({m.lower() for m in members}) if listed and len(members) <= MOST_LISTED else Part(None)


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of ``regex``, without repeats and without clauses a smaller one implies; none for syntax not known."""
    reader = _Reader(regex)
    try:
        whole = reader.alternatives()
    except Unknown:
        return []
    if reader.at < len(regex):
        return []
    # Alternatives that are all strings have no clause yet.
    found = list(dict.fromkeys([*whole.known, *_clauses(whole.exact or set())]))
    return [c for c in found if not any(d < c for d in found)]
