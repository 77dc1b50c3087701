"""Search queries as trees: built from plain arguments, or parsed from the raw query language.

Raw language: terms, "quoted phrases" (two quotes inside stand for one), AND, OR, NOT (upper case; implicit AND binds
tightest, then NOT, AND, OR), parentheses, prefix `x*`, phrase concatenation `p + q`, first token `^x`, `NEAR(p q, n)`
(n is 10 by default) and the column filter `search_text:`, `{search_text}:` or `-search_text:`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

COLUMN = "search_text"


@dataclass(frozen=True)
class Phrase:
    """Text as typed, in parts joined by `+`; prefix: the last token may go on; first: at the start of the text."""

    parts: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    keep: object
    drop: object


@dataclass(frozen=True)
class Nothing:
    """Matches no row (a filter on every column but the one there is)."""

    item: object = field(default=None)


def phrases(node) -> list[Phrase]:
    """All phrases, in order; one that is written twice counts twice."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    if isinstance(node, (And, Or)):
        return [p for x in node.items for p in phrases(x)]
    if isinstance(node, Not):
        return phrases(node.keep) + phrases(node.drop)
    return []


def from_arguments(text: str, mode: str):
    """A quoted phrase for each word of the text, all or any of them; None for blank text."""
    items = tuple(Phrase((t,)) for t in text.split())
    if not items:
        return None
    return items[0] if len(items) == 1 else (And(items) if mode == "and" else Or(items))


def match_expression(tokens: list[str], mode: str) -> str:
    """The query that from_arguments stands for, in the raw language: a quote in a token is written twice; without tokens,
    the empty phrase."""
    return (" OR " if mode == "or" else " AND ").join('"' + t.replace('"', '""') + '"' for t in tokens) or '""'


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w\x80-\U0010ffff\x1a]+)|([(){}+*^:,-])|(\S))', re.S)


class Parser:
    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        pos = 0
        while text[pos:].strip():
            m = _TOKEN.match(text, pos)
            pos = m.end()
            if m[1]:
                self.toks.append(("string", m[1][1:-1].replace('""', '"')))
            elif m[2]:
                self.toks.append(("word", m[2]))
            elif m[3]:
                self.toks.append((m[3], m[3]))
            else:
                raise ValueError(f'search: syntax error near "{m[4]}"')
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def take(self, kind: str | None = None) -> str:
        t = self.peek()
        if kind and t[0] != kind:
            raise ValueError(f'search: syntax error near "{t[1]}"')
        self.i += 1
        return t[1]

    def keyword(self, name: str) -> bool:
        return self.peek() == ("word", name)

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise ValueError(f'search: syntax error near "{self.peek()[1]}"')
        return out

    def _chain(self, name: str, below, make):
        items = [below()]
        while self.keyword(name):
            self.take()
            items.append(below())
        return items[0] if len(items) == 1 else make(tuple(items))

    def either(self):
        return self._chain("OR", self.both, Or)

    def both(self):
        return self._chain("AND", self.without, And)

    def without(self):
        out = self.implicit()
        while self.keyword("NOT"):
            self.take()
            out = Not(out, self.implicit())
        return out

    def implicit(self):
        items = [self.item()]
        while self.peek()[0] in ("string", "word", "(", "^", "{", "-") and self.peek()[1] not in ("AND", "OR", "NOT"):
            items.append(self.item())
        return items[0] if len(items) == 1 else And(tuple(items))

    def item(self):
        kind, text = self.peek()
        if kind == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        if kind in ("-", "{") or (kind == "word" and self.peek(1)[0] == ":"):
            return self.column()
        if kind == "word" and text == "NEAR" and self.peek(1)[0] == "(":
            self.take()
            self.take()
            group = [self.phrase()]
            while self.peek()[0] in ("string", "word", "^"):
                group.append(self.phrase())
            distance = 10
            if self.peek()[0] == ",":
                self.take()
                distance = int(self.take("word"))
            self.take(")")
            return Near(tuple(group), distance)
        return self.phrase()

    def column(self):
        negated = self.peek()[0] == "-"
        if negated:
            self.take()
        names = []
        if self.peek()[0] == "{":
            self.take()
            while self.peek()[0] == "word":
                names.append(self.take())
            self.take("}")
        else:
            names.append(self.take("word"))
        self.take(":")
        for n in names:
            if n.lower() != COLUMN:
                raise ValueError(f"search: no such column: {n}")
        item = self.item()
        return Nothing(item) if negated == (COLUMN in [n.lower() for n in names]) else item

    def phrase(self) -> Phrase:
        first = self.peek()[0] == "^"
        if first:
            self.take()
        parts = [self.text()]
        while self.peek()[0] == "+":
            self.take()
            parts.append(self.text())
        prefix = self.peek()[0] == "*"
        if prefix:
            self.take()
        return Phrase(tuple(parts), prefix, first)

    def text(self) -> str:
        kind, text = self.peek()
        if kind not in ("string", "word") or (kind == "word" and text in ("AND", "OR", "NOT")):
            raise ValueError(f'search: syntax error near "{text}"')
        return self.take()


def parse(text: str):
    """The tree of a raw query; ValueError where it is not one."""
    return Parser(text).parse()
