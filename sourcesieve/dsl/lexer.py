"""Lexemes of a rule document. Offsets count bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

Span = tuple[int, int]

#: The reserved words.
KEYWORDS = frozenset(
    "scope include exclude definitions tokens skip fallback rules syntax node oneOf any not startsWith rule match where inside outside report info warn err at".split()
)
#: What ends a lexeme badly is part of the invalid lexeme up to and with the offending backslash, but without a line end.
LEXEME = re.compile(
    rb"""
    (?P<trivia>[ \t\r\n]+|//[^\n]*)
    |(?P<string>"(?:[^"\\\r\n]|\\[\\"nrt])*")
    |(?P<character>'(?:[^\\\r\n]|\\[\\'nrt])')
    |(?P<identifier>[A-Za-z][A-Za-z0-9_]*)
    |(?P<integer>[0-9]+)
    |(?P<mark>\.\.|==|!=|<=|>=|[(){}:|?*+.=<>])
    |(?P<invalid>"(?:[^"\\\r\n]|\\[\\"nrt])*\\?|'(?:\\[\\'nrt]|[^\\\r\n]|\\)?|[\s\S])
    """,
    re.VERBOSE,
)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


@dataclass(frozen=True)
class Lexeme:
    kind: str
    text: str
    span: Span

    def __bool__(self) -> bool:
        return bool(self.kind)

    @property
    def value(self) -> str:
        """What a string or character literal stands for."""
        return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), self.text[1:-1])


NOTHING = Lexeme("", "", (0, 0))


def lexemes(source: bytes) -> Iterator[Lexeme]:
    """Every lexeme and then EOF. Text is decoded byte by byte (Latin-1), so a character is one byte."""
    for m in LEXEME.finditer(source):
        kind, text = m.lastgroup or "", m[0].decode("latin-1")
        if kind == "trivia":
            continue
        if kind == "mark" or (kind == "identifier" and text in KEYWORDS):
            kind = text
        yield Lexeme(kind, text, m.span())
    yield Lexeme("EOF", "", (len(source), len(source)))
