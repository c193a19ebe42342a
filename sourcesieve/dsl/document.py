"""A parsed rule document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from sourcesieve.dsl.lexer import NOTHING, Lexeme, Span


@dataclass(frozen=True)
class Expr:
    """An expression over bytes or over tokens and nodes.

    kind: character, string, range, ref, any, seq, alt, group, repeat or capture. head: the literal, name, operator or field;
    to: the end of a range.
    """

    kind: str
    span: Span
    items: tuple[Expr, ...] = ()
    head: Lexeme = NOTHING
    to: Lexeme = NOTHING

    def walk(self) -> Iterator[Expr]:
        """The expression and all below, in order of the text."""
        yield self
        for item in self.items:
            yield from item.walk()


@dataclass(frozen=True)
class ScopeEntry:
    include: bool
    pattern: Lexeme


@dataclass(frozen=True)
class Definition:
    name: Lexeme
    expr: Expr


@dataclass(frozen=True)
class TokenDecl:
    name: Lexeme
    expr: Expr | None  # None: the fallback token
    fallback: Lexeme = NOTHING
    skip: bool = False


@dataclass(frozen=True)
class NodeDecl:
    name: Lexeme
    expr: Expr


@dataclass(frozen=True)
class Access:
    """subject.path.property"""

    subject: Lexeme
    path: tuple[Lexeme, ...]
    prop: Lexeme


@dataclass(frozen=True)
class Condition:
    left: Access
    operator: Lexeme
    right: Access | Lexeme
    span: Span


@dataclass(frozen=True)
class Match:
    """scope: inside, outside, parent or notparent, with scope_name; left: the left one of adjacent siblings."""

    node: bool
    target: Lexeme
    span: Span
    scope: str = ""
    scope_name: Lexeme = NOTHING
    left: Lexeme = NOTHING


@dataclass(frozen=True)
class Rule:
    name: Lexeme
    match: Match
    where: Condition | None
    severity: Lexeme
    target: Lexeme
    message: Lexeme


@dataclass
class Document:
    scope_span: Span = (0, 0)
    tokens_span: Span = (0, 0)
    rules_span: Span = (0, 0)
    scope: list[ScopeEntry] = field(default_factory=list)
    definitions: list[Definition] = field(default_factory=list)
    tokens: list[TokenDecl] = field(default_factory=list)
    nodes: list[NodeDecl] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)

    def names(self, of: str) -> dict[str, int]:
        """The first index of each name among definitions, tokens, nodes or rules."""
        found: dict[str, int] = {}
        for i, x in enumerate(getattr(self, of)):
            found.setdefault(x.name.text, i)
        return found
