"""Rule documents from text; the first error ends the parse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from sourcesieve.dsl.document import Access, Condition, Definition, Document, Expr, Match, NodeDecl, Rule, ScopeEntry, TokenDecl
from sourcesieve.dsl.lexer import NOTHING, Lexeme, Span, lexemes

REPEATS = ("?", "*", "+")
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=", "startsWith")
SEVERITIES = ("info", "warn", "err")


@dataclass(frozen=True)
class Problem:
    """A message about a stretch of the document."""

    message: str
    span: Span


class DocumentError(ValueError):
    """What is wrong with a document."""

    def __init__(self, problems: list[Problem]):
        super().__init__("; ".join(p.message for p in problems))
        self.problems = problems


def parse(source: str | bytes) -> Document:
    return _Parser(source.encode() if isinstance(source, str) else source).document()


class _Parser:
    def __init__(self, source: bytes):
        self.all, self.at = list(lexemes(source)), 0

    # lexemes

    @property
    def here(self) -> Lexeme:
        return self.all[self.at]

    def after(self) -> str:
        return self.all[min(self.at + 1, len(self.all) - 1)].kind

    def sees(self, *kinds: str) -> bool:
        return self.here.kind in kinds

    def take(self) -> Lexeme:
        found = self.here
        self.at = min(self.at + 1, len(self.all) - 1)
        return found

    def need(self, *kinds: str) -> Lexeme:
        """A lexeme of one of the kinds; the first is the one to report."""
        if not self.sees(*kinds):
            self.fail(kinds[0])
        return self.take()

    def maybe(self, *kinds: str) -> Lexeme:
        return self.take() if self.sees(*kinds) else NOTHING

    def fail(self, wanted: str) -> None:
        raise DocumentError([Problem(f"Expected '{wanted}', found '{self.here.kind}'.", self.here.span)])

    # sections

    def document(self) -> Document:
        doc = Document()
        doc.scope_span = self.section("scope", ("include", "exclude"), lambda: doc.scope.append(self.scope_entry()))
        if self.sees("definitions"):
            self.section("definitions", ("identifier",), lambda: doc.definitions.append(self.definition()))
        if self.sees("tokens"):
            doc.tokens_span = self.section("tokens", ("identifier",), lambda: doc.tokens.append(self.token()))
        if self.sees("syntax"):
            self.section("syntax", ("node",), lambda: doc.nodes.append(self.node()))
        if self.sees("rules"):
            doc.rules_span = self.section("rules", ("rule", *SEVERITIES), lambda: doc.rules.append(self.rule()))
        self.need("EOF")
        return doc

    def section(self, name: str, starts: tuple[str, ...], entry: Callable[[], None]) -> Span:
        start = self.need(name)
        self.need("{")
        while self.sees(*starts):
            entry()
        end = self.need(*(("}",) if self.sees("}", "EOF") else (starts[0],)))
        return start.span[0], end.span[1]

    def scope_entry(self) -> ScopeEntry:
        return ScopeEntry(self.take().kind == "include", self.need("string"))

    def definition(self) -> Definition:
        name = self.take()
        self.need("=")
        return Definition(name, self.choice(self.byte_primary, ("(", "identifier", "character")))

    def token(self) -> TokenDecl:
        name = self.take()
        self.need("=")
        fallback = self.maybe("fallback")
        expr = None if fallback else self.choice(self.token_primary, ("(", "identifier", "character", "string"))
        return TokenDecl(name, expr, fallback, bool(self.maybe("skip")))

    # expressions, over bytes or over tokens and nodes

    def choice(self, primary: Callable[[], Expr], starts: tuple[str, ...]) -> Expr:
        terms = [self.sequence(primary, starts)]
        while self.maybe("|"):
            terms.append(self.sequence(primary, starts))
        return self.joined("alt", terms)

    def sequence(self, primary: Callable[[], Expr], starts: tuple[str, ...]) -> Expr:
        terms = [self.repeated(primary())]
        while self.sees(*starts) and not (self.sees("identifier") and self.after() == "="):
            terms.append(self.repeated(primary()))
        return self.joined("seq", terms)

    @staticmethod
    def joined(kind: str, terms: list[Expr]) -> Expr:
        return terms[0] if len(terms) == 1 else Expr(kind, (terms[0].span[0], terms[-1].span[1]), tuple(terms))

    def repeated(self, inner: Expr) -> Expr:
        operator = self.maybe(*REPEATS)
        return Expr("repeat", (inner.span[0], operator.span[1]), (inner,), operator) if operator else inner

    def grouped(self, primary: Callable[[], Expr], starts: tuple[str, ...]) -> Expr:
        start = self.take()
        inner = self.choice(primary, starts)
        return Expr("group", (start.span[0], self.need(")").span[1]), (inner,))

    def byte_primary(self, strings: bool = False) -> Expr:
        if self.sees("("):
            return self.grouped(self.token_primary, ("(", "identifier", "character", "string")) if strings else self.grouped(self.byte_primary, ("(", "identifier", "character"))
        if strings and self.sees("string"):
            return Expr("string", self.here.span, head=self.take())
        if self.sees("identifier"):
            return Expr("ref", self.here.span, head=self.take())
        start = self.need("character")
        if not self.maybe(".."):
            return Expr("character", start.span, head=start)
        end = self.need("character")
        return Expr("range", (start.span[0], end.span[1]), head=start, to=end)

    def token_primary(self) -> Expr:
        return self.byte_primary(strings=True)

    def node_primary(self) -> Expr:
        if self.sees("identifier") and self.after() == ":":
            name = self.take()
            self.take()
            inner = self.node_primary()
            return Expr("capture", (name.span[0], inner.span[1]), (inner,), name)
        if self.sees("("):
            return self.grouped(self.node_primary, ("(", "identifier", "any"))
        if self.sees("any"):
            return Expr("any", self.here.span, head=self.take())
        return Expr("ref", self.here.span, head=self.need("identifier"))

    # nodes

    def node(self) -> NodeDecl:
        self.take()
        name = self.need("identifier")
        self.need("{")
        entries = [self.entry()]
        while not self.sees("}"):
            entries.append(self.entry())
        end = self.take()
        return NodeDecl(name, entries[0] if len(entries) == 1 else Expr("seq", (entries[0].span[0], end.span[1]), tuple(entries)))

    def entry(self) -> Expr:
        if not self.sees("identifier"):
            return self.item()
        name = self.take()
        operator = self.maybe(*REPEATS)
        if self.maybe(":"):
            inner = self.item()
            if operator:
                inner = Expr("repeat", (operator.span[0], inner.span[1]), (inner,), operator)
            return Expr("capture", (name.span[0], inner.span[1]), (inner,), name)
        plain = Expr("ref", name.span, head=name)
        return Expr("repeat", (name.span[0], operator.span[1]), (plain,), operator) if operator else plain

    def item(self) -> Expr:
        """What may stand without a name, and after one."""
        if self.sees("oneOf"):
            start = self.take()
            self.need("{")
            choices = [self.item()]
            while not self.sees("}"):
                choices.append(self.item())
            end = self.take()
            return choices[0] if len(choices) == 1 else Expr("alt", (start.span[0], end.span[1]), tuple(choices))
        if self.sees("any", "("):
            return self.repeated(self.node_primary())
        name = self.need("identifier")
        return self.repeated(Expr("ref", name.span, head=name))

    # rules

    def rule(self) -> Rule:
        if self.sees(*SEVERITIES):
            severity, message = self.take(), self.need("string")
            self.need(":")
            match = self.selector()
            return Rule(NOTHING, match, self.condition(), severity, match.target, message)
        self.take()
        name = self.need("identifier")
        self.need("{")
        match = self.block_match()
        where = self.condition()
        self.need("report")
        severity = self.need("warn", *SEVERITIES)
        self.need("at")
        target, message = self.need("identifier"), self.need("string")
        self.need("}")
        return Rule(name, match, where, severity, target, message)

    def block_match(self) -> Match:
        start = self.need("match")
        node = bool(self.maybe("node"))
        target = end = self.need("identifier")
        scope = self.maybe("inside", "outside")
        if scope:
            end = self.need("identifier")
        return Match(node, target, (start.span[0], end.span[1]), scope.kind, end if scope else NOTHING)

    def selector(self) -> Match:
        first = self.need("identifier")
        begin = first.span[0]
        if self.maybe(":"):
            self.need("not")
            self.need("(")
            outer = self.need("identifier")
            scope = "notparent" if self.maybe(">") else "outside"
            end = self.need("*")
            self.need(")")
            return Match(True, first, (begin, end.span[1]), scope, outer)
        if self.maybe("+"):
            target = self.need("identifier")
            return Match(True, target, (begin, target.span[1]), left=first)
        if self.sees(">", "identifier"):
            scope = "parent" if self.maybe(">") else "inside"
            target = self.need("identifier")
            return Match(True, target, (begin, target.span[1]), scope, first)
        return Match(True, first, first.span)

    def condition(self) -> Condition | None:
        if not self.sees("where"):
            return None
        start = self.take()
        left = self.access()
        operator = self.need("==", *COMPARISONS)
        right = self.access() if self.sees("identifier") else self.need("string", "integer")
        end = right.prop if isinstance(right, Access) else right
        return Condition(left, operator, right, (start.span[0], end.span[1]))

    def access(self) -> Access:
        subject = self.need("identifier")
        self.need(".")
        names = [self.need("identifier")]
        while self.maybe("."):
            names.append(self.need("identifier"))
        return Access(subject, tuple(names[:-1]), names[-1])
