"""Compiled documents: what the executors need, and what rules ask for. Small, and sent to tasks with the plan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from sourcesieve.dsl.checks import problems, roots
from sourcesieve.dsl.document import Access, Document, Expr
from sourcesieve.dsl.parser import DocumentError, parse
from sourcesieve.operators.automaton import Scanner, Token
from sourcesieve.operators.scope import Scope
from sourcesieve.operators.trees import Irregular, PatternParser, Step, TreeParser

SEVERITIES = ("info", "warn", "err")


@dataclass(frozen=True)
class Value:
    """subject: match, left or gap; path: fields from there; prop: text, length or blankLines."""

    subject: str
    path: tuple[str, ...]
    prop: str


@dataclass(frozen=True)
class Check:
    left: Value
    operator: str
    right: Value | bytes | int


@dataclass(frozen=True)
class RulePlan:
    index: int
    name: str
    node: bool
    target: int
    scope: str
    scope_kind: int
    left: int
    check: Check | None
    severity: str
    message: str

    def values(self) -> list[Value]:
        return [v for v in (self.check.left, self.check.right) if isinstance(v, Value)] if self.check else []


@dataclass(frozen=True)
class Program:
    scope: Scope
    tokens: tuple[Token, ...]
    definitions: tuple[tuple[str, Expr], ...]
    node_names: tuple[str, ...]
    nodes: tuple[Step, ...]
    root: int  # -1: none, or several
    rules: tuple[RulePlan, ...]
    backtrack_captures: bool = False

    @cached_property
    def scanner(self) -> Scanner:
        return Scanner(list(self.tokens), dict(self.definitions))

    def tree_parser(self) -> PatternParser | TreeParser:
        """Both give the same trees of token numbers (bytes, for PatternParser) from the root on."""
        try:
            return PatternParser(list(self.nodes), self.backtrack_captures, self.root, len(self.tokens))
        except (Irregular, RecursionError):
            return TreeParser(list(self.nodes), self.backtrack_captures)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "scanner"}  # tasks build their own

    @property
    def warnings(self) -> tuple[str, ...]:
        """What is allowed but can't be meant: rules for tokens that are never emitted."""
        return tuple(f'Token "{self.tokens[r.target].name}" is skipped, so a rule that matches it never reports.' for r in self.rules if not r.node and self.tokens[r.target].skip)

    @property
    def paths(self) -> tuple[tuple[str, ...], ...]:
        """The field paths that rules follow, each once."""
        return tuple(dict.fromkeys(v.path for r in self.rules for v in r.values() if v.path))


def compile_document(source: str | bytes, backtrack_captures: bool = False) -> Program:
    """Parses, checks and compiles; DocumentError says all that is wrong."""
    doc = parse(source)
    if found := problems(doc):
        raise DocumentError(found)
    tokens, nodes, definitions = doc.names("tokens"), doc.names("nodes"), doc.names("definitions")

    def step(e: Expr) -> Step:
        items = tuple(map(step, e.items))
        name = e.head.text
        match e.kind:
            case "ref":
                return Step("token", index=tokens[name]) if name in tokens else Step("node", index=nodes[name])
            case "capture":
                return Step("capture", items, field=name)
            case "repeat":
                return Step("repeat", items, least=int(name == "+"), most=1 if name == "?" else None)
        return Step(e.kind, items)

    patterns = lambda include: tuple(s.pattern.value for s in doc.scope if s.include == include)
    root = roots(doc)
    return Program(
        scope=Scope(patterns(True), patterns(False)),
        tokens=tuple(Token(t.name.text, t.expr, t.skip) for t in doc.tokens),
        definitions=tuple((d, doc.definitions[i].expr) for d, i in definitions.items()),
        node_names=tuple(n.name.text for n in doc.nodes),
        nodes=tuple(step(n.expr) for n in doc.nodes),
        root=root[0] if len(root) == 1 else -1,
        rules=_rules(doc),
        backtrack_captures=backtrack_captures,
    )


def _rules(doc: Document) -> tuple[RulePlan, ...]:
    tokens, nodes = doc.names("tokens"), doc.names("nodes")

    def value(a: Access) -> Value:
        subject = a.subject.text if a.subject.text in ("left", "gap") else "match"
        return Value(subject, tuple(p.text for p in a.path), a.prop.text)

    out = []
    for i, r in enumerate(doc.rules):
        check = None
        if r.where:
            right = r.where.right
            literal = value(right) if isinstance(right, Access) else right.value.encode("latin-1") if right.kind == "string" else int(right.text)
            check = Check(value(r.where.left), r.where.operator.kind, literal)
        m = r.match
        out.append(
            RulePlan(i, r.name.text, m.node, (nodes if m.node else tokens)[m.target.text], m.scope, nodes[m.scope_name.text] if m.scope else -1, nodes[m.left.text] if m.left else -1, check, r.severity.kind, r.message.value.encode("latin-1").decode("utf-8", "replace"))
        )
    return tuple(out)


def document_text(body: str) -> str:
    """A document without the indentation of the Python text that holds it."""
    return re.sub(r"(?m)^\s+", "", body).strip() + "\n"
