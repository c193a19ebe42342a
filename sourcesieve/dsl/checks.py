"""What must hold of a parsed document beyond its grammar. Every problem is reported, section by section."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from sourcesieve.dsl.document import Access, Document, Expr, Rule
from sourcesieve.dsl.lexer import Lexeme
from sourcesieve.dsl.parser import Problem

PROPERTIES = {"text": "string", "length": "integer", "blankLines": "integer"}


def problems(doc: Document) -> list[Problem]:
    return [p for check in (_scope, _definitions, _tokens, _nodes, _rules) for p in check(doc)]


def _repeated_names(doc: Document, of: str, label: str) -> Iterator[Problem]:
    first = doc.names(of)
    for i, x in enumerate(getattr(doc, of)):
        if x.name and first[x.name.text] != i:
            yield Problem(f'{label} "{x.name.text}" is already declared.', x.name.span)


def _cycles(exprs: list[Expr], names: dict[str, int], label: str) -> Iterator[Problem]:
    """References back into what is being expanded."""
    done: set[int] = set()

    def visit(i: int, open_: frozenset[int]) -> Iterator[Problem]:
        if i in done:
            return
        for e in exprs[i].walk():
            if e.kind != "ref" or (to := names.get(e.head.text)) is None:
                continue
            if to in open_:
                yield Problem(f'{label} "{e.head.text}" is recursive.', e.head.span)
            else:
                yield from visit(to, open_ | {to})
        done.add(i)

    for i in range(len(exprs)):
        yield from visit(i, frozenset([i]))


def matches_empty(expr: Expr, of_ref: Callable[[str, int], bool], depth: int = 0) -> bool:
    """Whether an expression matches nothing at all; of_ref answers for references, given how deep they are nested."""
    below = (matches_empty(x, of_ref, depth) for x in expr.items)
    match expr.kind:
        case "string":
            return expr.head.text == '""'
        case "ref":
            return of_ref(expr.head.text, depth)
        case "seq":
            return all(below)
        case "alt" | "group" | "capture":
            return any(below)
        case "repeat":
            return expr.head.kind != "+" or any(below)
    return False


def _scope(doc: Document) -> Iterator[Problem]:
    for entry in doc.scope:
        if entry.pattern.text == '""':
            yield Problem("Scope pattern must not be empty.", entry.pattern.span)
    if not any(entry.include for entry in doc.scope):
        yield Problem("Scope must contain at least one include.", doc.scope_span)


def _bytes_expr(expr: Expr, names: dict[str, int]) -> Iterator[Problem]:
    for e in expr.walk():
        if e.kind == "range" and e.head.value > e.to.value:
            yield Problem("Character range start must be less than or equal to end.", e.span)
        if e.kind == "ref" and e.head.text not in names:
            yield Problem(f'Definition "{e.head.text}" is not declared.', e.head.span)


def _definitions(doc: Document) -> Iterator[Problem]:
    names = doc.names("definitions")
    yield from _repeated_names(doc, "definitions", "Definition")
    for d in doc.definitions:
        yield from _bytes_expr(d.expr, names)
    yield from _cycles([d.expr for d in doc.definitions], names, "Definition")


def _tokens(doc: Document) -> Iterator[Problem]:
    if not doc.tokens:
        yield Problem("Tokens must contain at least one token.", doc.tokens_span)
        return
    definitions = doc.names("definitions")
    first = doc.names("tokens")
    for i, t in enumerate(doc.tokens):
        if t.name.text in definitions:
            yield Problem(f'Token "{t.name.text}" conflicts with a definition of the same name.', t.name.span)
        if first[t.name.text] != i:
            yield Problem(f'Token "{t.name.text}" is already declared.', t.name.span)

    def of_ref(name: str, depth: int) -> bool:
        i = definitions.get(name)
        return i is not None and depth < len(doc.definitions) and matches_empty(doc.definitions[i].expr, of_ref, depth + 1)

    for t in doc.tokens:
        if t.expr:
            yield from _bytes_expr(t.expr, definitions)
            if matches_empty(t.expr, of_ref):
                yield Problem("Token expression must not match empty input.", t.expr.span)
    for t in [t for t in doc.tokens if t.fallback][1:]:
        yield Problem("Tokens may contain at most one fallback token.", t.fallback.span)


def _nodes(doc: Document) -> Iterator[Problem]:
    tokens, nodes = doc.names("tokens"), doc.names("nodes")
    for i, n in enumerate(doc.nodes):
        name = n.name.text
        if nodes[name] != i:
            yield Problem(f'Syntax node "{name}" is already declared.', n.name.span)
        elif name in tokens:
            yield Problem(f'Syntax node "{name}" conflicts with token "{name}".', n.name.span)

    def of_ref(name: str, depth: int) -> bool:
        i = nodes.get(name)
        return name not in tokens and i is not None and depth <= len(doc.nodes) and matches_empty(doc.nodes[i].expr, of_ref, depth + 1)

    def visit(e: Expr) -> Iterator[Problem]:
        if e.kind == "ref" and e.head.text not in tokens and e.head.text not in nodes:
            yield Problem(f'Syntax reference "{e.head.text}" is not declared as a token or syntax node.', e.head.span)
        for item in e.items:
            yield from visit(item)
        if e.kind == "repeat" and matches_empty(e.items[0], of_ref):
            yield Problem("Syntax repetition expression must not match empty input.", e.span)

    for n in doc.nodes:
        yield from visit(n.expr)
    yield from _cycles([n.expr for n in doc.nodes], nodes, "Syntax node")


def roots(doc: Document) -> list[int]:
    """Indexes of the nodes that none refers to."""
    names = doc.names("nodes")
    used = {names.get(e.head.text) for n in doc.nodes for e in n.expr.walk() if e.kind == "ref"}
    return [i for i in range(len(doc.nodes)) if i not in used]


def field_targets(doc: Document, nodes: set[str], field: str) -> set[str]:
    """The nodes that a field of any of these nodes can hold."""
    names = doc.names("nodes")

    def captures(e: Expr) -> Iterator[Expr]:
        if e.kind == "capture" and e.head.text == field:
            yield e
        else:
            for item in e.items:
                yield from captures(item)

    return {r.head.text for n in nodes if n in names for c in captures(doc.nodes[names[n]].expr) for r in c.walk() if r.kind == "ref" and r.head.text in names}


def _rules(doc: Document) -> Iterator[Problem]:
    yield from _repeated_names(doc, "rules", "Rule")
    for rule in doc.rules:
        yield from _node_rule(doc, rule) if rule.match.node else _token_rule(doc, rule)
    if any(r.match.node for r in doc.rules) and len(roots(doc)) != 1:
        yield Problem("Syntax rules require exactly one root syntax node.", doc.rules_span)


def _accesses(rule: Rule) -> list[Access]:
    return [x for x in (rule.where.left, rule.where.right) if isinstance(x, Access)] if rule.where else []


def _token_rule(doc: Document, rule: Rule) -> Iterator[Problem]:
    name = rule.match.target.text
    if name not in doc.names("tokens"):
        yield Problem(f'Token "{name}" is not declared.', rule.match.target.span)
    for access in _accesses(rule):  # the right side, too: the language's text asks for it
        if access.subject.text != name:
            yield Problem(f'Where clause must reference matched token "{name}".', access.subject.span)
    if rule.target.text != name:
        yield Problem(f'Report target must reference matched token "{name}".', rule.target.span)
    yield from _properties(rule, "Token")
    for access in _accesses(rule):
        if access.path:
            yield Problem("Token rules do not support named syntax-field paths.", access.path[0].span)
    if rule.match.scope:
        yield Problem("Only syntax-node rules may use inside/outside constraints.", rule.match.span)


def _node_rule(doc: Document, rule: Rule) -> Iterator[Problem]:
    match, nodes = rule.match, doc.names("nodes")

    def known(name: Lexeme) -> Iterator[Problem]:
        if name and name.text not in nodes:
            yield Problem(f'Syntax node "{name.text}" is not declared.', name.span)

    yield from known(match.target)
    yield from known(match.left)
    valid = {match.target.text, "right"} | ({"left", "gap"} if match.left else set())
    for access, what in zip(_accesses(rule), ("an invalid subject", "an invalid comparison subject"), strict=False):
        if access.subject.text not in valid:
            yield Problem(f'Where clause references {what} for syntax rule "{match.target.text}".', access.subject.span)
    if rule.target.text != match.target.text:
        yield Problem(f'Report target must reference matched syntax node "{match.target.text}".', rule.target.span)
    yield from known(match.scope_name)
    yield from _properties(rule, "Syntax node")
    for access in _accesses(rule):
        yield from _path(doc, rule, access)


def _path(doc: Document, rule: Rule, access: Access) -> Iterator[Problem]:
    if not access.path:
        return
    subject = access.subject.text
    start = rule.match.left if subject == "left" else rule.match.target
    if subject == "gap" or not start:
        yield Problem(f'Subject "{subject}" does not support named syntax-field paths.', access.path[0].span)
        return
    found = {start.text}
    for name in access.path:
        found = field_targets(doc, found, name.text)
        if not found:
            yield Problem(f'Named syntax field "{name.text}" is not declared on the selected syntax path.', name.span)
            return


def _properties(rule: Rule, label: str) -> Iterator[Problem]:
    where = rule.where
    if not where:
        return
    accesses = _accesses(rule)
    for a in accesses:
        if a.prop.text not in PROPERTIES:
            yield Problem(f'{label} property "{a.prop.text}" is not declared.', a.prop.span)
    for a in accesses:
        if a.prop.text == "blankLines" and a.subject.text != "gap":
            yield Problem('Property "blankLines" is only valid on subject "gap".', a.prop.span)
    prop, right = where.left.prop.text, where.right
    if isinstance(right, Lexeme) and prop in PROPERTIES and right.kind != PROPERTIES[prop]:
        article = "a string" if prop == "text" else "an integer"
        yield Problem(f'{label} property "{prop}" must be compared with {article} literal.', right.span)
    if where.operator.kind == "startsWith" and prop != "text":
        yield Problem(f'Property "{prop}" only supports numeric or equality operators.', where.operator.span)
    if isinstance(right, Access) and PROPERTIES.get(prop, "integer") != PROPERTIES.get(right.prop.text, "integer"):
        yield Problem("Compared properties must use compatible value types.", where.span)
    if not rule.match.left and {a.subject.text for a in accesses} & {"left", "gap"}:
        yield Problem("Single-match rules cannot reference left or gap subjects.", where.span)
