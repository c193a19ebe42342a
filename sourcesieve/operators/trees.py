"""Syntax trees of token sequences.

Expressions give one result at a place, and every choice is final: an alternative that matched isn't left again. Only a
repetition that stands directly in a sequence gives iterations back, the last first, until the rest of the sequence matches. A
captured repetition doesn't, unless backtrack_captures is set.

First ends are found, and kept by expression and place; a repetition shares what it finds at a place with all that pass there, so
work grows with the number of tokens. Then nodes are made, for what matched alone.

Grammars without recursion, where no attempt that may fail late is made again and again, are regular and match in linear time as
patterns over the bytes of token numbers; PatternParser does that, with the same trees.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Step:
    """A compiled expression. kind: token, node, any, seq, alt, group, repeat or capture; index: of the token or node."""

    kind: str
    items: tuple[Step, ...] = ()
    index: int = -1
    field: str = ""
    least: int = 0
    most: int | None = None


@dataclass(eq=False)
class Node:
    kind: int
    first: int
    count: int
    children: list[tuple[str | None, Node | Run]] = field(default_factory=list)


@dataclass(frozen=True)
class Run:
    """A number of nodes of one kind and width side by side, all without children."""

    kind: int
    first: int
    number: int
    width: int

    def __getitem__(self, i: int) -> Node:
        return Node(self.kind, self.first + i % self.number * self.width, self.width)


Edges = list[tuple[str | None, Node | Run]]


class TreeParser:
    def __init__(self, nodes: list[Step], backtrack_captures: bool = False):
        self.nodes, self.backtrack = nodes, backtrack_captures

    def parse(self, tokens: list[int], root: int) -> Node | None:
        """The root's tree over all tokens, or None. The root isn't asked for another match that ends later."""
        self.tokens, self.node_ends, self.loop_ends, self.rest_ends, self.made = tokens, {}, {}, {}, {}
        return self.node(root, 0) if self.node_end(root, 0) == len(tokens) else None

    # ends; -1: no match

    def end(self, e: Step, at: int) -> int:
        match e.kind:
            case "token":
                return at + 1 if at < len(self.tokens) and self.tokens[at] == e.index else -1
            case "any":
                return at + 1 if at < len(self.tokens) else -1
            case "node":
                return self.node_end(e.index, at)
            case "capture" | "group":
                return self.end(e.items[0], at)
            case "alt":
                return next((x for item in e.items if (x := self.end(item, at)) >= 0), -1)
            case "repeat":
                return self.loop_end(e, at)
        return self.rest_end(e, 0, at)

    def node_end(self, kind: int, at: int) -> int:
        key = (kind, at)
        if key not in self.node_ends:
            self.node_ends[key] = self.end(self.nodes[kind], at)
        return self.node_ends[key]

    def loop_end(self, e: Step, at: int) -> int:
        """As many iterations as match and move on."""
        if e.most == 1:
            return max(self.end(e.items[0], at), at)
        known = self.loop_ends.setdefault(id(e), {})
        passed, here = [], at
        while here not in known:
            after = self.end(e.items[0], here)
            if after <= here:
                known[here] = here
            else:
                passed.append(here)
                here = after
        for x in passed:
            known[x] = known[here]
        return known[at] if known[at] > at or not e.least else -1

    def loop_of(self, item: Step) -> Step | None:
        """The repetition that gives iterations back, if the element of a sequence is one."""
        if item.kind == "capture" and self.backtrack:
            item = item.items[0]
        return item if item.kind == "repeat" else None

    def rest_end(self, e: Step, k: int, at: int) -> int:
        """A sequence from its element k on."""
        if k == len(e.items):
            return at
        loop = self.loop_of(e.items[k])
        if loop is None:
            after = self.end(e.items[k], at)
            return self.rest_end(e, k + 1, after) if after >= 0 else -1
        if not loop.least:
            return self.more_end(e, k, loop, at)
        after = self.end(loop.items[0], at)
        return self.more_end(e, k, loop, after) if after > at else -1

    def more_end(self, e: Step, k: int, loop: Step, at: int) -> int:
        """The rest, after any number of iterations from here: with most of them that let it match."""
        if loop.most == 1:
            after = self.end(loop.items[0], at)
            found = self.rest_end(e, k + 1, after) if after > at else -1
            return found if found >= 0 else self.rest_end(e, k + 1, at)
        known = self.rest_ends.setdefault((id(e), k), {})
        passed, here = [], at
        while here not in known:
            after = self.end(loop.items[0], here)
            if after <= here:
                known[here] = self.rest_end(e, k + 1, here)
            else:
                passed.append(here)
                here = after
        for x in reversed(passed):
            known[x] = known[here] if known[here] >= 0 else self.rest_end(e, k + 1, x)
            here = x
        return known[at]

    # nodes, where ends are known to be there

    def node(self, kind: int, at: int) -> Node:
        key = (kind, at)
        if key not in self.made:
            self.made[key] = Node(kind, at, self.node_end(kind, at) - at, self.edges(self.nodes[kind], at))
        return self.made[key]

    def edges(self, e: Step, at: int) -> Edges:
        match e.kind:
            case "node":
                return [(None, self.node(e.index, at))]
            case "capture":
                return [(e.field, n) for _, n in self.edges(e.items[0], at)]
            case "group":
                return self.edges(e.items[0], at)
            case "alt":
                return self.edges(next(x for x in e.items if self.end(x, at) >= 0), at)
            case "repeat":
                return self.iterations(e, at, lambda _: True)[1]
            case "seq":
                return self.rest_edges(e, at)
        return []

    def iterations(self, e: Step, at: int, wanted: Callable[[int], bool]) -> tuple[int, Edges]:
        out: Edges = []
        n = 0
        while e.most is None or n < e.most:
            after = self.end(e.items[0], at)
            if after <= at or not (n < e.least or wanted(after)):
                break
            out += self.edges(e.items[0], at)
            at, n = after, n + 1
        return at, out

    def rest_edges(self, e: Step, at: int) -> Edges:
        out: Edges = []
        for k, item in enumerate(e.items):
            loop = self.loop_of(item)
            if loop is None:
                out += self.edges(item, at)
                at = self.end(item, at)
            else:
                reaches = (lambda x, k=k: self.rest_end(e, k + 1, x) >= 0) if loop.most == 1 else (lambda x, k=k, loop=loop: self.more_end(e, k, loop, x) >= 0)
                at, own = self.iterations(loop, at, reaches)
                out += [(item.field, n) for _, n in own] if item.kind == "capture" else own
        return out


class Irregular(Exception):
    """The grammar has no pattern that is known to match in linear time."""


class PatternParser:
    """The trees of TreeParser, for grammars that it doesn't refuse (Irregular). Nodes that are one or more tokens and nothing
    else come as runs."""

    MOST = 20_000  # bytes of a pattern: nodes are written out wherever they are named

    def __init__(self, nodes: list[Step], backtrack_captures: bool, root: int, n_tokens: int):
        if root < 0 or n_tokens > 256:
            raise Irregular
        self.nodes, self.backtrack = nodes, backtrack_captures
        self.patterns: dict[int, Callable[[bytes, int], re.Match[bytes] | None]] = {}
        self.root = Step("node", index=root)
        self.below(root, set(), set())
        self.compiled(self.root)
        self.check(self.root, False)
        self.widths = [self.width(e) for e in nodes]

    def below(self, kind: int, above: set[int], done: set[int]) -> None:
        """Refuses recursion."""
        todo = [self.nodes[kind]]
        while todo:
            e = todo.pop()
            todo += e.items
            if e.kind == "node" and e.index in above | {kind}:
                raise Irregular
            if e.kind == "node" and e.index not in done:
                self.below(e.index, above | {kind}, done)
        done.add(kind)

    # what is known of expressions

    def nullable(self, e: Step) -> bool:
        match e.kind:
            case "node":
                return self.nullable(self.nodes[e.index])
            case "capture" | "group":
                return self.nullable(e.items[0])
            case "alt":
                return any(map(self.nullable, e.items))
            case "repeat":
                return not e.least
            case "seq":
                return all(map(self.nullable, e.items))
        return False

    def bounded(self, e: Step) -> bool:
        """Whether it matches or fails after a fixed number of tokens at most."""
        if e.kind == "node":
            return self.bounded(self.nodes[e.index])
        return (e.kind != "repeat" or e.most == 1) and all(map(self.bounded, e.items))

    def check(self, e: Step, inside: bool) -> None:
        """Refuses repetitions of what may be empty, and attempts of any length that may fail and leave what comes next to read the
        same tokens again. Compiles what trees ask for."""
        if e.kind == "node":
            return self.check(self.nodes[e.index], inside)
        if e.kind == "repeat" and (self.nullable(e.items[0]) or inside and not self.bounded(e.items[0])):
            raise Irregular
        if e.kind == "alt" and (any(map(self.nullable, e.items)) or inside and not all(map(self.bounded, e.items[:-1]))):
            raise Irregular
        if e.kind == "seq" and any((loop := self.loop_of(x)) and loop.most != 1 for x in e.items[:-1]):
            raise Irregular
        self.compiled(e)
        for x in e.items:
            self.compiled(x)
            self.check(x, inside or e.kind == "repeat")

    def width(self, e: Step) -> int:
        """The number of tokens, if an expression is that many tokens and has no nodes; else 0."""
        match e.kind:
            case "token" | "any":
                return 1
            case "group":
                return self.width(e.items[0])
            case "seq":
                parts = [self.width(x) for x in e.items]
                return sum(parts) if all(parts) else 0
            case "alt":
                parts = [self.width(x) for x in e.items]
                return parts[0] if len(set(parts)) == 1 else 0
        return 0

    loop_of = TreeParser.loop_of

    # patterns

    def written(self, e: Step) -> bytes:
        """The pattern; whole, and never entered again once it matched."""
        match e.kind:
            case "token":
                return rb"\x%02x" % e.index
            case "any":
                return rb"[\x00-\xff]"
            case "node":
                out = self.written(self.nodes[e.index])
            case "capture" | "group":
                out = self.written(e.items[0])
            case "alt":
                out = b"(?>" + b"|".join(map(self.written, e.items)) + b")"
            case "repeat":
                out = b"(?:" + self.written(e.items[0]) + b")" + self.times(e) + b"+"
            case _:
                out = b"(?>" + b"".join(self.elements(e)) + b")"
        if len(out) > self.MOST:
            raise Irregular
        return out

    def times(self, e: Step) -> bytes:
        return b"?" if e.most == 1 else b"+" if e.least else b"*"

    def elements(self, e: Step) -> list[bytes]:
        """Of a sequence: a repetition there gives iterations back, if anything comes after it."""
        loops = [self.loop_of(x) for x in e.items[:-1]]
        return [b"(?:" + self.written(loop.items[0]) + b")" + self.times(loop) if loop else self.written(x) for x, loop in zip(e.items, [*loops, None], strict=False)]

    def compiled(self, e: Step) -> Callable[[bytes, int], re.Match[bytes] | None]:
        if id(e) not in self.patterns:
            text = b"".join(b"(" + x + b")" for x in self.elements(e)) if e.kind == "seq" else self.written(e)
            try:
                self.patterns[id(e)] = re.compile(text, re.DOTALL).match
            except (re.error, OverflowError, RecursionError) as error:
                raise Irregular from error
        return self.patterns[id(e)]

    # trees

    def parse(self, tokens: bytes, root: int) -> Node | None:
        """The root's tree over all tokens, or None."""
        self.tokens = tokens
        found = self.compiled(self.root)(tokens, 0)
        return self.node(root, 0, len(tokens)) if found and found.end() == len(tokens) else None

    def node(self, kind: int, at: int, end: int) -> Node:
        return Node(kind, at, end - at, [] if self.widths[kind] else self.edges(self.nodes[kind], at, end))

    def edges(self, e: Step, at: int, end: int) -> Edges:
        """Of an expression that is known to match from at to end."""
        match e.kind:
            case "node":
                return [(None, self.node(e.index, at, end))]
            case "capture":
                return [(e.field, n) for _, n in self.edges(e.items[0], at, end)]
            case "group":
                return self.edges(e.items[0], at, end)
            case "alt":
                return self.edges(next(x for x in e.items if self.compiled(x)(self.tokens, at)), at, end)
            case "repeat":
                return self.iterations(e.items[0], at, end)
            case "seq":
                out: Edges = []
                spans = self.compiled(e)(self.tokens, at).regs
                for item, (a, b) in zip(e.items, spans[1:], strict=True):
                    if item.kind != "token":
                        out += self.edges(item, a, b)
                return out
        return []

    def iterations(self, e: Step, at: int, end: int) -> Edges:
        if at == end:
            return []
        if e.kind == "node" and (width := self.widths[e.index]):
            return [(None, Run(e.index, at, (end - at) // width, width))]
        out: Edges = []
        match_ = self.compiled(e)
        while at < end:
            after = match_(self.tokens, at).end()
            out += self.edges(e, at, after)
            at = after
        return out


def first_field(node: Node, path: tuple[str, ...]) -> Node | None:
    """The node that a path of fields leads to; of several children in a field the first counts."""
    for name in path:
        node = next((n for f, n in node.children if f == name), None)
        if node is None:
            return None
        if isinstance(node, Run):
            node = node[0]
    return node
