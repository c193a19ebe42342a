"""Which tokens and nodes some rule holds for, told where they are, so that no others become rows.

What holds is what conditions as columns say (``functions.conditions``): comparisons are bytewise, what is missing is an empty text,
and a gap that isn't there satisfies nothing that asks for its blank lines.
"""

from __future__ import annotations

import operator
from bisect import bisect_left
from collections.abc import Callable, Iterable

import numpy as np

from sourcesieve.operators.trees import Node, Run, first_field
from sourcesieve.plans.program import Check, Program, RulePlan, Value

COMPARED = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def holds(left: bytes | int | None, operator_: str, right: bytes | int | None) -> bool:
    if left is None or right is None:
        return False
    return COMPARED[operator_](left, right) if operator_ in COMPARED else left.startswith(right)


class Tokens:
    """The emitted tokens of a source, by columns."""

    def __init__(self, data: bytes, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.kinds, self.starts, self.ends = data, kinds, starts, ends
        self.lists = [memoryview(np.ascontiguousarray(x, dtype=np.int64)) for x in (kinds, starts, ends)]  # gives Python's integers
        self.listed: dict[int, list[int]] = {}
        self.checked: dict[tuple[int, int], np.ndarray] = {}  # by the id of a check: a program's, which stay

    def __len__(self) -> int:
        return len(self.kinds)

    def __getitem__(self, i: int) -> tuple[int, int, int]:
        kinds, starts, ends = self.lists
        return kinds[i], starts[i], ends[i]

    def of(self, kinds: Iterable[int] | None) -> list[int] | range:
        """The places of tokens of some kinds, or of all."""
        return range(len(self)) if kinds is None else np.flatnonzero(np.isin(self.kinds, list(kinds))).tolist()

    def span(self, n: Node) -> tuple[int, int]:
        """The bytes of a node; a node without tokens is at the next token, or at the end of the last."""
        _, starts, ends = self.lists
        if n.count:
            return starts[n.first], ends[n.first + n.count - 1]
        at = starts[n.first] if n.first < len(self) else ends[-1] if len(self) else 0
        return at, at

    def that(self, kind: int, check: Check | None) -> np.ndarray:
        """The places of tokens of a kind whose text or length a check, which asks for no more, holds for. kind -1: any."""
        key = (kind, id(check))
        if key not in self.checked:
            at = np.flatnonzero(self.kinds == kind) if kind >= 0 else np.arange(len(self))
            self.checked[key] = at[self._passed(at, check)] if check and len(at) else at
        return self.checked[key]

    def places(self, check: Check) -> list[int]:
        """that(), for tokens of any kind, as a list."""
        if id(check) not in self.listed:
            self.listed[id(check)] = self.that(-1, check).tolist()
        return self.listed[id(check)]

    def _passed(self, at: np.ndarray, check: Check) -> np.ndarray:
        starts, data = self.starts[at], self.data
        sizes = self.ends[at] - starts
        if check.left.prop == "length":
            return COMPARED[check.operator](sizes, sizes if isinstance(check.right, Value) else check.right)
        if isinstance(check.right, bytes) and check.operator in ("==", "startsWith"):
            text = check.right
            passed = sizes == len(text) if check.operator == "==" else sizes >= len(text)
            found = np.flatnonzero(passed)
            of = np.frombuffer(data, dtype=np.uint8)
            for k, byte in enumerate(text):
                found = found[of[starts[found] + k] == byte]
            passed[:] = False
            passed[found] = True
            return passed
        texts = (data[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True))
        return np.fromiter((holds(t, check.operator, t if isinstance(check.right, Value) else check.right) for t in texts), dtype=bool, count=len(at))


def plain(check: Check | None) -> bool:
    """Whether a check asks for the text or length of what is matched alone."""
    sides = [v for v in (check.left, check.right) if isinstance(v, Value)] if check else []
    return all(v.subject == "match" and not v.path and v.prop == sides[0].prop for v in sides)


class Held:
    """The rules of a program as tests of tokens and nodes."""

    def __init__(self, program: Program):
        self.token_rules = [r for r in program.rules if not r.node]
        self.node_rules: dict[int, list[Callable[[Node, int | None, list[int], Node | None, Tokens], bool]]] = {}
        self.by_text: dict[int, list[Check | None] | None] = {}  # of nodes whose rules ask for their own text at most
        for r in program.rules:
            if r.node:
                self.node_rules.setdefault(r.target, []).append(self._test(r))
                known = self.by_text.setdefault(r.target, [])
                if r.left >= 0 or not plain(r.check):
                    self.by_text[r.target] = None
                elif known is not None:
                    known.append(r.check)

    def tokens(self, tokens: Tokens) -> list[int]:
        """The places, in order, of tokens that some token rule holds for."""
        found = [tokens.that(r.target, r.check) for r in self.token_rules]
        return (np.unique(np.concatenate(found)) if len(found) > 1 else found[0]).tolist() if found else []

    def of_run(self, run: Run, tokens: Tokens) -> Iterable[int]:
        """Which nodes of a run some rule may hold for."""
        checks = self.by_text.get(run.kind)
        if run.width != 1 or checks is None or None in checks:
            return range(run.number)
        found: set[int] = set()
        for check in checks:
            at = tokens.places(check)
            a = bisect_left(at, run.first)
            found.update(x - run.first for x in at[a : bisect_left(at, run.first + run.number, a)])
        return sorted(found) if found else ()

    def node(self, n: Node, parent_kind: int | None, above: list[int], left: Node | None, tokens: Tokens) -> bool:
        return any(test(n, parent_kind, above, left, tokens) for test in self.node_rules.get(n.kind, ()))

    def _test(self, rule: RulePlan) -> Callable[[Node, int | None, list[int], Node | None, Tokens], bool]:
        check = rule.check
        scope, scope_kind, left_kind = rule.scope, rule.scope_kind, rule.left
        value = _value(check.left) if check else None
        other = _value(check.right) if check and isinstance(check.right, Value) else None

        def test(n: Node, parent_kind: int | None, above: list[int], left: Node | None, tokens: Tokens) -> bool:
            if scope == "inside" and scope_kind not in above or scope == "outside" and scope_kind in above:
                return False
            if scope == "parent" and parent_kind != scope_kind or scope == "notparent" and parent_kind == scope_kind:
                return False
            if left_kind >= 0 and not scope and (left is None or left.kind != left_kind):
                return False
            return check is None or holds(value(n, left, tokens), check.operator, other(n, left, tokens) if other else check.right)

        return test


def _value(v: Value) -> Callable[[Node, Node | None, Tokens], bytes | int | None]:
    def gap(n: Node, left: Node | None, tokens: Tokens) -> bytes | int | None:
        there = left is not None and n.count and left.count
        text = tokens.data[tokens.span(left)[1] : tokens.span(n)[0]] if there else b""
        if v.prop == "blankLines":
            return max(text.count(b"\n") - 1, 0) if there else None
        return len(text) if v.prop == "length" else text

    def of_node(n: Node, left: Node | None, tokens: Tokens) -> bytes | int:
        x = left if v.subject == "left" else n
        if x is not None and v.path:
            x = first_field(x, v.path)
        a, b = tokens.span(x) if x is not None else (0, 0)
        return b - a if v.prop == "length" else tokens.data[a:b]

    return gap if v.subject == "gap" else of_node
