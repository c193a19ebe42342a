"""Longest-match scanning of bytes.

Token expressions become one nondeterministic machine and, by subset construction, one table of 256 columns; a state's accept
is the smallest index of the tokens that end there. Grammars whose tokens are runs of byte classes and fixed strings, told apart
by their first bytes, scan with one compiled pattern instead, and give the same tokens (``Scanner.pattern``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from sourcesieve.dsl.document import Expr

Bytes = frozenset[int]


class _Machine:
    """Byte edges and empty edges between numbered states."""

    def __init__(self, definitions: dict[str, Expr]):
        self.edges: list[list[tuple[Bytes, int]]] = []
        self.empty: list[list[int]] = []
        self.definitions = definitions

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, e: Expr, start: int) -> int:
        """Adds an expression after start; gives the state where it ends."""
        match e.kind:
            case "ref":
                return self.add(self.definitions[e.head.text], start)
            case "group":
                return self.add(e.items[0], start)
            case "seq":
                for item in e.items:
                    start = self.add(item, start)
                return start
            case "alt":
                ends = []
                for item in e.items:
                    own = self.state()
                    self.empty[start].append(own)
                    ends.append(self.add(item, own))
                end = self.state()
                for x in ends:
                    self.empty[x].append(end)
                return end
            case "repeat":
                first = self.state()
                self.empty[start].append(first)
                last = self.add(e.items[0], first)
                end = self.state()
                self.empty[last].append(end)
                if e.head.kind != "?":
                    self.empty[last].append(first)
                if e.head.kind != "+":
                    self.empty[start].append(end)
                return end
        for some in byte_sets(e):
            end = self.state()
            self.edges[start].append((some, end))
            start = end
        return start

    def closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return frozenset(states)


def byte_sets(e: Expr) -> list[Bytes]:
    """The bytes, place by place, of a character, range or string."""
    if e.kind == "range":
        return [frozenset(range(ord(e.head.value), ord(e.to.value) + 1))]
    return [frozenset([ord(c)]) for c in e.head.value]


@dataclass(frozen=True)
class Token:
    name: str
    expr: Expr | None
    skip: bool


def build_table(tokens: list[Token], definitions: dict[str, Expr]) -> tuple[np.ndarray, np.ndarray]:
    """(next state or -1, by state and byte; token or -1, by state). State 0 is the start."""
    machine = _Machine(definitions)
    start = machine.state()
    ends: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.expr:
            own = machine.state()
            machine.empty[start].append(own)
            end = machine.state()
            machine.empty[machine.add(t.expr, own)].append(end)
            ends[end] = i
    numbers = {machine.closure({start}): 0}
    todo = list(numbers)
    rows: list[list[int]] = []
    accepts: list[int] = []
    while todo:
        states = todo.pop(0)
        by_byte: dict[int, set[int]] = {}
        for s in states:
            for some, to in machine.edges[s]:
                for b in some:
                    by_byte.setdefault(b, set()).add(to)
        row = [-1] * 256
        known: dict[frozenset[int], frozenset[int]] = {}
        for b, to in by_byte.items():
            key = frozenset(to)
            if key not in known:
                known[key] = machine.closure(set(to))
            if known[key] not in numbers:
                numbers[known[key]] = len(numbers)
                todo.append(known[key])
            row[b] = numbers[known[key]]
        rows.append(row)
        accepts.append(min((ends[s] for s in states if s in ends), default=-1))
    return np.array(rows, dtype=np.int32), np.array(accepts, dtype=np.int32)


def _one_set(e: Expr, definitions: dict[str, Expr]) -> Bytes | None:
    """The bytes of an expression that matches one byte, whatever it is built of."""
    match e.kind:
        case "ref":
            return _one_set(definitions[e.head.text], definitions)
        case "group":
            return _one_set(e.items[0], definitions)
        case "alt":
            parts = [_one_set(x, definitions) for x in e.items]
            return None if None in parts else frozenset().union(*parts)
        case "character" | "range" | "string":
            sets = byte_sets(e)
            return sets[0] if len(sets) == 1 else None
    return None


def _run(e: Expr, definitions: dict[str, Expr]) -> tuple[Bytes, Bytes] | None:
    """(first, rest) for an expression that matches one byte of first and any number of rest, else None."""
    if (one := _one_set(e, definitions)) is not None:
        return one, frozenset()
    match e.kind:
        case "ref":
            return _run(definitions[e.head.text], definitions)
        case "group":
            return _run(e.items[0], definitions)
        case "repeat":
            one = _one_set(e.items[0], definitions)
            return (one, one) if one is not None and e.head.kind == "+" else None
        case "seq":
            if len(e.items) == 2 and e.items[1].kind == "repeat" and e.items[1].head.kind == "*":
                first, rest = _one_set(e.items[0], definitions), _one_set(e.items[1].items[0], definitions)
                return (first, rest) if first is not None and rest is not None else None
    return None


def _fixed(e: Expr, definitions: dict[str, Expr]) -> bytes | None:
    match e.kind:
        case "ref":
            return _fixed(definitions[e.head.text], definitions)
        case "group":
            return _fixed(e.items[0], definitions)
        case "character" | "string":
            return e.head.value.encode("latin-1") or None
        case "seq":
            parts = [_fixed(x, definitions) for x in e.items]
            return None if None in parts else b"".join(parts)
    return None


def _byte_class(some: Bytes) -> bytes:
    return b"[" + b"".join(rb"\x%02x" % b for b in sorted(some)) + b"]"


class Scanner:
    """Tokens of a byte string: (token index, start, end) each, and where nothing matched, or -1."""

    def __init__(self, tokens: list[Token], definitions: dict[str, Expr]):
        self.table, self.accepts = build_table(tokens, definitions)
        self.fallback = next((i for i, t in enumerate(tokens) if t.expr is None), -1)
        self.skip = frozenset(i for i, t in enumerate(tokens) if t.skip)
        self.skipped = np.array([t.skip for t in tokens], dtype=bool)
        self.pattern, self.groups, self.words = self._pattern(tokens, definitions)
        self.classes = self._classes(tokens, definitions) if self.pattern and not self.words else None
        self._rows: list[list[int]] | None = None

    def _pattern(self, tokens: list[Token], definitions: dict[str, Expr]) -> tuple[re.Pattern[bytes] | None, list[int], dict[tuple[int, bytes], int]]:
        """One pattern for all tokens if that is provably longest match with the earlier token on ties.

        Runs start on bytes of their own, and so at most one run can match at a place. A fixed string either starts where no run
        does (the longest of these first), or lies inside what one run matches: then the run is as long at least, and the string
        wins where it is the whole run and declared earlier.
        """
        runs: list[tuple[int, Bytes, Bytes]] = []
        strings: list[tuple[int, bytes]] = []
        for i, t in enumerate(tokens):
            if t.expr is None:
                continue
            if (text := _fixed(t.expr, definitions)) is not None:
                strings.append((i, text))
            elif (run := _run(t.expr, definitions)) is not None:
                runs.append((i, *run))
            else:
                return None, [], {}
        if any(a[1] & b[1] for n, a in enumerate(runs) for b in runs[:n]):
            return None, [], {}
        groups: list[int] = []
        parts: list[bytes] = []
        words: dict[tuple[int, bytes], int] = {}
        for i, first, rest in runs:
            parts.append(b"(" + _byte_class(first) + (_byte_class(rest) + b"*" if rest else b"") + b")")
            groups.append(i)
        alone: dict[bytes, int] = {}
        for i, text in strings:
            under = next(((r, rest) for r, first, rest in runs if text[0] in first), None)
            if under is None:
                alone.setdefault(text, i)
            elif set(text[1:]) <= under[1]:
                if i < under[0]:
                    words.setdefault((under[0], text), i)
            else:
                return None, [], {}
        for text, i in sorted(alone.items(), key=lambda x: -len(x[0])):
            parts.append(b"(" + re.escape(text) + b")")
            groups.append(i)
        if len(parts) > 90:
            return None, [], {}
        parts.append(rb"([\x00-\xff])")  # the fallback, or what nothing matches
        groups.append(self.fallback)
        return re.compile(b"|".join(parts)), groups, words

    def _classes(self, tokens: list[Token], definitions: dict[str, Expr]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(class by byte, whether a class gives a token per byte, token by class) if each token is one byte or a run of any bytes
        of its class, and so ends where the class does. The last class is that of bytes in no token."""
        by_byte = np.full(256, len(tokens), dtype=np.int64)
        alone = np.ones(len(tokens) + 1, dtype=bool)
        for i, t in enumerate(tokens):
            if t.expr is None:
                continue
            if (text := _fixed(t.expr, definitions)) is not None:
                first, rest = (frozenset(text), frozenset()) if len(text) == 1 else (None, None)
            else:
                first, rest = _run(t.expr, definitions) or (None, None)
            if first is None or rest and rest != first:
                return None
            some = [b for b in first if by_byte[b] == len(tokens)]  # of equal strings the first counts
            by_byte[some], alone[i] = i, not rest
        kinds = np.arange(len(tokens) + 1)
        kinds[-1] = self.fallback
        return by_byte, alone, kinds

    def emitted(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(token, start, end) of what scan() finds and isn't skipped, a column each, and where nothing matched, or -1."""
        if self.classes is None:
            found, failed = self.scan(data)
            columns = np.array(found, dtype=np.int64).reshape(-1, 3).T
            kinds, starts, ends = (np.ascontiguousarray(c) for c in columns)
        else:
            by_byte, alone, names = self.classes
            at = by_byte[np.frombuffer(data, dtype=np.uint8)]
            failed = -1
            if self.fallback < 0 and len(missed := np.flatnonzero(at == len(names) - 1)):
                failed = int(missed[0])
                at = at[:failed]
            cuts = np.flatnonzero((at[1:] != at[:-1]) | alone[at[1:]]) + 1
            edges = np.empty(len(cuts) + 2 if len(at) else 1, dtype=np.int64)
            edges[0], edges[1:-1], edges[-1] = 0, cuts, len(at)
            starts, ends = edges[:-1], edges[1:]
            kinds = names[at[starts]]
        if self.skip:
            kept = ~self.skipped[kinds]
            kinds, starts, ends = kinds[kept], starts[kept], ends[kept]
        return kinds, starts, ends, failed

    def scan(self, data: bytes) -> tuple[list[tuple[int, int, int]], int]:
        return self._scan_pattern(data) if self.pattern else self._scan_table(data)

    def _scan_pattern(self, data: bytes) -> tuple[list[tuple[int, int, int]], int]:
        groups, words = [-1, *self.groups], self.words
        found = [(groups[m.lastindex], *m.span()) for m in self.pattern.finditer(data)]
        if words:
            runs = {r for r, _ in words}
            found = [(words.get((t, data[a:b]), t), a, b) if t in runs else (t, a, b) for t, a, b in found]
        if self.fallback < 0:
            for n, (t, a, _) in enumerate(found):
                if t < 0:
                    return found[:n], a
        return found, -1

    def _scan_table(self, data: bytes) -> tuple[list[tuple[int, int, int]], int]:
        if self._rows is None:
            self._rows = self.table.tolist()
        rows, accepts, n = self._rows, self.accepts.tolist(), len(data)
        found: list[tuple[int, int, int]] = []
        at = 0
        while at < n:
            state, end, token, i = 0, -1, -1, at
            while i < n and (state := rows[state][data[i]]) >= 0:
                i += 1
                if accepts[state] >= 0:
                    end, token = i, accepts[state]
            if end < 0:
                if self.fallback < 0:
                    return found, at
                end, token = at + 1, self.fallback
            found.append((token, at, end))
            at = end
        return found, -1

