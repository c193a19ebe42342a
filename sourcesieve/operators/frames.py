"""The Arrow stage: one pass over each source gives tokens, tree nodes and failures as rows.

A row says by ``rec`` what it is: token, node, scan (no token matched) or parse (the root didn't match). The stage gets told
which token and node kinds are wanted and whose text, so what no rule looks at never leaves the task. A node's row holds what
rules ask of its relatives, too: kinds of its ancestors, the sibling before it, the gap between, and texts at the ends of field
paths. So rules need no join and no shuffle. A source is the unit of work and is never split. For rules the stage gives only
rows that some rule holds for (``operators.held``); which rules these are is left to the columns.

Edge cases: a null content is empty; an empty source has no tokens, and its root must match nothing; equal paths are separate
sources with equal paths; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcesieve.operators.automaton import Scanner
from sourcesieve.operators.held import Held, Tokens
from sourcesieve.operators.trees import Node, PatternParser, Run, TreeParser, first_field
from sourcesieve.plans.program import Program

B, I, L, S = T.BinaryType(), T.IntegerType(), T.LongType(), T.StringType()
SCHEMA = T.StructType(
    [
        T.StructField(n, k)
        for n, k in (
            ("path", S), ("rec", S), ("idx", I), ("kind", I), ("start", L), ("end", L), ("text", B),
            ("parent_id", I), ("parent_kind", I), ("ordinal", I), ("field", S), ("ancestor_kinds", T.ArrayType(I)),
            ("first_tok", I), ("n_tok", I), ("enter", L), ("exit", L), ("parent_exit", L), ("depth", I),
            ("path_texts", T.ArrayType(B)), ("left_kind", I), ("left_text", B), ("left_path_texts", T.ArrayType(B)), ("gap", B), ("gap_blank_lines", L), ("source", L),
        )
    ]
)
ARROW = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.int64(), pa.int64()]
ROWS = 20_000


@dataclass(frozen=True)
class Wanted:
    """What rows to give. None: all kinds. texts: kinds whose text is wanted."""

    tokens: frozenset[int] | None = frozenset()
    token_texts: frozenset[int] | None = frozenset()
    nodes: frozenset[int] | None = frozenset()
    node_texts: frozenset[int] | None = frozenset()
    gaps: bool = False
    errors: bool = True
    held: bool = False  # only what some rule holds for

    @staticmethod
    def by_rules(program: Program) -> Wanted:
        token_rules = [r for r in program.rules if not r.node]
        node_rules = [r for r in program.rules if r.node]
        texts = {r.target if v.subject == "match" else r.left for r in node_rules for v in r.values() if v.subject != "gap" and not v.path}
        return Wanted(
            frozenset(r.target for r in token_rules),
            frozenset(r.target for r in token_rules if r.check),
            frozenset(r.target for r in node_rules),
            frozenset(texts),
            any(v.subject == "gap" for r in node_rules for v in r.values()),
            held=True,
        )


@lru_cache(maxsize=4)
def _tools(program: Program) -> tuple[Scanner, PatternParser | TreeParser, Held]:
    return program.scanner, program.tree_parser(), Held(program)


def source_rows(tools: tuple[Scanner, PatternParser | TreeParser, Held], path: str, data: bytes, program: Program, wanted: Wanted) -> Iterator[tuple]:
    scanner, parser, held = tools
    kinds, starts, ends, failed = scanner.emitted(data)
    tokens = Tokens(data, kinds, starts, ends)
    none = (None,) * 17
    if wanted.tokens is None or wanted.tokens:
        for i in held.tokens(tokens) if wanted.held else tokens.of(wanted.tokens):
            kind, a, b = tokens[i]
            yield (path, "token", i, kind, a, b, data[a:b] if wanted.token_texts is None or kind in wanted.token_texts else None, *none)
    if failed >= 0:
        if wanted.errors:
            yield (path, "scan", None, None, failed, failed + 1, None, *none)
        return
    if program.root < 0 or not (wanted.errors or wanted.nodes is None or wanted.nodes):
        return
    numbers = kinds.astype(np.uint8).tobytes() if len(program.tokens) <= 256 else kinds.tolist()
    root = parser.parse(numbers, program.root)
    if root is None:
        if wanted.errors:
            yield (path, "parse", None, program.root, 0, len(data), None, *none)
    elif wanted.nodes is None or wanted.nodes:
        yield from node_rows(path, tokens, root, program, wanted, held if wanted.held else None)


def node_rows(path: str, tokens: Tokens, root: Node, program: Program, wanted: Wanted, held: Held | None) -> Iterator[tuple]:
    """Rows of a tree's nodes, children before parents. enter and exit count steps of a depth-first walk.

    Rows are made for wanted kinds alone, and texts and paths for kinds whose rules look at them. Nodes of a run are not looked at
    one by one where no rule, or no more than the text of their one token, asks for them.
    """
    paths, gaps = program.paths, wanted.gaps
    every, texts = wanted.nodes is None, wanted.node_texts
    data, span = tokens.data, tokens.span
    rows: list[list] = []
    ids = clock = 0

    def text(n: Node) -> bytes | None:
        return data[slice(*span(n))] if texts is None or n.kind in texts else None

    def path_texts(n: Node) -> list[bytes | None]:
        ends = [first_field(n, p) for p in paths]
        return [data[slice(*span(x))] if x else None for x in ends]

    def walk(n: Node, parent_kind: int | None, ordinal: int | None, name: str | None, above: list[int], left: Node | None) -> list | None:
        nonlocal ids, clock
        enter = clock
        clock += 1
        below = []
        if n.children:
            under, before, i = [*above, n.kind], None, 0
            for f, child in n.children:
                if not isinstance(child, Run):
                    if row := walk(child, n.kind, i, f, under, before):
                        below.append(row)
                    i, before = i + 1, child
                    continue
                at = range(child.number) if every else held.of_run(child, tokens) if held and child.kind in wanted.nodes else range(child.number) if child.kind in wanted.nodes else ()
                first_id, first_clock = ids, clock
                for k in at:
                    ids, clock = first_id + k, first_clock + 2 * k
                    if row := walk(child[k], n.kind, i + k, f, under, child[k - 1] if k else before):
                        below.append(row)
                ids, clock = first_id + child.number, first_clock + 2 * child.number
                i, before = i + child.number, child[-1]
        own = ids
        ids += 1
        leave = clock
        clock += 1
        for row in below:
            row[7], row[16] = own, leave
        if not every and n.kind not in wanted.nodes or held and not held.node(n, parent_kind, above, left, tokens):
            return None
        a, b = span(n)
        row = [path, "node", own, n.kind, a, b, text(n) if texts is None or texts else None, None, parent_kind, ordinal, name, above, n.first, n.count, enter, leave, None, len(above), None, None, None, None, None, 0]
        if paths:
            row[18] = path_texts(n)
        if left is not None:
            row[19] = left.kind
            if texts is None or texts:
                row[20] = text(left)
            if paths:
                row[21] = path_texts(left)
            if gaps and n.count and left.count:
                row[22] = gap = data[span(left)[1] : a]
                row[23] = max(gap.count(b"\n") - 1, 0)
        rows.append(row)
        return row

    walk(root, None, None, None, [], None)
    yield from map(tuple, rows)


def scan_and_parse(sources: DataFrame, program: Program, wanted: Wanted) -> DataFrame:
    """Rows of all sources (path, content); one narrow stage, also on streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        of: list[int] = []  # the source of each row: equal paths are told apart by it
        source = TaskContext.get().partitionId() << 33
        tools = _tools(program)

        def batch_of() -> pa.RecordBatch:
            columns = [*zip(*rows, strict=True), of]
            return pa.RecordBatch.from_arrays([pa.nulls(len(rows), k) if x[0] is x[-1] is None and not any(map(_some, x)) else pa.array(x, k) for x, k in zip(columns, ARROW, strict=True)], names=SCHEMA.names)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source += 1
                for row in source_rows(tools, path, content.as_py() or b"", program, wanted):
                    rows.append(row)
                    of.append(source)
                    if len(rows) >= ROWS:
                        yield batch_of()
                        rows.clear()
                        of.clear()
        if rows:
            yield batch_of()

    return sources.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def _some(x: object) -> bool:
    return x is not None


def tokens_frame(sources: DataFrame, program: Program, texts: bool = True) -> DataFrame:
    """tokens(path, tok_idx, token_id, name, text, start, end)"""
    rows = scan_and_parse(sources, program, Wanted(tokens=None, token_texts=None if texts else frozenset(), errors=False))
    names = F.array(*[F.lit(t.name) for t in program.tokens])
    return rows.select("path", F.col("idx").alias("tok_idx"), F.col("kind").alias("token_id"), F.get(names, F.col("kind")).alias("name"), "text", "start", "end")


def token_lists(sources: DataFrame, program: Program) -> DataFrame:
    """(path, tokens): each source's emitted tokens as one list, null where it doesn't scan; made where the source is, without a shuffle.

    For consumers that want whole sources; rows of tokens_frame() are what large sources should be read as.
    """
    names = [t.name for t in program.tokens]
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _tools(program)[0]
        for batch in batches:
            lists = []
            for content in batch.column(1):
                found, failed = scanner.scan(content.as_py() or b"")
                lists.append(None if failed >= 0 else [{"name": names[t], "start": a, "end": b} for t, a, b in found if t not in scanner.skip])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], names=["path", "tokens"])

    return sources.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, tokens array<struct<name:string,start:bigint,end:bigint>>")


def nodes_frame(sources: DataFrame, program: Program, texts: bool = False, *more: str) -> DataFrame:
    """nodes(path, node_id, kind, kind_name, parent_id, ...), and more columns of the stage"""
    rows = scan_and_parse(sources, program, Wanted(nodes=None, node_texts=None if texts else frozenset(), errors=False))
    names = F.array(*[F.lit(n) for n in program.node_names])
    return rows.select("path", F.col("idx").alias("node_id"), "kind", F.get(names, F.col("kind")).alias("kind_name"), "parent_id", "parent_kind", "ordinal", "field", "ancestor_kinds", "first_tok", "n_tok", "start", "end", "enter", "exit", "depth", "text", *more)


def errors_frame(sources: DataFrame, program: Program) -> DataFrame:
    """errors(path, rec, start, end): sources that don't scan or don't parse."""
    return scan_and_parse(sources, program, Wanted()).select("path", "rec", "start", "end")
