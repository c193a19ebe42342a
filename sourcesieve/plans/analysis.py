"""The library's entry: a document applied to sources."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sourcesieve.operators import diagnostics as D
from sourcesieve.operators.frames import Wanted, errors_frame, nodes_frame, scan_and_parse, token_lists, tokens_frame
from sourcesieve.plans.program import Program, compile_document


class Analysis:
    """A compiled document; its methods build plans over sources (path string, content binary or string)."""

    def __init__(self, document: str | bytes | Program, backtrack_captures: bool = False):
        self.program = document if isinstance(document, Program) else compile_document(document, backtrack_captures)

    def in_scope(self, sources: DataFrame) -> DataFrame:
        return sources.filter(self.program.scope.condition(sources["path"]))

    def tokens(self, sources: DataFrame, texts: bool = True) -> DataFrame:
        return tokens_frame(self.in_scope(sources), self.program, texts)

    def token_lists(self, sources: DataFrame) -> DataFrame:
        return token_lists(self.in_scope(sources), self.program)

    def nodes(self, sources: DataFrame, texts: bool = False) -> DataFrame:
        return nodes_frame(self.in_scope(sources), self.program, texts)

    def errors(self, sources: DataFrame) -> DataFrame:
        return errors_frame(self.in_scope(sources), self.program)

    def diagnostics(self, sources: DataFrame, first: bool = False, ordered: bool = False) -> DataFrame:
        rows = scan_and_parse(self.in_scope(sources), self.program, Wanted.by_rules(self.program))
        found = D.first_only(D.diagnostics_of(rows, self.program, "source")) if first else D.diagnostics_of(rows, self.program)
        return D.in_order(found) if ordered else found

    def trees(self, sources: DataFrame) -> DataFrame:
        return D.tree_text(nodes_frame(self.in_scope(sources), self.program, False, "source"))
