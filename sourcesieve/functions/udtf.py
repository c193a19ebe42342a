"""Scanning as a table function for SQL: SELECT * FROM t, LATERAL sieve_tokens(t.content)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sourcesieve.plans.program import Program


def register_tokens(spark: SparkSession, program: Program, name: str = "sieve_tokens") -> None:
    """Registers the scanner of a program; rows are tok_idx, name, start and end of emitted tokens."""

    @udtf(returnType="tok_idx int, name string, start long, end long")
    class Tokens:
        def eval(self, content: bytes) -> Iterator[tuple[int, str, int, int]]:
            scanner = program.scanner
            found, _ = scanner.scan(bytes(content or b""))
            for i, (kind, a, b) in enumerate(t for t in found if t[0] not in scanner.skip):
                yield i, program.tokens[kind].name, a, b

    spark.udtf.register(name, Tokens)
