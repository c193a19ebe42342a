"""python -m sourcesieve.cli [-print-ast] <document> <directory>

Prints diagnostics in the order of the directory walk. Exit status: 0 without diagnostics, 1 with any, 2 if something is wrong
with the arguments, the document or the files.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesieve.dsl.parser import DocumentError
from sourcesieve.operators import diagnostics as D
from sourcesieve.plans.analysis import Analysis
from sourcesieve.sources.directory import directory

USAGE = "usage: sourcesieve [-print-ast] <dsl-file> <directory>"


def options(args: list[str]) -> tuple[str, str, bool]:
    flags, paths = {"-print-ast", "--print-ast"}, []
    for a in args:
        if a.startswith("-") and a not in flags:
            raise ValueError(f"unknown flag {json.dumps(a)}")
        if a not in flags:
            paths.append(a)
    if len(paths) != 2:
        raise ValueError("expected DSL file path and analysis directory")
    return paths[0], paths[1], any(a in flags for a in args)


def lines(analysis: Analysis, sources: DataFrame, trees: bool = False) -> DataFrame:
    """(value, found) in order: a source's tree, if asked for, comes before its diagnostics."""
    found = D.rendered(analysis.diagnostics(sources)).select("path", *D.ORDER, "value", F.lit(1).alias("found"))
    if trees:
        drawn = analysis.trees(sources).select("path", F.lit(-1).alias("phase"), F.lit(0).cast("long").alias("clock"), F.lit(0).alias("sub"), F.lit(-1).alias("rule_idx"), F.concat("path", F.lit("\n"), "tree").alias("value"), F.lit(0).alias("found"))
        found = found.unionByName(drawn)
    return D.in_order(found).select("value", "found")


def run(args: list[str], out: TextIO, err: TextIO, session: Callable[[], SparkSession]) -> int:
    try:
        document, root, trees = options(args)
    except ValueError as e:
        print(f"{e}\n{USAGE}", file=err)
        return 2
    try:
        with open(document, "rb") as f:
            source = f.read()
    except OSError as e:
        print(f"failed to read DSL file {json.dumps(document)}: {e.strerror}", file=err)
        return 2
    try:
        analysis = Analysis(source)
    except DocumentError as e:
        for p in e.problems:
            print(f"{document}:{p.span[0]}-{p.span[1]}: error: {p.message}", file=err)
        return 2
    if not os.path.exists(root):
        print(f"failed to stat analysis directory {json.dumps(root)}: no such file or directory", file=err)
        return 2
    if not os.path.isdir(root):
        print(f"analysis path {json.dumps(root)} is not a directory", file=err)
        return 2
    status = 0
    try:
        for row in lines(analysis, directory(session(), root, analysis.program.scope), trees).toLocalIterator():
            print(row["value"], file=out)
            status |= row["found"]
    except Exception as e:  # whatever a listing or a read raised
        print(f"failed to analyze directory {json.dumps(root)}: {e}", file=err)
        return 2
    return status


def main() -> int:
    return run(sys.argv[1:], sys.stdout, sys.stderr, lambda: SparkSession.builder.appName("sourcesieve").config("spark.ui.showConsoleProgress", "false").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
