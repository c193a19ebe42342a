"""A directory as a Spark data source: recursive, hidden files included, files outside the scope never opened.

The driver lists; partitions are runs of the sorted listing of about equal bytes; tasks read whole files. All machines must see
the directory at the same place; for object stores use files().
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sourcesieve.operators.scope import Scope

PARTITION_BYTES = 32 << 20
PARTITION_FILES = 10_000


def listing(root: str, scope: Scope) -> list[tuple[str, int]]:
    """(path below root, bytes) of regular files in scope, names ascending in each directory, as a walk meets them.

    A directory that can't be read ends the listing with its error. What is neither a file nor a directory is left out.
    """

    def below(folder: str, prefix: str) -> Iterator[tuple[str, int]]:
        for entry in sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name)):
            path = prefix + entry.name
            if entry.is_dir(follow_symlinks=False):
                yield from below(entry.path, path + "/")
            elif entry.is_file() and scope.matches(path):
                yield path, entry.stat().st_size

    return list(below(root, ""))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.scope = Scope(*map(tuple, json.loads(options.get("scope", '[["**"], []]'))))

    def partitions(self) -> list[Files]:
        out: list[list[str]] = []
        held = PARTITION_BYTES
        for path, size in listing(self.root, self.scope):
            if held + size > PARTITION_BYTES or len(out[-1]) >= PARTITION_FILES:
                out.append([])
                held = 0
            out[-1].append(path)
            held += size
        return [Files(p) for p in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                yield path, f.read()


class DirectorySource(DataSource):
    """Format ``sieve_directory``; options path, and scope as JSON: [[includes], [excludes]]."""

    @classmethod
    def name(cls) -> str:
        return "sieve_directory"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def directory(spark: SparkSession, root: str, scope: Scope | None = None) -> DataFrame:
    """sources(path, content) of the files below root that are in scope."""
    spark.dataSource.register(DirectorySource)
    scope = scope or Scope(("**",))
    return spark.read.format(DirectorySource.name()).option("path", os.path.abspath(root)).option("scope", json.dumps([scope.includes, scope.excludes])).load()


def below(root: str, path: Column) -> Column:
    """Paths of Spark's file source as paths below root. It gives names as they are, not encoded."""
    folder = "/" + root.split("://")[1].partition("/")[2] if "://" in root else os.path.abspath(root.removeprefix("file:"))
    base = "/" + folder.strip("/") + "/" if folder.strip("/") else "/"
    return F.element_at(F.split(path, F.lit(rf"\A(?:[^/:]+:)?(?://[^/]*(?=/))?\Q{base}\E"), 2), -1)


def files(spark: SparkSession, root: str, scope: Scope | None = None) -> DataFrame:
    """sources(path, content) from any store, by Spark's own file source; it leaves out names that begin with ``_`` or ``.``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = found.select(below(root, F.col("path")).alias("path"), "content")
    return rows.filter(scope.condition(rows["path"])) if scope else rows
