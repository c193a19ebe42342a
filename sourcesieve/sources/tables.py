"""Rows of a table as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_table(df: DataFrame, path: Column, content: str) -> DataFrame:
    """sources(path, content): one source per row; a backslash in a path counts as a slash, null content is empty."""
    return df.select(F.replace(path, F.lit("\\"), F.lit("/")).alias("path"), F.coalesce(F.col(content).cast("binary"), F.lit(bytearray())).alias("content"))


def spread(sources: DataFrame) -> DataFrame:
    """Sources dealt out over all cores where they come in fewer splits than there are cores, as small files do.

    Scanning is CPU-bound, so that exchange pays. Inputs with a split per core, all large ones, stay as they are.
    """
    cores = sources.sparkSession.sparkContext.defaultParallelism
    return sources.repartition(cores) if sources.rdd.getNumPartitions() < cores else sources


def documents(df: DataFrame) -> DataFrame:
    """lang/source/doc_id.txt"""
    return from_table(df, F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), "text")


def pages(df: DataFrame) -> DataFrame:
    return from_table(df, F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), "html")


def conversations(df: DataFrame) -> DataFrame:
    return from_table(df, F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), "role"), "text")


def events(df: DataFrame) -> DataFrame:
    return from_table(df, F.concat(F.lit("events/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".json")), "props")
