"""Streams of sources. Scanning, parsing and rules look at one source at a time, so a stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourcesieve.plans.analysis import Analysis
from sourcesieve.sources.directory import below


def stream_directory(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """sources(path, content) of files as they arrive below root; paths are those below root, as scope patterns mean them."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return found.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root).select(below(root, F.col("path")).alias("path"), "content")


def stream_diagnostics(analysis: Analysis, sources: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Appends diagnostics to Parquet, each source once, whatever fails; stops when what is there has been read."""
    found = analysis.diagnostics(sources)
    return found.writeStream.format("parquet").outputMode("append").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
