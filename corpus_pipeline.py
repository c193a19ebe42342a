"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

quality    rejects documents that the classifier scores below its threshold
neardup    keeps one document of each group of near-copies (five-word shingles, similarity 0.8)
secrets    replaces secrets inside texts
mix        takes documents as often as their source's target asks for; a document may occur up to three times, or not at all
bpe        gives the token ids of the texts
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesieve.llm import bpe, mixing, quality, secrets, simhash
from sourcesieve.llm.queries import vocabulary
from sourcesieve.llm.shared import free, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays from the threshold on. Texts without words, null ones included, score the training sample's share of good
    documents; a null doc_id is scored like any other, and rows that repeat stay together; other columns are left alone."""
    model = quality.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = free(docs.columns, "_score")
    return quality.scored(docs, model, out=score).filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest doc_id stays, nulls last, and of rows that share it one. Texts without words are one
    group; a text of fewer words than a shingle is near to equal ones alone."""
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes. A null text stays null, and n_chars changes only with its text."""
    return secrets.redact(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source; a document without words weighs nothing, and is taken as often as its source's rate says; rows
    that share a doc_id (null ones, too) share its draw."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text has no ids; rows that repeat, as the mix makes them, repeat."""
    rows = bpe.encode_column(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return rows.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("neardup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The classifier, SimHash, entropy spans and BPE are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
