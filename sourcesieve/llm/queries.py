"""The queries opN_<name>, and the SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesieve.llm.shared import shared_dir, table, written

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The tokenizer file; a parameter of the operators, for the queries the public word-level one."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import token_files as op

    path = shared_dir(spark, "tokens")
    op.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=2)
    read = op.crc_column(op.read_tokens(spark, path))
    return op.with_start(spark, path, read).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import bpe as op

    return op.digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rows by turn, and conversation -7, which comes in the layout of prompt and completion."""
    from sourcesieve.llm import chat as op

    marked = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(marked).alias("prompt"), F.lit(marked).alias("completion"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    records = rows.unionByName(own, allowMissingColumns=True)
    formatted = written(op.format_turns(op.canonical_turns(records, "conv_id"), "conv_id"), "chat")
    return op.turn_digests(formatted, "conv_id")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import syncmers as op

    return op.report(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import mixing as op

    sizes = written(table(spark, sf_dir, "documents").select("doc_id", "source", op.words("text").alias("size")), "sizes")
    taken = op.with_copies(sizes, op.targets(sizes))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import secrets as op

    return op.digests(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import warc as op

    path = shared_dir(spark, "warc")
    op.write_archives(table(spark, sf_dir, "pages"), path)
    facts = op.payload_facts(op.read_archives(spark, path))
    return facts.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import simhash as op

    return op.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import quality as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op.fitted(docs, table(spark, sf_dir, "labels"))
    rows = op.scored(docs, model).withColumn("held_out", op.held_out(F.col("doc_id")))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= op.THRESHOLD).cast("int").alias("predicted"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sourcesieve.llm import media as op

    stored = written(op.store(table(spark, sf_dir, "documents")), "media", compression="uncompressed")
    return op.read_back(stored)


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_extract_all(role || chr(10) || text, '{control}') AS found FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + length(role) + length(text) + len(found)
    + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', '')))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM per),
ranked AS (
  SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0) AS words_left, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS shares_left
  FROM weighed WINDOW before AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, 3 * s * shares_left < words_left * w AS met FROM ranked),
aimed AS (
  SELECT source, s, CASE WHEN met OR s = 0 THEN (3 * s)::DOUBLE
    ELSE (sum(s) OVER () - sum(CASE WHEN met THEN 3 * s ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN met THEN 0 ELSE w END) OVER ())::DOUBLE * w::DOUBLE END AS target
  FROM filled),
rated AS (
  SELECT d.doc_id, d.size, a.s, a.target, CASE WHEN a.s > 0 THEN least(a.target / a.s::DOUBLE, 3.0::DOUBLE) ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS draw
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, s AS source_size, target, ((floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""

OP7_SQL = """
WITH hashed AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
digested AS (SELECT page_id, octet_length(data) AS payload_bytes, sha1(data) AS hex FROM hashed),
named AS (
  SELECT page_id, payload_bytes, array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)
      for i in range(32)], '') AS payload_digest
  FROM digested),
kept AS (SELECT payload_digest, max(page_id) AS keeper FROM named GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM named JOIN kept USING (payload_digest)
"""


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from sourcesieve.llm.chat import CONTROL, END, SEP, START

    control = "|".join(re.sub(r"([^\w/])", r"\\\1", c) for c in CONTROL)
    return {
        "op3_chat": OP3_SQL.replace("{control}", control).replace("{marks}", str(len(START + SEP + END) + 1)),
        "op5_mixing": OP5_SQL,
        "op7_warc": OP7_SQL,
    }
