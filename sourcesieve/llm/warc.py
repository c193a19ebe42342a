r"""WARC archives with revisit records.

Write: SHA-1 digests of the payloads are grouped (summed before the exchange), payloads that occur more than once are joined to
the record that keeps them, and every page becomes a response, or a revisit with fresh headers and no payload. Records are written
by Spark's text writer, whose line separator is the blank lines that end a record; so its commit protocol covers archives, too. A
record's id is made of its key, whether that is null, and its payload's digest.

Read: Spark deals archives out by their bytes, and tasks stream through them by Content-Length. A revisit gets its payload's facts
from the response that has its digest and the id it refers to.

Edge cases: null payloads are empty; of equal payloads the largest id is the response and rows that share it are responses, too; a
null id never is the largest, and where all are null all are responses; an id may repeat with other payloads, and rows that repeat
whole have equal records; ids and URLs may hold any text, control characters in headers are percent-coded; an empty table gives no
records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesieve.llm.shared import looked_up, written

RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: RFC 4648


def sha1_base32(data: Column) -> Column:
    """SHA-1 in base 32: 40 bits at a time through conv(), whose digits are then renamed."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolved(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """The rows with payload_bytes, digest and refers_to: the key of the response that a row revisits, else null."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    pages = pages.drop("payload_bytes", "digest", "refers_to", "_keeper", "_digest")  # these columns are made here
    rows = pages.withColumns({"payload_bytes": F.octet_length(data).cast("long"), "digest": sha1_base32(data)})
    heads = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(key).alias("_keeper"), F.count("*").alias("n"))
    kept = written(heads.filter("n > 1").select(F.col("digest").alias("_digest"), "_keeper"), "warc-keepers")  # now Spark knows its size
    found = rows.join(kept, (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") >= least), "left")
    return found.withColumn("refers_to", F.when(F.coalesce(F.col(key) != F.col("_keeper"), F.col("_keeper").isNotNull()), F.col("_keeper"))).drop("_digest", "_keeper")


def safe(value: Column) -> Column:
    """A header's value: percent signs, control characters and spaces as percent codes."""
    out = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("%"), F.lit("%25"))
    for c in (*range(0x21), 0x7F):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return out


def record_id(key: Column, digest: Column) -> Column:
    hexed = F.sha2(F.concat(digest, F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit(""))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, to: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """Writes one record per row into archives in the folder to."""
    rows = resolved(pages, key, payload, least)
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value, when=None: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) if when is None else F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col(key), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe(F.col(url)) if url in pages.columns else F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Key", safe(F.col(key)), F.col(key).isNotNull()),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("digest")), revisit),
        line("X-Refers-To-Key", safe(F.col("refers_to")), revisit),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload), F.lit(""))),
    )
    rows.select(record.alias("value")).write.option("lineSep", RECORD_END).text(to)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in an open archive."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (head := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = head.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        block = stream.read(n := int(headers["content-length"]))
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("an archive ends inside a record")
        yield headers, block


SCHEMA = "record_id string, record_type string, key string, url string, refers_to string, refers_to_id string, declared_digest string, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str, batch_rows: int = 2000, payload: bool = False) -> DataFrame:
    """Headers and payload facts of all records below path, and the payload itself if asked for. A task takes one archive at a time;
    how many archives it gets, their bytes decide (spark.sql.files.maxPartitionBytes)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lists files, reads none
    names = ["record_id", "record_type", "key", "url", "refers_to", "refers_to_id", "declared_digest", "payload_bytes", "payload_digest", "payload"][: 10 if payload else 9]
    kinds = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.binary()][: len(names)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                with store.open_input_stream(inner) as stream:
                    for h, block in records(Lines(stream)):
                        revisit = h["warc-type"] == "revisit"
                        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        row = (h["warc-record-id"], h["warc-type"], unquote(h["x-key"]) if "x-key" in h else None, unquote(h.get("warc-target-uri", "")), unquote(h["x-refers-to-key"]) if "x-refers-to-key" in h else None, h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:"), None if revisit else len(block), None if revisit else digest)
                        rows.append((*row, block) if payload else row)
                        held += len(block) if payload else 0
                        if len(rows) >= batch_rows or held > 32 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return files.mapInArrow(run, SCHEMA + (", payload binary" if payload else ""))


class Lines:
    """readline() and read() over a stream that only reads blocks."""

    def __init__(self, stream, block: int = 1 << 20):
        self.stream, self.block, self.data, self.at = stream, block, b"", 0

    def _more(self) -> bool:
        new = self.stream.read(self.block)
        self.data, self.at = self.data[self.at :] + new, 0
        return bool(new)

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.data) - 1
                break
        line, self.at = self.data[self.at : end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        parts = [self.data[self.at : self.at + n]]
        self.at += len(parts[0])
        got = len(parts[0])
        while got < n:
            new = self.stream.read(max(self.block, n - got))
            if not new:
                break
            parts.append(new[: n - got])
            if len(new) > n - got:
                self.data, self.at = new, n - got
            else:
                self.data, self.at = b"", 0
            got += len(parts[-1])
        return b"".join(parts)


def payload_facts(read: DataFrame) -> DataFrame:
    """Every record with the size and digest of its full payload; a revisit has them from the response with its digest and the id
    it refers to."""
    facts = read.select("record_id", "record_type", "key", "refers_to", "refers_to_id", "declared_digest", "payload_bytes", "payload_digest")
    facts = written(facts, "warc-headers")
    kept = facts.filter("record_type = 'response'")
    original = F.concat_ws(" ", "payload_digest", "record_id").alias("_original")
    # records of rows that repeat whole are equal: one of them
    responses = kept.select(original, F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).distinct()
    again = facts.filter("record_type = 'revisit'").withColumn("_wants", F.concat_ws(" ", "declared_digest", "refers_to_id"))
    found = looked_up(again, "_wants", responses, "_original", facts.count())
    found = found.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")})
    return kept.unionByName(found.drop("_wants", "_original", "_bytes", "_digest")).drop("declared_digest")
