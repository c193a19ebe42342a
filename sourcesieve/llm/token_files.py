"""Token-id files: Parquet with one list column of ids, dictionary-encoded, next to narrow metadata columns.

Layout: part files hold ascending ranges of the key; inside a file rows ascend, too, and every column chunk has page
indexes, so a reader of a few documents or of metadata alone touches a few pages. ``shard`` is the file's place in the
order, ``shard_start`` counts the ids before a document inside its file. Only a table with one row per shard is needed to
turn that into positions in the whole stream. Files come from Spark's own Parquet writer and its commit protocol, so a
lost executor's work is redone and never half visible.

Edge cases: null and empty texts hold the end id alone; rows with a null key come first; equal keys keep all their rows, in
the order of a hash of their text; an empty table gives an empty file set; columns besides key and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sourcesieve.llm.pieces import PieceTable, blocks, one_table

#: For the writer: row groups of 32 MB, pages of 256 kB or 2,000 rows; ids stay dictionary-coded up to 4 MB of distinct ids.
LAYOUT = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(4 << 20), "compression": "zstd",
}
#: Words of ASCII letters and letters from U+00C0 to U+00FF, in UTF-8.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class LibraryPieces(PieceTable):
    """Ids of pieces as the tokenizers library gives them. Many pieces make one call. Words of letters alone are kept apart by
    spaces, as only a word's last id is one that ends words; others by an added token, at which the library itself cuts a text
    before anything else; a piece that holds such a token is encoded alone."""

    def __init__(self, path: str, size: int = 48_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(size)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = self.library.get_vocab()
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def words(self, some: list[bytes]) -> list[bytes] | None:
        """The ids of words of letters; None if the library doesn't end each with an id that ends words."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<i4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(some):
            return None
        data = ids.tobytes()
        return [data[a:b] for a, b in pairwise([0, *(ends * 4).tolist()])]

    def learn(self, missing: list[bytes]) -> list[bytes]:
        easy = [i for i, x in enumerate(missing) if LETTERS.fullmatch(x)]
        if easy and (found := self.words([missing[i] for i in easy])) is not None:
            rest = sorted({*range(len(missing))} - {*easy})
            known = dict(zip(easy, found, strict=True)) | (dict(zip(rest, self.others([missing[i] for i in rest]), strict=True)) if rest else {})
            return [known[i] for i in range(len(missing))]
        return self.others(missing)

    def others(self, missing: list[bytes]) -> list[bytes]:
        def encode(text: bytes) -> np.ndarray:
            return np.array(self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<i4")

        if not self.added:
            return [encode(x).tobytes() for x in missing]
        cut, cut_id = next(iter(self.added.items()))
        odd = {i for i, x in enumerate(missing) if b"<" in x and any(a.encode() in x for a in self.added)}
        known = [encode(x).tobytes() if i in odd else b"" for i, x in enumerate(missing)]
        plain = [i for i in range(len(missing)) if i not in odd]
        ids = encode(cut.encode().join(missing[i] for i in plain))
        at = np.flatnonzero(ids == cut_id)
        data = ids.tobytes()
        for i, a, b in zip(plain, (np.r_[0, at + 1] * 4).tolist(), (np.r_[at, len(ids)] * 4).tolist(), strict=False):  # without plain pieces there is an empty run
            known[i] = data[a:b]
        return known


def library(path: str) -> LibraryPieces:
    return one_table(LibraryPieces, path)


def write_tokens(df: DataFrame, to: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2) -> None:
    """Writes the ids of every text, with end_id after each, to the folder to, in ascending order of key."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard, before = library(tokenizer), TaskContext.get().partitionId(), 0
        for batch in blocks(batches):
            edges, ids = table.ids(batch.column(1))
            n = len(edges) - 1
            if end_id is not None:
                ids = np.insert(ids, edges[1:], np.int32(end_id))
                edges = edges + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, shard, dtype=np.int32)), pa.array(edges[:-1] + before), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))],
                names=[key, "shard", "shard_start", "n_tokens", "tokens"],
            )
            before += int(edges[-1])

    schema = T.StructType([T.StructField(key, kind), T.StructField("shard", T.IntegerType()), T.StructField("shard_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    order = [F.col(key), F.xxhash64(text)]
    rows = df.select(key, text).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, schema).write.options(**LAYOUT).parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All columns; Parquet reads those that are selected, and of a filtered key the pages that may hold it."""
    return spark.read.parquet(path)


def with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows, which keep shard and shard_start, with start: the number of ids before a row in the whole stream."""
    totals = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(before), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def crc_column(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a token table with ids_crc32: CRC-32 of the ids as little-endian unsigned 32-bit integers; without the ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(4)
            edges = tokens.offsets.to_numpy().astype(np.int64) * 4
            data = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), dtype="<i4").view(np.uint8))
            crc = [zlib.crc32(data[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=[key, "shard", "shard_start", "n_tokens", "ids_crc32"])

    return df.select(key, "shard", "shard_start", "n_tokens", "tokens").mapInArrow(run, f"{key} {kind}, shard int, shard_start long, n_tokens long, ids_crc32 long")
