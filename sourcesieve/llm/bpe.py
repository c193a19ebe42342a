"""BPE encoding and decoding for word-end vocabularies (``</w>``), without the tokenizers library.

Words go through merge rounds together: the symbols of many words stand in one flat numpy array, every neighbouring pair
becomes one integer key, a binary search over the sorted keys of the vocabulary's merges gives the ranks, and each round
merges the lowest rank of every word at once.

Edge cases: null and empty texts encode to no ids and decode to ""; a word of any length is one run of symbols; added
tokens inside a text (``<|endoftext|>``) become their own id, as the library does; a null id list decodes to "".
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourcesieve.llm.pieces import PieceTable, blocks, one_table

# The White_Space property, and the words of the pre-tokenizer.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
NO_RANK = np.iinfo(np.int64).max
#: Bytes of text at a time.
BLOCK = 4_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe(PieceTable):
    """Encoder and decoder for a tokenizer file. No word, added token or normal form crosses white space, so pieces encode alone."""

    def __init__(self, path: str, size: int = 12_000_000):
        super().__init__(size)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        span = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * span
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[w] for w in words], dtype=np.int64) for words in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        keys = left * span + right
        order = np.argsort(keys, kind="stable")
        self.span, self.keys, self.ranks, self.made = span, keys[order], order.astype(np.int64), made[order]
        # where two merges make the same token, a round could overtake a lower rank: then one merge per word and round
        self.single = len(np.unique(made)) < len(made)
        self.token_array = pa.array(self.tokens, pa.string())
        self.decimal_array = pa.array([str(i) for i in range(span)], pa.string())
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each word has. Words must not be empty."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        of = np.repeat(np.arange(n), lengths)
        rank, at = self._rank(symbols[:-1], symbols[1:], of[:-1] == of[1:])
        rank, at = np.r_[rank, NO_RANK], np.r_[at, 0]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            counts = np.diff(np.r_[starts, len(of)])
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < NO_RANK
            if not going.all():
                keep = np.repeat(going, counts)
                done.append((of[~keep], symbols[~keep]))
                if not going.any():
                    break
                symbols, of, rank, at, lowest, counts = symbols[keep], of[keep], rank[keep], at[keep], lowest[going], counts[going]
            merged = np.flatnonzero(rank == np.repeat(lowest, counts))
            if self.single:
                merged = merged[np.r_[True, of[merged[1:]] != of[merged[:-1]]]]
            else:  # in a run of the same symbol, every other pair
                first = np.r_[True, merged[1:] != merged[:-1] + 1]
                since = np.arange(len(merged))
                merged = merged[(since - np.maximum.accumulate(np.where(first, since, 0))) % 2 == 0]
            symbols[merged] = self.made[at[merged]]
            left = np.ones(len(symbols), dtype=bool)
            left[merged + 1] = False
            symbols, of, rank, at = symbols[left], of[left], rank[left], at[left]
            new = merged - np.arange(len(merged))  # where the merged symbols stand now: only their pairs change
            changed = np.zeros(len(symbols), dtype=bool)
            changed[new] = changed[new[new > 0] - 1] = True
            changed[-1] = False
            touched = np.flatnonzero(changed)
            rank[-1] = NO_RANK
            rank[touched], at[touched] = self._rank(symbols[touched], symbols[touched + 1], of[touched] == of[touched + 1])
        of, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)

    def _rank(self, left: np.ndarray, right: np.ndarray, same_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, and where it stands among the sorted keys."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & same_word, self.ranks[at], NO_RANK), at

    def _words(self, piece: bytes) -> list[bytes]:
        if piece.isalpha():  # of ASCII letters alone
            return [piece.lower()]
        if piece.isascii():
            return [w.encode() for w in WORD.findall(piece.lower().decode())]
        plain = unicodedata.normalize("NFC", piece.decode()).replace("Σ", "σ").lower()
        return [w.encode() for w in WORD.findall(plain)]

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        flat: list[bytes] = []
        counts: list[int] = []  # of words, by piece
        odd: dict[int, list[int]] = {}  # pieces with added tokens: counts of words, and ids of added tokens as -1 - id
        for i, piece in enumerate(missing):
            if b"<" in piece and self.split_added and self.split_added.search(piece.decode()):
                odd[i] = []
                for part in filter(None, self.split_added.split(piece.decode())):
                    words = [] if part in self.added else self._words(part.encode())
                    odd[i].append(-1 - self.added[part] if part in self.added else len(words))
                    flat += words
                counts.append(sum(n for n in odd[i] if n > 0))
            else:
                words = self._words(piece)
                flat += words
                counts.append(len(words))
        ids, sizes = self.merge(flat) if flat else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        data = ids.astype("<u4").tobytes()
        ends = np.r_[0, np.cumsum(sizes)] * 4
        words_before = np.r_[0, np.cumsum(counts)].astype(np.int64)
        edges = ends[words_before].tolist()
        known = [data[a:b] for a, b in pairwise(edges)]
        for i, parts in odd.items():
            word, out = words_before[i], b""
            for part in parts:
                if part < 0:
                    out += np.uint32(-1 - part).tobytes()
                else:
                    out += data[ends[word] : ends[word + part]]
                    word += part
            known[i] = out
        return known

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        edges, ids = self.ids(pa.array(texts, pa.string()))
        return np.split(ids, edges[1:-1]) if len(edges) > 1 else []

    def joined(self, edges: np.ndarray, ids: np.ndarray, names: pa.Array) -> list[bytes]:
        """For each run of ids between edges, the names of its ids, joined by single spaces."""
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), names.take(pa.array(ids)))
        return pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()

    def decode(self, ids: Iterable[int] | None) -> str:
        """The file names no decoder, so tokens are joined by single spaces, as the library's decode does; other ids are skipped."""
        tokens = self.tokens
        return " ".join([t for i in (() if ids is None else ids) if 0 <= i < len(tokens) and (t := tokens[i])])


def tokenizer(path: str) -> WordBpe:
    return one_table(WordBpe, path)


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with the array column out of token ids; replaces a column of that name."""
    rest = df.drop(out)
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in blocks(batches, at, BLOCK):
            edges, ids = bpe.ids(batch.column(at))
            column = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the string column out, decoded from the array column ids; replaces a column of that name."""
    rest = df.drop(out)
    at = rest.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = pa.array([bpe.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())]))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and the SHA-256 of the decimal ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in blocks(batches, most=BLOCK):
            edges, ids = bpe.ids(batch.column(1))
            sums = [pa.array([hashlib.sha256(x).hexdigest() for x in bpe.joined(edges, ids, names)], pa.string()) for names in (bpe.decimal_array, bpe.token_array)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges)), *sums], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
