"""Texts as codes of distinct pieces: the stretches between ASCII white space, told apart once for many texts.

Splitting and telling apart run in Arrow; Python sees each distinct piece of a block once. A block holds about BLOCK bytes
of text, and a single longer text is a block of its own.

Tables of ids are for vocabularies that lower texts and cut them between letters or digits and ASCII marks: there pieces that
differ in ASCII case or in the marks after them share what is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 8_000_000
#: Longer pieces aren't kept.
LONGEST = 256
#: About what an entry of a table takes beside the bytes of its piece and of what is known of it.
ENTRY = 160
#: What may be cut off a piece's end. An apostrophe may begin a suffix, and added tokens begin with "<".
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "'<")
ALNUM = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most bytes of the column at position text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most)))
            yield batch.slice(start, stop - start)
            start = stop


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's pieces begin (one more at the end), the code of each piece, and the distinct pieces."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    edges = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
    edges, codes = edges - edges[0], flat.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(flat.dictionary, "").as_py()  # before and after white space at the ends of a text
    if empty >= 0:
        kept = codes != empty
        codes, edges = codes[kept], np.r_[0, np.cumsum(kept)][edges]
    return edges, codes, flat.dictionary


def raw(distinct: pa.Array) -> list[bytes]:
    """The strings as bytes, without a Python string for each."""
    _, offsets, data = distinct.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].tolist() if len(distinct) else []
    held = data.to_pybytes() if data is not None else b""
    return [held[a:b] for a, b in pairwise(edges)]


def gather(codes: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that codes name, one after another, and where each ends. lengths: of all runs in flat, in order."""
    own = lengths[codes]
    ends = np.cumsum(own)
    start = np.cumsum(lengths) - lengths
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[codes] - (ends - own), own)], ends


def units(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pieces as runs of units: the code of each unit, how many units each piece has, and the distinct units.

    Marks at the end of a piece become a unit of their own after an ASCII letter or digit, or a letter from U+00C0 to U+00FF;
    ASCII units are lowered. Pieces with "<" stay as they are.
    """
    n = len(distinct)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), distinct
    _, offsets, data = distinct.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)[distinct.offset : distinct.offset + n + 1]
    held = np.r_[np.zeros(2, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8)] if data is not None else np.zeros(2, dtype=np.uint8)
    size = pc.binary_length(pc.ascii_rtrim(distinct, characters=MARKS)).to_numpy()
    cut = edges[:-1] + size
    last, before = held[cut + 1], held[cut]
    letter = ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))  # neither the sign of times nor of division
    two = (size > 0) & (cut < edges[1:]) & letter & ~pc.match_substring(distinct, "<").to_numpy(zero_copy_only=False)
    counts = 1 + two.astype(np.int64)
    at = np.r_[0, np.cumsum(counts)]
    bounds = np.empty(at[-1] + 1, dtype=np.int32)
    bounds[at] = edges
    bounds[at[1:][two] - 1] = cut[two]
    parts = pa.StringArray.from_buffers(int(at[-1]), pa.py_buffer(bounds), data)
    lowered = pc.and_not(pc.string_is_ascii(parts), pc.match_substring(parts, "<"))
    flat = pc.if_else(lowered, pc.ascii_lower(parts), parts).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), counts, flat.dictionary


class PieceTable:
    """What is known of pieces of up to LONGEST bytes, in two generations of about size bytes at most: what the older one no longer gets
    asked for goes."""

    def __init__(self, size: int = 24_000_000):
        self.size = size
        self.held = 0
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _keep(self, word: bytes, x: bytes) -> None:
        self.held += len(word) + len(x) + ENTRY
        if self.held > self.size:
            self.new, self.old = {}, self.new
            self.held = len(word) + len(x) + ENTRY
        self.new[word] = x

    def learn(self, missing: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def lookup(self, wanted: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, wanted))
        absent = [i for i, x in enumerate(found) if x is None]
        missing = []
        for i in absent:
            found[i] = x = self.old.get(wanted[i])
            if x is None:
                missing.append(i)
            else:
                self._keep(wanted[i], x)
        for j in range(0, len(missing), 20_000):
            part = missing[j : j + 20_000]
            words = [wanted[i] for i in part]
            for i, word, x in zip(part, words, self.learn(words), strict=True):
                found[i] = x
                if len(word) <= LONGEST:
                    self._keep(word, x)
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (one more at the end), and all ids as 32-bit integers."""
        edges, codes, distinct = split(texts)
        unit_codes, counts, known = units(distinct)
        data = self.lookup(raw(known))
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        by_piece, unit_ends = gather(unit_codes, lengths, np.frombuffer(b"".join(data), dtype="<i4"))
        ids, ends = gather(codes, np.diff(np.r_[0, unit_ends[np.cumsum(counts) - 1]]), by_piece)
        return np.r_[0, ends][edges], ids


_HELD: dict[tuple, PieceTable] = {}


def one_table[Table: PieceTable](make: Callable[..., Table], *given: str) -> Table:
    """make(*given), kept for the next task of this worker. Workers outlive stages, so a table of another kind goes."""
    key = (make, *given)
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make(*given)
    return _HELD[key]
