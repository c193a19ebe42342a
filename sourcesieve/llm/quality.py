r"""Quality classifier: supervised subword embeddings.

Vectors of hashed n-grams are learned: of each piece (run without ASCII white space) and of the n-grams of its characters (code
points, its edges marked), whose average stands for the piece; and for each two pieces that follow each other, of the pair as a
word bigram, and of the character n-grams across the white space between them (one and two characters of each). A document is the
average of all these, and softmax over two outputs gives its score. Vectors and outputs are learned together by stochastic gradient
descent in numpy, on the driver.

Training reads a bounded sample of labelled rows: SAMPLE_ROWS rows of the training folds with the smallest hashes of their keys, in
whose order texts are taken as long as they fit into SAMPLE_BYTES together; its tables of sample keys and sizes have that bound, too.
The model is 2 x BUCKETS x DIM numbers. Scoring reads every whole text and shuffles nothing; as outputs are linear, a vector's
product with them is taken once for each bucket.

Edge cases: texts without pieces (null, empty, white space) score the sample's share of label 1; a null key is in no held-out fold
and has no label; without any labelled row, or with one class only, every score is that share (1 without rows), within a
millionth; keys that repeat are each scored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import mmap
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcesieve.llm.pieces import PieceTable, blocks, gather, one_table, raw, split
from sourcesieve.llm.shared import written

BUCKETS, DIM = 1 << 16, 8  # as many buckets again for word bigrams
NGRAMS = (1, 2, 3)
BESIDE = 3  # n-grams of two neighbours
FOLDS = 5
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 24_000_000
EPOCHS, RATE, BATCH = 12, 0.4, 32
SEED = 7
THRESHOLD = 0.3
PART = 1 << 18


class Grams(PieceTable):
    """Of each piece, as unsigned 32-bit numbers: hashes of all of it, of its first and last character, and of its first and last
    two; then the bucket of the piece, and those of its n-grams."""

    def learn(self, missing: list[bytes]) -> list[bytes]:
        size = np.cumsum(np.fromiter(map(len, missing), dtype=np.int64, count=len(missing)))
        cuts = np.flatnonzero(np.diff(size // GRAMS_BYTES)) + 1
        return [x for a, b in itertools.pairwise([0, *cuts.tolist(), len(missing)]) if a < b for x in self._grams(missing[a:b])]

    def _grams(self, pieces: list[bytes]) -> Iterator[bytes]:
        flat = np.frombuffer(b"<" + b"><".join(pieces) + b">", dtype=np.uint8)
        begins = np.flatnonzero((flat & 0xC0) != 0x80)  # of characters
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 2
        first = np.searchsorted(begins, np.cumsum(sizes) - sizes)
        n = np.diff(np.r_[first, len(begins)])
        own = np.repeat(np.arange(len(pieces)), n)
        inside = np.arange(len(begins)) - first[own]
        begins = np.r_[begins, len(flat)]
        lengths = HEADS + 1 + sum(n - k + 1 for k in NGRAMS)  # a marked piece has three characters or more
        place = np.cumsum(lengths) - lengths
        edges = [*(place * 4).tolist(), int(lengths.sum()) * 4]
        out = np.empty(lengths.sum(), dtype="<u4")
        whole = np.fromiter(map(zlib.crc32, pieces), dtype=np.uint32, count=len(pieces))
        out[place] = whole
        for head, (i, j) in enumerate([(1, 2), (n - 2, n - 1), (1, np.minimum(3, n - 1)), (np.maximum(1, n - 3), n - 1)], 1):
            out[place + head] = crc32_of(flat, begins[first + i], begins[first + j])
        out[place + HEADS] = whole % BUCKETS
        place = place + HEADS + 1
        for k in NGRAMS:  # of a long run without white space, every n-gram counts, too
            at = np.flatnonzero(inside <= n[own] - k)
            out[place[own[at]] + inside[at]] = crc32_of(flat, begins[at], begins[at + k]) % BUCKETS
            place = place + n - k + 1
        data = out.tobytes()
        return (data[a:b] for a, b in itertools.pairwise(edges))


HEADS = 5
GRAMS_BYTES = 1_000_000
#: Bytes of the driver's table of pieces.
TRAIN_TABLE = 4_000_000


def crc32_steps() -> np.ndarray:
    """What each byte does to the state of CRC-32 (polynomial 0xEDB88320)."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


STEPS = crc32_steps()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each of the short runs of bytes from starts to ends."""
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    sizes = ends - starts
    for step in range(int(sizes.max(initial=0))):
        on = slice(None) if step < sizes.min() else np.flatnonzero(sizes > step)
        state[on] = STEPS[(state[on] ^ data[starts[on] + step]) & 0xFF] ^ state[on] >> np.uint32(8)
    return state ^ np.uint32(0xFFFFFFFF)


@dataclass
class Model:
    vectors: np.ndarray  # 2 * BUCKETS x DIM
    output: np.ndarray  # DIM + 1: difference of the two softmax rows, and of their biases
    prior: float  # share of label 1 in the sample, for documents without pieces

    def score(self, documents: np.ndarray) -> np.ndarray:
        return logistic(documents @ self.output[:-1] + self.output[-1])

    @cached_property
    def products(self) -> np.ndarray:
        """Of each bucket's vector with the outputs."""
        return self.vectors.astype(np.float64) @ self.output[:-1]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Pieces:
    """Of some texts: where the pieces of each begin, and the code of each piece; of each code its heads, how many buckets, and all."""

    edges: np.ndarray
    codes: np.ndarray
    heads: np.ndarray
    lengths: np.ndarray
    buckets: np.ndarray

    def beside(self, a: int, b: int) -> np.ndarray:
        """The BESIDE buckets (rows) of each piece from a to b with the piece after it."""
        left, right = self.heads[self.codes[a:b]].astype(np.uint64), self.heads[self.codes[a + 1 : b + 1]].astype(np.uint64)
        mixed = lambda x, y, k: ((x * np.uint64(0x9E3779B97F4A7C15) + y * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(40)).astype(np.int64) % BUCKETS
        return np.stack([BUCKETS + mixed(left[:, 0], right[:, 0], 1), mixed(left[:, 2], right[:, 1], 2), mixed(left[:, 4], right[:, 3], 3)])


def pieces_of(texts: pa.Array, table: Grams) -> Pieces:
    edges, codes, distinct = split(texts)
    data = table.lookup(raw(distinct))
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
    flat = np.frombuffer(b"".join(data), dtype="<u4")
    starts = np.cumsum(sizes) - sizes
    heads = flat[starts[:, None] + np.arange(HEADS)] if len(data) else np.zeros((0, HEADS), dtype="<u4")
    own = np.ones(len(flat), dtype=bool)
    own[(starts[:, None] + np.arange(HEADS)).ravel()] = False
    return Pieces(edges, codes, heads, sizes - HEADS, flat[own])


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sum of values (rows) between edges; zero where there are none."""
    out = np.zeros((len(edges) - 1, *values.shape[1:]), dtype=values.dtype)
    some = np.flatnonzero(edges[1:] > edges[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, edges[some], axis=0)
    return out


def scores(model: Model, texts: pa.Array, table: Grams) -> np.ndarray:
    """A bounded part of all pieces at a time."""
    p = pieces_of(texts, table)
    value, ends = np.empty(len(p.lengths)), np.r_[0, np.cumsum(p.lengths)]
    for i in range(0, len(p.lengths), 50_000):
        j = min(i + 50_000, len(p.lengths))
        value[i:j] = sums(model.products[p.buckets[ends[i] : ends[j]]], ends[i : j + 1] - ends[i]) / p.lengths[i:j]
    n = np.diff(p.edges)
    total = np.zeros(len(n))
    last = np.zeros(len(p.codes), dtype=bool)
    last[p.edges[1:][n > 0] - 1] = True
    owner = np.repeat(np.arange(len(n)), n)
    for i in range(0, len(p.codes), PART):
        j = min(i + PART, len(p.codes))
        total += np.bincount(owner[i:j], value[p.codes[i:j]], minlength=len(n))
        j = min(j, len(p.codes) - 1)
        beside = model.products[p.beside(i, j)].sum(axis=0)
        beside[last[i:j]] = 0.0
        total += np.bincount(owner[i:j], beside, minlength=len(n))
    count = n + BESIDE * np.maximum(n - 1, 0)
    return np.where(n > 0, logistic(total / np.maximum(count, 1) + model.output[-1]), model.prior)


def bags_of(texts: pa.Array, table: Grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text as its buckets, and their shares."""
    p = pieces_of(texts, table)
    for a, b in itertools.pairwise(p.edges.tolist()):
        own = p.codes[a:b]
        n = len(own) + BESIDE * max(len(own) - 1, 0)
        of, _ = gather(own, p.lengths, p.buckets)
        beside = p.beside(a, max(b - 1, a)).ravel()
        weight = np.r_[np.repeat(1 / p.lengths[own], p.lengths[own]), np.ones(len(beside))] / max(n, 1)
        bag, place = np.unique(np.r_[of.astype(np.int64), beside], return_inverse=True)
        yield bag.astype(np.int32), np.bincount(place, weight, minlength=len(bag)).astype(np.float32)


def apart(x: np.ndarray) -> np.ndarray:
    """A copy in pages of its own, which go back to the system with it; what many small arrays took stays with the process."""
    out = np.frombuffer(mmap.mmap(-1, max(x.nbytes, 1)), dtype=x.dtype, count=len(x))
    out[:] = x
    return out


def held_bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags of all texts, as views of a few large arrays."""
    table, bags = Grams(TRAIN_TABLE), []
    for i in range(0, len(texts), 200):
        some = list(bags_of(pa.array(texts[i : i + 200], pa.string()), table))
        ends = np.cumsum([len(bag) for bag, _ in some])[:-1]
        both = (apart(np.concatenate(x)) for x in zip(*some, strict=True))
        bags += zip(*(np.split(x, ends) for x in both), strict=True)
    return bags


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Gradient steps on batches of documents in a seeded order; each class weighs the same."""
    share = float(labels.mean()) if len(labels) else 1.0
    random = np.random.default_rng(SEED)
    vectors = ((random.random((2 * BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM).astype(np.float32)
    output = np.r_[random.standard_normal(DIM) / DIM, 0.0]
    output[-1] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    model = Model(vectors, output, share)
    if not 0 < share < 1:
        return Model(vectors * 0, output, share)
    bags = held_bags(texts)  # once for all epochs
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    seen, seen_out = np.full(len(vectors), 1e-12, dtype=np.float32), np.full(DIM + 1, 1e-12)  # squared gradients so far: steps shrink by their root
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            of = np.concatenate([bags[j][0] for j in own])
            weight = np.concatenate([bags[j][1] for j in own])
            counts = np.array([len(bags[j][0]) for j in own])
            hidden = sums(vectors[of] * weight[:, None], np.r_[0, np.cumsum(counts)]).astype(np.float64)
            wrong = (model.score(hidden) - labels[own]) * balance[own] / len(own)
            # the gradient of a vector is the output's row, by the sum of its weights in documents that are wrong
            pull = np.bincount(of, weight * np.repeat(wrong, counts), minlength=len(vectors))
            moved = np.flatnonzero(pull)
            pull = pull[moved].astype(np.float32)
            seen[moved] += pull * pull
            vectors[moved] -= RATE * (pull / np.sqrt(seen[moved]))[:, None] * output[:-1].astype(np.float32)
            step = np.r_[wrong @ hidden, wrong.sum()]
            seen_out += step * step
            output -= RATE * step / np.sqrt(seen_out)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[list[str], np.ndarray]:
    """Texts and labels of the training sample: at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes reach the driver.

    A text that doesn't fit into what is left of SAMPLE_BYTES is passed over; of a key's several labels or texts the smallest counts.
    """
    order = (F.xxhash64("_key"), "_key")
    named = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(key)) & F.col(key).isNotNull())
    some = named.groupBy(F.col(key).alias("_key")).agg(F.min(F.col(label).cast("int")).alias("_label")).orderBy(*order).limit(SAMPLE_ROWS)
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = written(texts.join(F.broadcast(some), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")), "sample")
    sizes = found.select("_key", F.octet_length("_text").alias("_size"), F.row_number().over(Window.orderBy(*order)).alias("_place"))
    left, taken, passed_over = SAMPLE_BYTES, [-1], False
    for size, place in sizes.select("_size", "_place").orderBy("_place").collect():
        if size <= left:
            left -= size
            taken.append(place)
        else:
            passed_over = True
    if passed_over:
        found = found.join(F.broadcast(sizes.filter(F.col("_place").isin(taken)).select("_key")), "_key", "left_semi")
    rows = sorted(tuple(r) for r in found.select("_key", "_text", "_label").collect())
    return [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.float64)


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    model = train(*sample(docs, labels, key, text, label))
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score: how likely label 1 is, 0 to 1; replaces a column of that name."""
    rest = docs.drop(out)
    at = rest.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = one_table(Grams)
        for batch in blocks(batches, at):
            score = scores(shared.value, batch.column(at), table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())]))
