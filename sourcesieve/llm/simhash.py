r"""SimHash near-duplicates: fingerprints, links between them, and components.

Fingerprint: over the word shingles of a text, with repeats, a bit is 1 if it is set in over half of their XXH64 hashes.

Links join fingerprints that differ in at most max_bits bits. Equal fingerprints become one node first. Tables of bit positions
propose candidates: nodes that agree in all bits of a table meet in a bucket. For few differing bits the tables are exact: bits fall
into blocks, and max_bits differences leave some blocks alone, so the tables of all choices of that many blocks miss no pair. For
more bits (longer fingerprints) tables are samples of bits; deduplicated() has MinHash bands and bits instead, whose recall is the
same for any number of nodes, and decides on the shingles themselves.

In a bucket, distances to pivots (reference fingerprints) are computed once per node; a pair whose distances to any pivot differ by
more than max_bits can't be a link and is discarded, and survivors are verified by their own distance. Pivots of 64-bit prints are
fixed. Distances of longer prints to any fixed one hardly differ by more than they may, so there pivots are members of the bucket
itself, spread over it. A bucket yields a spanning forest, not its pairs.

Buckets of over TILE nodes go to tasks in tiles, and each tile gets the same member of the bucket, its centre, too. Most nodes of a
group of copies are linked to the centre inside their tile already; the others, strays, go to every tile once more. So rows grow with the
nodes, and with strays times tiles, no task holds more than two tiles, and no link between parts of a bucket is lost.

Components come from rounds of large-star and small-star over written edge tables; a node's label is the smallest in reach. Hubs,
which stars make, stay where their edges are and get their neighbour by broadcast (fewer than HOT of them: shared.looked_up).

Edge cases: null and empty texts have no shingles and fingerprint zero, and are linked like any other; texts of fewer words than a
shingle have one, of all their words; a null key is never the smallest of a component, unless all are null; repeated rows are
rows of one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcesieve.llm.pieces import blocks
from sourcesieve.llm.shared import discard, free, looked_up, shared_dir, written

SEED = 42
PIVOTS = 16
TILE = 4096
SET_TILE = 1024
WIDTH = 8192
#: Bands of smallest hashes: a pair of likeness 0.8 agrees in a whole band with probability 1 - (1 - 0.8 ** 4) ** 24 = 0.999999.
BANDS, BAND = 24, 4
#: Fixed references, for up to 256 bits: words of a splitmix64 sequence.
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pivots(words: int, n: int = PIVOTS) -> np.ndarray:
    return mixed(np.arange(1, n * words + 1, dtype=np.uint64) * np.uint64(GOLDEN)).reshape(n, words)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z alone, and white space 09-0D and 20 alone
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: len(words) - k].tolist()]
    return np.fromiter([h(data[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64, count=len(starts))


def fingerprint(text: str | None, k: int = 4, bits: int = 64) -> np.ndarray:
    """bits / 64 unsigned words; words after the first are from further mixings of the same hashes."""
    hashes = shingle_hashes((text or "").encode(), k)
    out = np.zeros(bits // 64, dtype=np.uint64)
    for w in range(len(out) if len(hashes) else 0):
        own = mixed(hashes + np.uint64(w * GOLDEN & (1 << 64) - 1)) if w else hashes
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, len(own), 1 << 16):
            counts += np.unpackbits(own[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > len(own)).view(">u8")[0]
    return out


def least_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """MinHash: under each of n orders the smallest of a set of hashes; two sets agree in as many as their Jaccard likeness says."""
    a, b = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(GOLDEN)).reshape(2, n, 1)
    out = np.full(n, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(out, ((a | np.uint64(1)) * hashes[i : i + 1024] + b).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key of each band of BAND smallest hashes; keys of different bands differ."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least[: BANDS * BAND].reshape(BANDS, BAND).T:
        keys = mixed(keys * np.uint64(GOLDEN) ^ column)
    return keys


def with_prints(df: DataFrame, text: str = "text", k: int = 4, bits: int = 64, out: str = "print") -> DataFrame:
    """df with the binary column out: the fingerprint, most significant byte first; replaces a column of that name."""
    rest = df.drop(out)
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at):
            prints = [fingerprint(t, k, bits).astype(">u8").tobytes() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.binary())], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.BinaryType())]))


def bit_tables(n: int, bits: int, max_bits: int, samples: int = 32) -> list[list[int]]:
    """The bit positions of each candidate table, for n nodes.

    Exact for 64 bits and few differences: with b blocks, b - max_bits stay alone; more blocks, as n grows, make longer keys, so
    that a bucket holds a few unrelated nodes at any n. Else samples of log2(n) - 4 bits, so that a bucket holds some 16 unrelated
    nodes at any n; what a table misses others find.
    """
    if bits == 64 and max_bits <= 4:
        spare = max(1, math.ceil((math.log2(max(n, 2)) - 2) / 11))  # blocks that agree: 1 up to 2**13 nodes, then 2, 3, 4
        edges = np.linspace(0, 64, max_bits + min(spare, 4) + 1).astype(int)
        whole = [list(range(a, b)) for a, b in itertools.pairwise(edges.tolist())]
        return [sum(c, []) for c in itertools.combinations(whole, min(spare, 4))]
    width = min(bits // 4, max(10, math.ceil(math.log2(max(n, 2))) - 4))
    order = np.random.default_rng(SEED)
    return [sorted(order.choice(bits, width, replace=False).tolist()) for _ in range(samples)]


def words_of(prints: pa.Array) -> np.ndarray:
    data = b"".join(prints.to_pylist())
    return np.frombuffer(data, dtype=">u8").astype(np.uint64).reshape(len(prints), -1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def bucket_rows(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(bucket, print): each node once per table, under the bits that the table names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spread = np.unpackbits(words_of(batch.column(0)).astype(">u8").view(np.uint8).reshape(batch.num_rows, -1), axis=1)
            for i, table in enumerate(tables):
                # bits of one table as one number, the table's number above
                key = np.zeros(batch.num_rows, dtype=np.uint64)
                for b in table:
                    key = key << np.uint64(1) | spread[:, b].astype(np.uint64)
                key |= np.uint64(i << 56)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["bucket", "print"])

    return nodes.select("print").mapInArrow(run, "bucket long, print binary")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes, by edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(old, label):
            return label


def to_pivots(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Distances of each node to PIVOTS references: fixed ones, or for prints of over 64 bits members of its own group."""
    if words.shape[1] == 1 or not len(group):
        return np.stack([distance(words, p) for p in pivots(words.shape[1])], axis=1)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    return np.stack([distance(words, words[first + size * i // PIVOTS]) for i in range(PIVOTS)], axis=1)


def links_in(group: np.ndarray, words: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(node, root) edges of a spanning forest of the links inside equal groups, and how many pairs were verified.

    group is sorted. Pairs at each offset are taken together, so there is no work per bucket; nodes that are known to be linked
    aren't looked at again.
    """
    n = len(group)
    to_pivot = to_pivots(group, words)
    label = np.arange(n)
    left, right, waiting, verified = [], [], 0, 0

    def settle() -> None:
        nonlocal label, left, right, waiting
        if left:
            label = _forest(n, np.concatenate([*left, label]), np.concatenate([*right, np.arange(n)]))
            left, right, waiting = [], [], 0

    i = np.arange(n - 1)
    for step in range(1, n):
        i = i[i < n - step]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        pair = i[label[i] != label[i + step]]
        for c in range(to_pivot.shape[1]):
            near = np.abs(to_pivot[pair, c] - to_pivot[pair + step, c]) <= max_bits
            pair = pair[near]
            if np.count_nonzero(near) > 0.9 * len(near):
                break  # what is left is mostly near: verify
        verified += len(pair)
        pair = pair[distance(words[pair], words[pair + step]) <= max_bits]
        if len(pair):
            left.append(pair)
            right.append(pair + step)
            waiting += len(pair)
            if waiting > n // 4:
                settle()
    settle()
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own], verified


def links(nodes: DataFrame, max_bits: int, tables: list[list[int]], tile: int = TILE) -> DataFrame:
    """(a, b): edges between prints of nodes that connect all that are linked."""
    return links_of(written(bucket_rows(nodes, tables), "buckets"), max_bits, tile)


def links_of(rows: DataFrame, max_bits: int, tile: int = TILE) -> DataFrame:
    """(a, b): edges between prints of rows (bucket, print) that connect all that are linked inside a bucket. rows: a written table."""

    def find(group: np.ndarray, part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return links_in(group, words_of(part.column("print").combine_chunks()), max_bits)[:2]

    return joined_in_buckets(rows, "print", find, tile)


Find = Callable[[np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray]]


def met(rows: DataFrame, node: str, find: Find, held: int = 50_000) -> DataFrame:
    """(a, b, bucket): edges that find sees inside groups of rows (bucket, part, lead, node, ...), and (a, null, bucket) for the
    strays: nodes with lead 1 that no edges connect with the node in their group that has lead 0."""
    kind = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("bucket", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                kept = pa.concat_tables([kept, more]) if kept is not None else more
                if len(kept) < held and kept.nbytes < 32 << 20:
                    continue
            if kept is None or not len(kept):
                continue
            bucket, part = (kept.column(c).to_numpy() for c in ("bucket", "part"))
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]
            cut = len(kept) if batch is None else int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            if not cut:
                continue
            whole, group = kept.slice(0, cut), np.cumsum(new[:cut]) - 1
            names = whole.column(node).combine_chunks()
            a, b = find(group, whole)
            if len(a):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "bucket"])
            lead = whole.column("lead").to_numpy()
            if (lead < 2).any():
                label = _forest(cut, a, b) if len(a) else np.arange(cut)
                stray = np.flatnonzero((lead == 1) & (label != label[np.flatnonzero(new[:cut])[group]]))
                if len(stray):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(stray)), pa.nulls(len(stray), pa.binary()), pa.array(bucket[stray])], names=["a", "b", "bucket"])
            kept = kept.slice(cut)

    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "lead")
    return dealt.mapInArrow(run, kind)


def joined_in_buckets(rows: DataFrame, node: str, find: Find, tile: int) -> DataFrame:
    """(a, b): edges that connect, inside each bucket of rows (bucket long, node, ...), all that find would connect. rows: a written
    table."""
    others = [c for c in rows.columns if c != "bucket"]
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    large = written(sizes.select(F.col("bucket").alias("_bucket"), F.ceil(F.col("n") / tile).cast("long").alias("tiles")), "large-buckets")
    if large.isEmpty():
        few = rows.select("bucket", F.lit(-1).cast("long").alias("part"), F.lit(2).alias("lead"), *others)
        return met(few, node, find).select("a", "b").distinct()

    # first: each node in its own tile, and the centre in all tiles
    def own(tiles: str) -> Column:
        return F.pmod(F.xxhash64(node), F.col(tiles))

    picked = F.min(F.struct(F.xxhash64(node), F.col(node).alias("node")))["node"]
    inside = rows.join(large, F.col("bucket") == F.col("_bucket"), "left_semi").groupBy(F.col("bucket").alias("_bucket")).agg(picked.alias("centre"))
    total = rows.count()
    found = looked_up(rows, "bucket", written(large.join(inside, "_bucket"), "centres"), "_bucket", total)
    centre = F.col(node) == F.col("centre")
    parts = F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("long"))).when(centre, F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array(own("tiles")))
    lead = F.when(F.col("tiles").isNull(), 2).when(centre, 0).otherwise(1)
    first = written(met(found.select("bucket", F.explode(parts).alias("part"), lead.alias("lead"), *others), node, find), "first-edges")
    edges, strays = first.filter("b IS NOT NULL").select("a", "b"), first.filter("b IS NULL").select(F.col("bucket").alias("_bucket"), F.col("a").alias("_stray"))
    many = strays.groupBy("_bucket").agg(F.ceil(F.count("*") / tile).cast("long").alias("blocks")).join(large.select("_bucket", "tiles"), "_bucket")
    many = written(many, "strays-by-bucket")
    if many.isEmpty():
        return edges.distinct()
    # then: blocks of strays meet all tiles
    members = looked_up(rows, "bucket", many, "_bucket", total).filter("blocks IS NOT NULL").select(own("tiles").alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "bucket", *others)
    lone = rows.join(strays, (F.col("bucket") == F.col("_bucket")) & (F.col(node) == F.col("_stray")), "left_semi").join(many, F.col("bucket") == F.col("_bucket"))
    others_of = F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: t != own("tiles"))
    lone = lone.select(F.explode(others_of).alias("tile"), F.pmod(F.xxhash64(F.lit(1), node), F.col("blocks")).alias("block"), "bucket", *others)
    both = members.unionByName(lone).select("bucket", F.shiftleft("tile", 32).bitwiseOR(F.col("block")).alias("part"), F.lit(2).alias("lead"), *others)
    return edges.union(met(both, node, find).select("a", "b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node in reach of every node of the edges (a, b).

    Edges lead from a node to a smaller one, so a node's neighbours are those it leads to, and those that lead to it. Large star:
    larger neighbours of a node move to its smallest neighbour; so each edge a -> b becomes a -> the smallest that b leads to.
    Small star: a node and those it leads to move to the smallest of these.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, name)
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name, path)
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen, before = sums, path
        up = now.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        between = shared_dir(spark, name)
        large = written(looked_up(now, "b", up, "c", sums[0]).select("a", F.coalesce("m", "b").alias("b")), name, between)
        least = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        moved = looked_up(large, "a", least, "c", sums[0]).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        path = shared_dir(spark, name)
        now = written(moved.union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct(), name, path)
        for old in (before, between):
            discard(spark, old)


def labelled(docs: DataFrame, first: Column, bits: int, max_bits: int) -> DataFrame:
    """(print, label, first): of each distinct print the smallest print in reach, and the smallest value of first."""
    nodes = written(docs.groupBy("print").agg(F.min(first).alias("first")), "nodes")
    labels = components(links(nodes, max_bits, bit_tables(nodes.count(), bits, max_bits)))
    return nodes.join(labels, nodes["print"] == labels["node"], "left").select("print", "first", F.coalesce("label", "print").alias("label"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, bits: int = 64, max_bits: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): component_id is the smallest key that a row's links reach, its own included."""
    docs = written(with_prints(df.select(key, text), text, k, bits).select(F.col(key).alias("key"), "print"), "prints")
    named = written(labelled(docs, F.col("key"), bits, max_bits), "labels")
    smallest = written(named.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "_label"), "smallest")
    final = looked_up(named, "label", smallest, "_label", named.count()).select(F.col("print").alias("_print"), "component_id")
    final = looked_up(docs, "print", final, "_print", docs.count())
    return final.select(F.col("key").alias(key), F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def alike_in(group: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, inside equal groups, all sets whose Jaccard likeness is similarity or more; each edge is such a pair.

    group is sorted. How many members any two sets of a group share comes from products of 0/1 matrices, WIDTH members at a time;
    members of one set alone don't count. Work depends on how many sets and members there are, not on which are alike.
    """
    left, right = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
    for start, end in itertools.pairwise([*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), len(group)] if len(group) else []):
        n = end - start
        if n < 2:
            continue
        sizes = np.fromiter(map(len, sets[start:end]), dtype=np.int64, count=n)
        owner, member = np.repeat(np.arange(n), sizes), np.concatenate(sets[start:end])
        _, of, count = np.unique(member, return_inverse=True, return_counts=True)
        several = count > 1
        column = np.where(several, np.cumsum(several) - 1, -1)[of]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((n, n), dtype=np.float32)  # counts up to 2 ** 24 are exact
        for first in range(0, int(several.sum()), WIDTH):
            i, j = np.searchsorted(column, (first, first + WIDTH))
            block = np.zeros((n, min(WIDTH, int(several.sum()) - first)), dtype=np.float32)
            block[owner[i:j], column[i:j] - first] = 1
            shared += block @ block.T
        a, b = np.nonzero(np.triu((shared >= similarity * (sizes[:, None] + sizes - shared.astype(np.float64)) - 1e-9) & (shared > 0), 1))
        label = np.arange(n)
        while len(a):  # each component takes one edge that leads out of it
            some = np.union1d(*(np.unique(label[x], return_index=True)[1] for x in (a, b)))
            left.append(a[some] + start)
            right.append(b[some] + start)
            label = _forest(n, np.r_[a[some], label], np.r_[b[some], np.arange(n)])
            out = label[a] != label[b]
            a, b = a[out], b[out]
    return np.concatenate(left), np.concatenate(right)


def tile_pairs(rows: DataFrame, tile: int, node: str) -> DataFrame:
    """rows (bucket, ...) with part: large buckets as pairs of tiles; a node goes to the pairs that hold its tile. rows: a written table."""
    sizes = rows.groupBy("bucket").count().filter(F.col("count") > tile)
    large = written(sizes.select(F.col("bucket").alias("_bucket"), F.ceil(2 * F.col("count") / tile).cast("long").alias("tiles")), "large-buckets")
    found = looked_up(rows, "bucket", large, "_bucket", rows.count())
    own = F.pmod(F.xxhash64(node), F.col("tiles"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.shiftleft(F.least(own, j), 32).bitwiseOR(F.greatest(own, j)))
    return found.select(*rows.columns, F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(parts)).alias("part"))


def alike(rows: DataFrame, text: str, k: int, similarity: float, tile: int = SET_TILE) -> DataFrame:
    """(a, b): edges between the sets of rows (bucket, set, text) that connect all that are alike inside a bucket. rows: a written
    table. Large buckets go out as pairs of tiles: a loose group is mostly of nodes that are not alike, so no centre would do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, names, sets, size, last, number = [], [], [], 0, None, 0

        def edges() -> Iterator[pa.RecordBatch]:
            a, b = alike_in(np.array(groups), sets, similarity)
            if len(a):
                own = pa.array(names, pa.binary())
                yield pa.RecordBatch.from_arrays([own.take(pa.array(a)), own.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            for bucket, part, name, words in zip(*(batch.column(c) for c in range(4)), strict=True):
                if (here := (bucket.as_py(), part.as_py())) != last:
                    if size > 1 << 21:
                        yield from edges()
                        groups, names, sets, size = [], [], [], 0
                    last, number = here, number + 1
                groups.append(number)
                names.append(name.as_py())
                sets.append(np.unique(shingle_hashes((words.as_py() or "").encode(), k)))
                size += len(sets[-1])
        if sets:
            yield from edges()

    dealt = tile_pairs(rows, tile, "set").select("bucket", "part", "set", text).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def texts_at(wanted: DataFrame, text: str) -> DataFrame:
    """wanted (bucket, set, _file, _row) with the text of each row of a written table: read file by file, no other text moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, part, base = None, iter(()), None, 0
        for batch in batches:
            files, rows = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            i = 0
            while i < len(rows):
                if files[i] != at:
                    at = files[i]
                    store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", at))
                    parts, part, base = pq.ParquetFile(store.open_input_file(inner)).iter_batches(1024, columns=[text]), None, 0
                while part is None or rows[i] >= base + part.num_rows:
                    base += part.num_rows if part is not None else 0
                    part = next(parts)
                j = i
                while j < len(rows) and files[j] == at and rows[j] < base + part.num_rows:
                    j += 1
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), part.column(0).take(pa.array(rows[i:j] - base))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "set", text])
                i = j

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField(text, T.StringType())])
    return wanted.select("bucket", "set", "_file", "_row").repartition("_file").sortWithinPartitions("_file", "_row").mapInArrow(run, schema)


def with_sketches(df: DataFrame, text: str, k: int, bits: int, names: tuple[str, str, str] = ("set", "print", "bands")) -> DataFrame:
    """df with columns, under names that it doesn't have, of the set of a text's shingles: its digest; a bit of each of its smallest
    hashes under bits orders; and the keys under which likely near-copies meet."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at):
            sets, prints, bands = [], [], []
            for t in batch.column(at).to_pylist():
                hashes = np.unique(shingle_hashes((t or "").encode(), k))
                least = least_hashes(hashes, max(bits, BANDS * BAND))
                sets.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
                prints.append(np.packbits((mixed(least[:bits]) >> np.uint64(63)).astype(np.uint8)).tobytes())
                bands.append(band_keys(least).view(np.int64))
            columns = [*batch.columns, pa.array(sets, pa.binary()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    added = [T.StructField(n, t) for n, t in zip(names, (T.BinaryType(), T.BinaryType(), T.ArrayType(T.LongType())), strict=True)]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, bits: int = 256, max_bits: int = 48, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-copies, the one with the smallest key (nulls last), with the columns of df.

    Near-copies share similarity of their shingles: Jaccard likeness of the sets, repeats counting once. Texts of equal sets become
    one node. Loose groups hold all that may be near: nodes meet in bands of smallest hashes, whether they do doesn't depend on how
    many there are, and are linked if at most max_bits of the bits of their smallest hashes differ (0.1 of them at likeness 0.8 on
    average, 25.6 give or take 4.8 of 256). Inside loose groups, shingles themselves decide.
    """
    names = tuple(free(df.columns, n) for n in ("_set", "_print", "_bands"))
    rows = written(with_sketches(df, text, k, bits, names), "printed")
    place = rows.metadataColumn("_metadata")
    docs = rows.select(F.col(f"`{key}`").alias("key"), *[F.col(n).alias(m) for n, m in zip(names, ("set", "print", "bands"), strict=True)], place["file_path"].alias("_file"), place["row_index"].alias("_row"))
    first = F.struct(F.col("key").isNull().alias("none"), "key", "_file", "_row")
    nodes = docs.groupBy("set").agg(F.min(first).alias("first"), F.first("print").alias("print"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    total = nodes.count()
    bands = written(nodes.select(F.explode("bands").alias("bucket"), "print").distinct(), "bands")
    loose = written(components(links_of(bands, max_bits), "loose"), "loose-labels")
    loose = looked_up(nodes.select("set", "first", "print"), "print", loose, "node", total)
    loose = written(loose.select("set", "first", F.xxhash64(F.coalesce("label", "print")).alias("bucket")), "loose-groups")
    several = loose.groupBy(F.col("bucket").alias("_bucket")).agg(F.count("*").alias("n")).filter("n > 1")
    unsure = looked_up(loose, "bucket", several, "_bucket", total).filter("n > 1").select("bucket", "set", "first._file", "first._row")
    same = components(alike(written(texts_at(unsure, text), "unsure-texts"), text, k, similarity), "same")
    named = nodes.join(same, nodes["set"] == same["node"], "left").select("first", F.coalesce("label", "set").alias("label"))
    keepers = named.groupBy("label").agg(F.min("first").alias("first")).select("first._file", "first._row")
    kept = rows.join(keepers, (place["file_path"] == keepers["_file"]) & (place["row_index"] == keepers["_row"]), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
