import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sourcesieve.llm import simhash


def plain_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, prints, max_bits=4):
    label = list(range(len(keys)))
    for _ in keys:
        for a in range(len(keys)):
            near = [b for b in range(len(keys)) if (prints[a] ^ prints[b]).bit_count() <= max_bits]
            low = min(label[b] for b in near)
            for b in near:
                label[b] = low
    return {k: min((keys[j] for j in range(len(keys)) if label[j] == label[i] and keys[j] is not None), default=None) for i, k in enumerate(keys)}


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "A b C d É", "x " * 500, "w1 w2\tw3\x0bw4 w5 w6　w7", None])
def test_fingerprint(text):
    assert int(simhash.fingerprint(text)[0]) == plain_print(text)


def texts():
    rng = random.Random(3)
    out = []
    for i in range(25):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 6)):
            out.append(" ".join(words))
            words[rng.randrange(len(words))] = f"n{rng.randrange(500)}"
    return [None, "", "", " ", *out]


def test_components(spark):
    keys = list(range(100, 100 + len(texts())))
    data = list(zip(keys, texts())) + [(None, texts()[6]), (None, "only null ids here"), (keys[7], texts()[7])]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in data], "doc_id long, text string, print string, label int")
    got = simhash.near_duplicates(df.repartition(5)).collect()
    prints = [plain_print(t) for _, t in data]
    want = plain_components([k for k, _ in data], prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got if r.doc_id is not None) == sorted((str(k), f"{p:016x}", str(want[k])) for (k, _), p in zip(data, prints) if k is not None)
    nulls = {r.fingerprint: r.component_id for r in got if r.doc_id is None}
    assert nulls[f"{prints[-2]:016x}"] is None and nulls[f"{prints[-3]:016x}"] is not None
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [10, 10_000, 10**7, 10**10])
def test_exact_tables_miss_no_pair(n):
    tables = simhash.bit_tables(n, 64, 4)
    rng = random.Random(n)
    for _ in range(500):
        changed = set(rng.sample(range(64), 4))
        assert any(not changed & set(t) for t in tables)


def test_tiles_lose_no_link(spark):
    """A chain through a dense group, in buckets far larger than a tile."""
    rng = random.Random(5)
    values = [rng.getrandbits(64)]
    while len(values) < 300:
        new = rng.choice(values) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        values += [new] if new not in values else []
    values += [rng.getrandbits(64) for _ in range(40)]  # and strays
    for _ in range(100):
        new = values[rng.randrange(300, len(values))] ^ (1 << rng.randrange(64))
        values += [new] if new not in values else []
    nodes = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in values], "print binary")
    # one bucket for all, as no bit is looked at, and the tables of the query
    for tables in ([[]], simhash.bit_tables(300, 64, 4)):
        edges = simhash.links(nodes, 4, tables, tile=16)
        labels = {bytes(r.node): bytes(r.label) for r in simhash.components(edges).collect()}
        want = plain_components(values, values)
        assert {v: int.from_bytes(labels.get(v.to_bytes(8, "big"), v.to_bytes(8, "big"))) for v in values} == want
        assert all(len(e) == 2 and (int.from_bytes(e.a) ^ int.from_bytes(e.b)).bit_count() <= 64 for e in edges.collect())


def test_rows_of_a_dense_bucket_grow_with_its_nodes(spark):
    """All are linked to the centre in their tiles: a tile more is a row more, not a copy of the bucket."""
    nodes = spark.range(4000).select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("print"))
    shared = simhash.written(simhash.bucket_rows(nodes, [[]]), "dense")
    plan = []
    whole = simhash.met
    try:
        simhash.met = lambda rows, *a: (plan.append(rows.count()), whole(rows, *a))[1]
        simhash.joined_in_buckets(shared, "print", lambda group, part: simhash.links_in(group, simhash.words_of(part.column("print").combine_chunks()), 12)[:2], 100).count()
    finally:
        simhash.met = whole
    assert plan == [4000 + 40 - 1]


def test_hubs_stay_where_they_are(spark):
    """Stars of thousands, linked in a chain: one component, and lookups give what a join does."""
    name = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    edges = spark.range(6000).select(name(F.col("id") + 100).alias("a"), name(F.col("id") % 3).alias("b"))
    edges = edges.union(spark.range(1, 3).select(name(F.col("id")).alias("a"), name(F.col("id") - 1).alias("b")))
    labels = simhash.components(edges)
    assert labels.count() == 6003 and {bytes(r.label) for r in labels.select("label").distinct().collect()} == {bytes(8)}


def test_pivots_discard_pairs_of_long_prints():
    """Members of the bucket as pivots tell groups of copies apart: what is verified are near pairs."""
    rng = np.random.default_rng(1)
    near = lambda base, n: base ^ (np.uint64(1) << rng.integers(0, 64, (n, 4)).astype(np.uint64))
    new = lambda: rng.integers(0, 1 << 63, 4).astype(np.uint64)
    buckets = [np.concatenate([near(new(), 6), near(new(), 6)]) for _ in range(50)] + [np.concatenate([near(new(), 100) for _ in range(4)])]
    words, group = np.concatenate(buckets), np.repeat(np.arange(51), [*[12] * 50, 400])
    a, b, verified = simhash.links_in(group, words, 48)
    label = simhash._forest(len(group), a, b)
    assert len(set(label.tolist())) == 104
    near, others = 50 * 2 * 15 + 4 * 100 * 99 / 2, 50 * 36 + 6 * 100 * 100
    assert verified < near + 0.2 * others


def test_looked_up_equals_a_left_join(spark):
    from sourcesieve.llm.shared import looked_up

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(-1, None)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "at string, v int")
    for total in (3001, 10**9):
        got = looked_up(rows, "k", table, "at", total)
        assert sorted(map(repr, got.select("i", "v").collect())) == sorted(map(repr, rows.join(table, rows.k == table.at, "left").select("i", "v").collect()))


def test_forest_by_offsets():
    rng = np.random.default_rng(0)
    group = np.sort(rng.integers(0, 6, 200))
    words = (rng.integers(0, 1 << 63, 6).astype(np.uint64)[group] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))[:, None]
    a, b, _ = simhash.links_in(group, words, 2)
    got = simhash._forest(200, a, b) if len(a) else np.arange(200)
    left, right = np.nonzero((np.bitwise_count(words[:, 0][:, None] ^ words[:, 0][None, :]) <= 2) & (group[:, None] == group[None, :]))
    assert (got == simhash._forest(200, left, right)).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i.to_bytes(4, "big"), (i + 1).to_bytes(4, "big")) for i in range(300)], "a binary, b binary")
    assert {bytes(r.label) for r in simhash.components(edges).collect()} == {bytes(4)}


def test_deduplicated_keeps_one_row_of_each_group(spark):
    rng = random.Random(8)
    words = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(30)]
    data = []
    for i, ws in enumerate(words):
        data.append((i * 10 + 1, " ".join(ws), "a"))
        near = list(ws)
        near[100] = "changed"
        data += [(i * 10, " ".join(near), "b"), (i * 10 + 2, " ".join(ws), "c")]
    data += [(0, data[1][1], "twin"), (None, data[0][1], "no id"), (None, "only this one has no id", "alone"), (7000, None, "none"), (7001, "", "empty")]
    df = spark.createDataFrame([(k, t, s, 1, "f", 2, b"p", "s", "m", 3, 4) for k, t, s in data], "doc_id long, text string, source string, _row int, _file string, key int, _print binary, _SET string, bucket string, label int, n int")
    got = simhash.deduplicated(df)
    assert {(r._row, r._file, r._SET, bytes(r._print)) for r in got.collect()} == {(1, "f", "s", b"p")}
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted([str(i * 10) for i in range(30)] + ["None", "7000"])
    assert simhash.deduplicated(df.limit(0)).collect() == []


def likeness_08(n, rng):
    """Pairs of sets of 180 hashes that share 160: likeness 0.8."""
    for _ in range(n):
        h = np.frombuffer(rng.bytes(8 * 200), dtype=np.uint64)
        yield h[:180], h[20:]


def test_bands_find_pairs_whatever_the_size_of_the_corpus():
    rng = np.random.default_rng(2)
    met = [bool(np.any(simhash.band_keys(simhash.least_hashes(a, 96)) == simhash.band_keys(simhash.least_hashes(b, 96)))) for a, b in likeness_08(1000, rng)]
    assert all(met)


def test_deduplicated_asks_no_bit_tables(spark, monkeypatch):
    """Bit tables get wider, and find fewer pairs, as a corpus grows: here as for 2 ** 40 texts."""
    tables = simhash.bit_tables
    monkeypatch.setattr(simhash, "bit_tables", lambda n, *rest: tables(1 << 40, *rest))
    rng = random.Random(9)
    data = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        near = list(words)
        for at in (50, 120, 190):
            near[at] = "changed"
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    got = simhash.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 120, 2))


def shingle_set(text, k=5):
    words = text.lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_alike_in_equals_brute_force():
    rng = np.random.default_rng(4)
    for similarity in (0.5, 0.8):
        sets, group = [], np.sort(rng.integers(0, 4, 120))
        for g in group:
            base = np.arange(g * 1000, g * 1000 + 40 * int(rng.integers(1, 3)), dtype=np.uint64)
            sets.append(np.unique(np.r_[rng.choice(base, int(len(base) * rng.uniform(0.7, 1)), replace=False), rng.integers(0, 9000, 3).astype(np.uint64)]))
        sets[5] = sets[6] = np.array([], dtype=np.uint64)
        a, b = simhash.alike_in(group, sets, similarity)
        near = [(i, j) for i in range(120) for j in range(i) if group[i] == group[j] and len(sets[i]) and len(set(sets[i]) & set(sets[j])) >= similarity * len(set(sets[i]) | set(sets[j]))]
        assert near and all((max(e), min(e)) in near for e in zip(a.tolist(), b.tolist()))
        left, right = np.array(near).T
        assert (simhash._forest(120, a, b) == simhash._forest(120, left, right)).all()


@pytest.mark.parametrize("tile", [simhash.SET_TILE, 8])
def test_deduplicated_decides_on_shingles(spark, monkeypatch, tile):
    """Pairs below 0.8 stay, those from 0.8 on go, a common line that is repeated makes no copies, and tiles lose nothing."""
    whole = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda *a: whole(*a, tile=tile))
    rng = random.Random(10)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    data, line = [], new(9)
    for _ in range(20):
        data.append(" ".join([*(line * 20), *new(60)]))
    for changes in range(1, 11):
        for _ in range(6):
            words = new(200)
            near = list(words)
            for at in range(changes):
                near[10 + at * 19] = "changed"
            data += [" ".join(words), " ".join(near), " ".join(words).upper()]
    chain = new(300)
    for i in range(30):
        chain[i * 9 + 5] = "other"
        data.append(" ".join(chain))
    sets = [shingle_set(t) for t in data]
    label = list(range(len(data)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and label[i] != label[j]:
                old, low = max(label[i], label[j]), min(label[i], label[j])
                label = [low if x == old else x for x in label]
    got = simhash.deduplicated(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(label))
    assert set(range(20)) <= set(label) and 60 < len(set(label)) - 20 < 120
