import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sourcesieve.llm import syncmers
from sourcesieve.llm.syncmers import ANCHORS


def report(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, print string, head int")
    return syncmers.report(df.repartition(3)).collect()


def prints(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), syncmers.fingerprint(F.col("t")).alias("p"))
    return {r.t: r.p for r in df.collect()}


def test_edited_texts_and_neighbours(spark):
    texts = {i: f"text {i} " * (1 + i % 9) + "é😀" * (i % 4) for i in range(-3, 60)} | {100: "", 101: "ab", 102: "long words " * 20_000, 103: None}
    got = {r.doc_id: r for r in report(spark, [(i, t, "x", 1) for i, t in texts.items()])}
    ids = sorted(texts, reverse=True)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i] or "", texts[after] or ""
        want = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[100].fingerprint == got[103].fingerprint and got[103].near_edited == 1


def test_repeats_null_keys_and_single_rows(spark):
    same = "one two three four five six seven"
    got = report(spark, [(1, same, "", 1), (1, same, "", 1), (2, same, "", 1), (None, same, "", 1)])
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 1
    assert [r.near_next for r in got if r.doc_id] == [1.0] * 3
    assert [r.near_next for r in got if r.doc_id is None] == [0.0]
    assert report(spark, [(1, "a b c", "", 1)])[0].near_next == 1.0
    assert report(spark, []) == []


def test_anchors_are_closed_syncmers(spark):
    """Against a plain version: the smallest inner hash stands at an edge; context doesn't matter."""
    words = [f"w{i * 7919 % 101}" for i in range(300)]
    text = " ".join(words)
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    places = [i for i in range(298) if min(run := [h[w] for w in words[i : i + 3]]) in (run[0], run[2])]
    runs = spark.createDataFrame([(i, *[h[w] for w in words[i : i + 3]]) for i in places], "i long, a long, b long, c long").select("i", F.xxhash64("a", "b", "c").alias("x")).collect()
    smallest: dict = {}
    for r in sorted(runs, key=lambda r: (r.x >> 32, r.i)):
        smallest.setdefault(r.x >> 32, r.i)
    want = [(k << 32) | i for k, i in sorted(smallest.items())[:ANCHORS]]
    assert list(prints(spark, [text])[text].words) == want


def test_likeness_tells_edits_from_others(spark):
    base = [f"w{i * 31 % 977}x" for i in range(900)]
    a, b, c = " ".join(base), " ".join(base[:600] + [f"n{i}" for i in range(300)]), " ".join(f"q{i}" for i in range(900))
    short = ["abcdefgh ijk", "abcdefgh xyz", "zzzzzyyy", "abcd", "abcX", ""]
    df = spark.createDataFrame([(a, a), (a, b), (a, c), (short[0], short[1]), (short[0], short[2]), (short[3], short[4]), ("", ""), ("", "x")], "l string, r string")
    df = df.select(syncmers.fingerprint(F.col("l")).alias("l"), syncmers.fingerprint(F.col("r")).alias("r"))
    got = [r[0] for r in df.select(syncmers.likeness(F.col("l"), F.col("r"))).collect()]
    assert got[0] == got[6] == 1 and got[7] == 0 and got[2] == 0
    assert got[1] == pytest.approx(0.5, abs=0.2) and got[3] > 0.3 and got[4] < 0.1 and got[5] > 0.05


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = syncmers.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_key_is_not_the_empty_key(spark):
    df = spark.createDataFrame([(None, "of null " * 5), ("", "of empty " * 5), ("b", "of b " * 5)], "doc_id string, text string")
    got = {r.doc_id: r for r in syncmers.report(df).collect()}
    of = {None: "of null " * 5, "": "of empty " * 5, "b": "of b " * 5}
    edit = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()
    assert got["b"].edited_sha256 == edit(of["b"], of[""]) and got[""].edited_sha256 == edit(of[""], of["b"])
    assert got[None].edited_sha256 == edit(of[None], "") and got[None].near_next == 0.0


def test_long_texts_without_white_space_have_characters(spark):
    rng = random.Random(3)
    long = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))
    df = spark.createDataFrame([(2, long), (1, other)], "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.report(df).collect()}
    assert got[2].near_edited > 0.3 and got[2].near_next < 0.1


def test_character_anchors_and_likeness_equal_a_plain_version(spark):
    text = "abcab cabd éx"
    units = ["", "", "", *text]
    h = {r.u: r.h for r in spark.createDataFrame([(u,) for u in set(units)], "u string").select("u", F.xxhash64("u").alias("h")).collect()}
    runs = [(i, [h[u] for u in units[i : i + 4]]) for i in range(len(units) - 3)]
    places = [(i, *run) for i, run in runs if min(run) in (run[0], run[-1])]
    hashed = spark.createDataFrame(places, "i long, a long, b long, c long, d long").select("i", F.xxhash64("a", "b", "c", "d").alias("x")).collect()
    smallest: dict = {}
    for r in sorted(hashed, key=lambda r: (r.x >> 32, r.i)):
        smallest.setdefault(r.x >> 32, r.i)
    assert list(prints(spark, [text])[text].chars) == [(k << 32) | i for k, i in sorted(smallest.items())[:ANCHORS]]

    def plain(a, b):
        a, b = ({x >> 32: x & (1 << 32) - 1 for x in side} for side in (a, b))
        lowest = sorted({*a, *b})[:ANCHORS]
        moved = sorted((a[k] - b[k], k) for k in a.keys() & b.keys() if k <= lowest[-1])
        if not moved:
            return 0.0
        reach, middle = 16 + max(*a.values(), *b.values()) / 8, moved[len(moved) // 2][0]
        return sum(abs(m - middle) <= reach for m, _ in moved) / len(lowest)

    words = [f"w{i * 31 % 977}x" for i in range(400)]
    texts = [" ".join(words), " ".join(words[50:] + words[:50]), " ".join(words[:300] + ["n"] * 100), " ".join(reversed(words))]
    p = prints(spark, texts)
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "l string, r string")
    rows = df.select("l", "r", syncmers.likeness(syncmers.fingerprint(F.col("l")), syncmers.fingerprint(F.col("r"))).alias("x")).collect()
    assert all(abs(r.x - plain(p[r.l].words, p[r.r].words)) < 1e-9 for r in rows)
