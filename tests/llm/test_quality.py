import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sourcesieve.llm import quality


def corpus(n=600):
    rng = random.Random(6)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(["the", "an", "ing", "ou", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w for w in words for _ in range(4)]
        out.append((i, " ".join(words), int(not bad)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t, _ in rows], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = frames(spark, corpus())
    model = quality.fitted(docs, labels)
    again = quality.fitted(docs.repartition(7), labels.repartition(3))
    assert (model.vectors == again.vectors).all() and (model.output == again.output).all()
    rows = quality.scored(docs, model).join(labels.select("doc_id", F.col("quality").alias("q")), "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 80 and np.mean([(r.score >= quality.THRESHOLD) == r.q for r in rows]) > 0.97


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark, monkeypatch):
    rows = corpus(200)
    docs, labels = frames(spark, rows)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 50)
    texts, y = quality.sample(docs, labels)
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(texts) == len(y) == 50 and not set(texts) & held
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 10_000)
    some = quality.sample(docs, labels)[0]
    assert set(some) < set(texts) and 10_000 - max(map(len, texts)) < sum(map(len, some)) <= 10_000
    long = spark.createDataFrame([(i, "w " * (200 * i), None, 0) for i in range(1, 12)], docs.schema)
    assert max(map(len, quality.sample(long, spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)], labels.schema))[0])) > 2000


def plain_buckets(text):
    """(buckets, their weights) of a text, one by one."""
    h = lambda s: zlib.crc32(s.encode())
    mask = (1 << 64) - 1
    both = lambda a, b, k: ((h(a) * 0x9E3779B97F4A7C15 + h(b) * 0xC2B2AE3D27D4EB4F + k) * 0xFF51AFD7ED558CCD & mask) >> 40
    words = [w.decode() for w in text.encode().split()]
    out, n = [], max(4 * len(words) - 3, 1)
    for w in words:
        marked = f"<{w}>"
        own = [h(w), *[h(marked[i : i + k]) for k in (1, 2, 3) for i in range(len(marked) - k + 1)]]
        out += [(x % quality.BUCKETS, 1 / len(own) / n) for x in own]
    for a, b in zip(words, words[1:]):
        out += [(quality.BUCKETS + both(a, b, 1) % quality.BUCKETS, 1 / n), (both(a[-1], b[0], 2) % quality.BUCKETS, 1 / n), (both(a[-2:], b[:2], 3) % quality.BUCKETS, 1 / n)]
    return out


def test_scores_match_a_plain_average(monkeypatch):
    rows = corpus(120)
    model = quality.train([t for _, t, _ in rows], np.array([q for *_, q in rows], dtype=float))
    texts = ["", " \n", " a a  b ", "x" * 3000, "é 😀", "ß", "日本 語", rows[0][1], rows[1][1], None]

    def plain(text):
        found = plain_buckets(text or "")
        return float(model.score(sum(model.vectors[b].astype(float) * w for b, w in found)[None])[0]) if found else model.prior

    for part in (quality.PART, 3):
        monkeypatch.setattr(quality, "PART", part)
        assert np.allclose(quality.scores(model, pa.array(texts), quality.Grams()), [plain(t) for t in texts], atol=1e-9)
    assert model.prior == 0.75


def test_training_equals_plain_steps(monkeypatch):
    """Gradient descent over dense vectors, a document at a time, gives the same model."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    rows = corpus(24)
    texts, y = [t for _, t, _ in rows], np.array([q for *_, q in rows], dtype=float)
    got = quality.train(texts, y)
    rng = np.random.default_rng(quality.SEED)
    vectors = ((rng.random((2 * quality.BUCKETS, quality.DIM), dtype=np.float32) - 0.5) / quality.DIM).astype(float)
    out = np.r_[rng.standard_normal(quality.DIM) / quality.DIM, np.log(y.mean() / (1 - y.mean()))]
    seen, seen_out = np.full(len(vectors), 1e-12), np.full(len(out), 1e-12)
    for _ in range(2):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), quality.BATCH):
            pull, step, before = np.zeros(len(vectors)), np.zeros(len(out)), out.copy()
            for j in order[i : i + quality.BATCH]:
                found = plain_buckets(texts[j])
                hidden = sum(vectors[b] * w for b, w in found)
                wrong = (1 / (1 + np.exp(-(hidden @ out[:-1] + out[-1]))) - y[j]) * (0.5 / y.mean() if y[j] else 0.5 / (1 - y.mean())) / len(order[i : i + quality.BATCH])
                for b, w in found:
                    pull[b] += wrong * w
                step += np.r_[wrong * hidden, wrong]
            moved = np.flatnonzero(pull)
            seen[moved] += pull[moved] ** 2
            vectors[moved] -= quality.RATE * (pull[moved] / np.sqrt(seen[moved]))[:, None] * before[:-1]
            seen_out += step**2
            out = out - quality.RATE * step / np.sqrt(seen_out)
    assert np.allclose(got.output, out, atol=2e-2) and np.allclose(got.vectors, vectors, atol=2e-2)


def test_edges(spark):
    rows = [*corpus(100), (None, "no id", 1), (5000, None, 1), (5001, "", 0), (5002, "w " * 200_000, 1), (5003, "same", 1), (5003, "same", 1)]
    docs, labels = frames(spark, rows)
    model = quality.fitted(docs, labels.union(labels.limit(5)))
    got = quality.scored(docs, model)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert got.columns == ["doc_id", "text", "quality", "score"] and got.count() == len(rows)
    assert all(0 <= s <= 1 for s in scores.values()) and scores[5000] == scores[5001]
    assert not docs.filter("doc_id IS NULL").select(quality.held_out(F.col("doc_id"))).first()[0]
    for some, want in ((labels.limit(0), 1.0), (labels.filter("quality = 0"), 0.0)):
        one = quality.fitted(docs, some)
        assert all(abs(r.score - want) < 1e-3 for r in quality.scored(docs, one).collect())
    assert quality.scored(docs.limit(0), model).collect() == []
