import re

from sourcesieve.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares the excess again and again, as the rule says."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        shares = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / shares for s in names}
        above = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def docs(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, size string, copies int")


def rows():
    out = [(i, "w " * (1 + i % 50), f"s{i % 7}", "x", 9) for i in range(600)]
    out += [(1000 + i, "a\tb\x0bc d", "hot", None, None) for i in range(900)]
    return out + [(5000, None, "s1", None, 1), (5001, "", None, "", 1), (None, "no id here", None, None, 1), (7, "again", "s1", None, 1), (7, "again", "s1", None, 1), (8, None, "empty", None, 1)]


def test_targets_follow_the_rule(spark):
    sizes = {"a": 10, "b": 1000, "B": 50, None: 7, "é": 0, "c": 300}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_words_are_runs_without_ascii_space(spark):
    df = docs(spark, rows() + [(1, "a b　c\x1cd  e\n\nf ", "s", None, 0)])
    for r in df.select("text", mixing.words("text").alias("n")).collect():
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))


def test_mix_takes_what_rates_say(spark):
    df = docs(spark, rows())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    first, second = (sorted(map(repr, mixing.mix(d).collect())) for d in (df, df.repartition(5)))
    assert first == second and first
    sizes: dict = {}
    for _, text, source, *_ in rows():
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    got: dict = {}
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + len((r.text or "").split())
    assert "empty" not in got
    assert abs(sum(got.values()) / sum(sizes.values()) - 1) < 0.1
    assert abs(got["hot"] / want["hot"] - 1) < 0.15


def test_columns_of_the_names_that_are_made(spark):
    df = spark.createDataFrame([(1, "a", 5, "t", 1.0, 2, "r"), (2, "b", 5, "t", 1.0, 2, "r")], "doc_id long, source string, size long, target string, source_size double, copies int, _rate string")
    got = mixing.with_copies(df, mixing.targets(df.select("source", "size"))).collect()
    assert sorted((r.doc_id, r.source_size, r.target) for r in got) == [(1, 5, 50 / 7), (2, 5, 20 / 7)]


def test_no_rows(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
