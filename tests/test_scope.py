import random

from pyspark.sql import functions as F

from sourcesieve.operators.scope import Scope


def plain(pattern: list[bytes], name: list[bytes]) -> bool:
    if not pattern:
        return not name
    if pattern[0] == b"**":
        return plain(pattern[1:], name) or (bool(name) and plain(pattern, name[1:]))
    return bool(name) and segment(pattern[0], name[0]) and plain(pattern[1:], name[1:])


def segment(p: bytes, n: bytes) -> bool:
    if not p:
        return not n
    if p[:1] == b"*":
        return segment(p[1:], n) or (bool(n) and segment(p, n[1:]))
    return bool(n) and p[:1] in (b"?", n[:1]) and segment(p[1:], n[1:])


def cases():
    rng = random.Random(2)
    part = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4)))
    fixed = [("vendor/**", "vendor"), ("vendor/**", "vendor/a/b"), ("**", "a"), ("**/b", "b"), ("a/**/b", "a/b"), ("a/***", "a/b"), ("a?", "aé"), ("a??", "aé"), ("[a]", "[a]"), ("", "a"), ("*.go", ".go"), ("a", "A"), ("a.c", "abc")]
    for p, n in fixed:
        yield p, n
    for _ in range(600):
        yield "/".join(rng.choice(["**", part("ab*?é")]) for _ in range(rng.randrange(1, 4))), "/".join(part("abé.") for _ in range(rng.randrange(1, 4)))


def test_patterns_match_bytes():
    for p, n in cases():
        want = plain(p.encode().split(b"/"), n.encode().split(b"/"))
        latin = p.encode().decode("latin-1")
        assert Scope((latin,)).matches(n) == want, (p, n)
        assert Scope(("**",), (latin,)).matches(n) != want, (p, n)


def test_column_gives_the_same(spark):
    names = sorted({n for _, n in cases()})
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for include, exclude in ((("a*/**",), ("**/b",)), (("**/?", "a/**"), ()), (("*",), ("a*", "Ã*"))):
        scope = Scope(include, exclude)
        assert sorted(r[0] for r in df.filter(scope.condition(F.col("path"))).collect()) == [n for n in names if scope.matches(n)]
