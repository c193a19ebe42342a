import random

import pytest

from sourcesieve.operators.automaton import Scanner
from sourcesieve.plans.program import compile_document


def scanner(tokens, definitions=""):
    return compile_document(f'scope {{ include "**" }} definitions {{ {definitions} }} tokens {{ {tokens} }}').scanner


def texts(s: Scanner, data: bytes):
    assert s.pattern is None or s._scan_pattern(data) == s._scan_table(data)
    found, failed = s.scan(data)
    return [(t, data[a:b]) for t, a, b in found], failed


@pytest.mark.parametrize(
    "tokens, data, expected, failed",
    [
        ("A = 'a'+ B = 'b'", b"aab", [(0, b"aa"), (1, b"b")], -1),
        ('A = "=" B = "=="', b"===", [(1, b"=="), (0, b"=")], -1),
        ('K = "if" W = (\'a\'..\'z\')+', b"if", [(0, b"if")], -1),
        ('W = (\'a\'..\'z\')+ K = "if"', b"if", [(0, b"if")], -1),
        ('K = "if" W = (\'a\'..\'z\')+', b"iff", [(1, b"iff")], -1),
        ("P = 'a' 'b' ('x'|'y'|'z') Q = \"abq\"", b"abq", [(1, b"abq")], -1),
        ("A = 'a' 'b'? 'c'", b"acabc", [(0, b"ac"), (0, b"abc")], -1),
        ("A = ('a' 'b'?)* 'c'", b"aabc", [(0, b"aabc")], -1),
        ("A = 'a'", b"aab", [(0, b"a"), (0, b"a")], 2),
        ("A = 'a' 'b'", b"aba", [(0, b"ab")], 2),
        ("A = 'a' F = fallback", "aé".encode(), [(0, b"a"), (1, b"\xc3"), (1, b"\xa9")], -1),
        ("A = 'a'", b"", [], -1),
        ("A = 'a' \"\" 'b'", b"ab", [(0, b"ab")], -1),
        (r"N = '\n' T = '\t' Q = '\'' B = '\\'", b"\n\t'\\", [(0, b"\n"), (1, b"\t"), (2, b"'"), (3, b"\\")], -1),
    ],
)
def test_scan(tokens, data, expected, failed):
    assert texts(scanner(tokens), data) == (expected, failed)


def longest(tokens, data):
    """Every token at every place by trying all lengths with a plain recursive matcher."""

    def ends(e, at, defs):
        match e.kind:
            case "ref":
                return ends(defs[e.head.text], at, defs)
            case "group":
                return ends(e.items[0], at, defs)
            case "seq":
                here = {at}
                for x in e.items:
                    here = {n for h in here for n in ends(x, h, defs)}
                return here
            case "alt":
                return set().union(*(ends(x, at, defs) for x in e.items))
            case "repeat":
                seen, todo = set() if e.head.kind == "+" else {at}, {at}
                while todo := {n for h in todo for n in ends(e.items[0], h, defs)} - seen:
                    seen |= todo
                    if e.head.kind == "?":
                        break
                return seen
            case "range":
                return {at + 1} if at < len(data) and ord(e.head.value) <= data[at] <= ord(e.to.value) else set()
        want = e.head.value.encode("latin-1")
        return {at + len(want)} if data.startswith(want, at) else set()

    program, out, at = tokens, [], 0
    defs = dict(program.definitions)
    fallback = next((i for i, t in enumerate(program.tokens) if t.expr is None), None)
    while at < len(data):
        best = max(((max(e), -i) for i, t in enumerate(program.tokens) if t.expr and (e := ends(t.expr, at, defs))), default=None)
        if best is None:
            if fallback is None:
                return out, at
            best = (at + 1, -fallback)
        out.append((-best[1], at, best[0]))
        at = best[0]
    return out, -1


def test_random_grammars():
    rng = random.Random(11)

    def expr(depth):
        k = rng.choice(["c", "c", "r", "s", "d"] + (["seq", "alt", "rep"] if depth else []))
        if k == "c":
            return f"'{rng.choice('abc')}'"
        if k == "r":
            return "'a'..'b'"
        if k == "s":
            return '"' + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + '"'
        if k == "d":
            return "d"
        if k == "rep":
            return f"({expr(depth - 1)}){rng.choice('?*+')}"
        return "(" + {"seq": " ", "alt": " | "}[k].join(expr(depth - 1) for _ in range(2)) + ")"

    fast = 0
    for _ in range(400):
        tokens = " ".join(f"T{i} = {expr(2)} {rng.choice(['', 'skip'])}" for i in range(rng.randrange(1, 4))) + rng.choice(["", " F = fallback"])
        try:
            program = compile_document(f'scope {{ include "**" }} definitions {{ d = \'b\' | \'c\' }} tokens {{ {tokens} }}')
        except ValueError:
            continue
        fast += program.scanner.pattern is not None
        for _ in range(10):
            data = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(12)))
            want = longest(program, data)
            assert program.scanner._scan_table(data) == want, tokens
            assert program.scanner.scan(data) == want, tokens
    assert fast > 20


@pytest.mark.parametrize(
    "tokens",
    [
        "W = ('a'|'b')+ N = 'c'",
        "W = ('a'|'b')+ N = 'c' F = fallback",
        "W = ('a'|'b')+ skip N = 'c' F = fallback skip",
        "W = ('a'|'b')+ N = 'c' skip M = \"c\" D = 'd'|'e'",
        'K = "ab" W = (\'a\'|\'b\')+ F = fallback',
        "W = 'a' ('a'|'b')* F = fallback",
        "A = 'a' 'b'? 'c' F = fallback skip",
    ],
)
def test_columns_of_emitted_tokens(tokens):
    s = scanner(tokens)
    rng = random.Random(3)
    for n in [0, 1, 1, 2, 2, *range(60)]:
        data = bytes(rng.choice(b"aabbcde\xc3") for _ in range(n))
        found, failed = s.scan(data)
        *columns, failed_ = s.emitted(data)
        assert (list(zip(*(c.tolist() for c in columns), strict=True)), failed_) == ([t for t in found if t[0] not in s.skip], failed)
