"""The tree parser against a matcher written straight from the rules."""

import random

import pytest

from sourcesieve.operators.trees import Irregular, PatternParser, Run, Step, TreeParser, first_field


def naive(nodes, tokens, root, backtrack=False):
    """Nested tuples (kind, first, count, edges), or None."""

    def match(e, i):
        if e.kind == "token":
            return (i + 1, []) if i < len(tokens) and tokens[i] == e.index else None
        if e.kind == "any":
            return (i + 1, []) if i < len(tokens) else None
        if e.kind == "node":
            found = match(nodes[e.index], i)
            return (found[0], [(None, (e.index, i, found[0] - i, found[1]))]) if found else None
        if e.kind == "capture":
            found = match(e.items[0], i)
            return (found[0], [(e.field, n) for _, n in found[1]]) if found else None
        if e.kind == "group":
            return match(e.items[0], i)
        if e.kind == "alt":
            for x in e.items:
                if found := match(x, i):
                    return found
            return None
        if e.kind == "repeat":
            found = times(e, i)
            return found[-1] if len(found) > e.least else None
        return rest(e, 0, i)

    def rest(e, k, i):
        if k == len(e.items):
            return i, []
        item, name = e.items[k], None
        if backtrack and item.kind == "capture" and item.items[0].kind == "repeat":
            item, name = item.items[0], item.field
        if item.kind == "repeat":
            found = times(item, i)
            for n in range(len(found) - 1, item.least - 1, -1):
                if tail := rest(e, k + 1, found[n][0]):
                    return tail[0], [(name or f, x) for f, x in found[n][1]] + tail[1]
            return None
        if not (found := match(item, i)) or not (tail := rest(e, k + 1, found[0])):
            return None
        return tail[0], found[1] + tail[1]

    def times(e, i):
        out = [(i, [])]
        while e.most is None or len(out) <= e.most:
            found = match(e.items[0], out[-1][0])
            if not found or found[0] == out[-1][0]:
                break
            out.append((found[0], out[-1][1] + found[1]))
        return out

    found = match(Step("node", index=root), 0)
    return found[1][0][1] if found and found[0] == len(tokens) else None


def plain(node):
    return node and (node.kind, node.first, node.count, [(f, plain(n)) for f, n in node.children])


def grammar(rng, depth, low, n):
    kind = rng.choice(["token", "token", "any", "node", *(["seq", "seq", "alt", "repeat", "capture", "group"] if depth else [])])
    inner = lambda: grammar(rng, depth - 1, low, n)
    if kind == "node" and low < n:
        return Step("node", index=rng.randrange(low, n))
    if kind in ("token", "node"):
        return Step("token", index=rng.randrange(3))
    if kind == "any":
        return Step("any")
    if kind in ("seq", "alt"):
        return Step(kind, tuple(inner() for _ in range(rng.randrange(2, 4))))
    if kind == "repeat":
        sign = rng.choice("?*+")
        return Step(kind, (inner(),), least=int(sign == "+"), most=1 if sign == "?" else None)
    return Step(kind, (inner(),), field=rng.choice("fg") if kind == "capture" else "")


def test_random_grammars():
    rng, matched = random.Random(5), 0
    for _ in range(8000):
        n = rng.randrange(1, 4)
        nodes = [grammar(rng, 3, i + 1, n) for i in range(n)]
        tokens = [rng.randrange(3) for _ in range(rng.randrange(7))]
        backtrack = rng.random() < 0.3
        want = naive(nodes, tokens, 0, backtrack)
        assert plain(TreeParser(nodes, backtrack).parse(tokens, 0)) == want, (nodes, tokens)
        matched += want is not None
    assert matched > 500


def test_long_runs_without_an_end_stay_linear():
    word, dot = Step("token", index=0), Step("token", index=1)
    sentence = Step("seq", (Step("repeat", (word,), least=1), dot))
    root = Step("repeat", (Step("alt", (Step("node", index=1), Step("any"))),))
    found = TreeParser([root, sentence]).parse([0] * 50_000, 0)
    assert found.count == 50_000 and not found.children


def test_captured_repetition_keeps_all_unless_told():
    nodes = [Step("seq", (Step("token", index=0), Step("capture", (Step("repeat", (Step("any"),)),), field="f"), Step("token", index=1)))]
    assert TreeParser(nodes).parse([0, 2, 1], 0) is None
    assert TreeParser(nodes, backtrack_captures=True).parse([0, 2, 1], 0).count == 3


def test_first_field():
    leaf = Step("token", index=0)
    nodes = [Step("seq", (Step("capture", (Step("node", index=1),), field="a"), Step("capture", (Step("repeat", (Step("node", index=1),)),), field="a"))), leaf]
    root = TreeParser(nodes).parse([0, 0, 0], 0)
    assert first_field(root, ("a",)).first == 0 and first_field(root, ("a", "b")) is None


def spelled(n):
    """A tree as nested tuples, runs written out."""
    if n is None:
        return None
    below = [(f, spelled(c)) for f, x in n.children for c in ([x[i] for i in range(x.number)] if isinstance(x, Run) else [x])]
    return n.kind, n.first, n.count, below


def test_patterns_give_the_same_trees():
    rng = random.Random(11)

    def some(depth, kind, n):
        match rng.choice(["token", "token", "any", "node", "alt", "group", "repeat", "seq", "capture"] if depth else ["token", "node"]):
            case "token":
                return Step("token", index=rng.randrange(3))
            case "any":
                return Step("any")
            case "node":
                return Step("node", index=rng.randrange(kind + 1, n)) if kind + 1 < n else Step("token", index=rng.randrange(3))
            case "repeat":
                least, most = rng.choice([(0, None), (1, None), (0, 1)])
                return Step("repeat", (some(depth - 1, kind, n),), least=least, most=most)
            case "capture":
                return Step("capture", (some(depth - 1, kind, n),), field=rng.choice("fg"))
            case ("alt" | "seq") as name:
                return Step(name, tuple(some(depth - 1, kind, n) for _ in range(rng.randrange(2, 4))))
        return Step("group", (some(depth - 1, kind, n),))

    made = matched = 0
    while made < 1500:
        n = rng.randrange(1, 5)
        nodes, backtrack = [some(3, k, n) for k in range(n)], rng.random() < 0.3
        try:
            parser = PatternParser(nodes, backtrack, 0, 3)
        except Irregular:
            continue
        made += 1
        for _ in range(10):
            tokens = bytes(rng.choices(range(3), k=rng.randrange(9))) if rng.random() < 0.6 else bytes([rng.randrange(3)]) * rng.randrange(9)
            found = spelled(parser.parse(tokens, 0))
            assert found == spelled(TreeParser(nodes, backtrack).parse(list(tokens), 0)), (nodes, tokens)
            matched += found is not None
    assert matched > 500


def test_what_patterns_refuse():
    token, node = Step("token", index=0), Step("node", index=1)
    many = Step("repeat", (token,))
    sentence = Step("seq", (many, Step("token", index=1)))
    for nodes in (
        [Step("seq", (token, Step("repeat", (Step("node", index=0),), most=1)))],  # recursion
        [Step("repeat", (Step("group", (many,)),))],  # repeats what may be empty
        [Step("repeat", (Step("alt", (node, token)),)), Step("seq", (Step("capture", (many,), field="f"), Step("token", index=1)))],  # each place reads on to the end
        [sentence],  # gives iterations back
    ):
        with pytest.raises(Irregular):
            PatternParser(nodes, False, 0, 2)
    with pytest.raises(Irregular):
        PatternParser([token], False, 0, 257)
