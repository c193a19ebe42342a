import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sourcesieve.operators import diagnostics as D
from sourcesieve.operators.frames import Wanted, scan_and_parse
from sourcesieve.plans.analysis import Analysis
from sourcesieve.plans.program import compile_document
from sourcesieve.plans.queries import MIXED, placed
from sourcesieve.sources import tables

DOC = r"""
scope { include "**" exclude "skip/**" }
definitions { letter = 'a'..'z' | 'A'..'Z'  digit = '0'..'9' }
tokens { Space = (' ' | '\n')+ skip  Name = letter (letter|digit)*  Num = digit+  Eq = "="  Semi = ';'  LB = '{'  RB = '}' }
syntax {
  node Root { items*: Item }
  node Item { oneOf { Block Stmt } }
  node Block { LB inner*: Stmt RB }
  node Stmt { name: Id Eq value?: Val Semi }
  node Id { Name }
  node Val { Num+ }
}
rules {
  rule X { match Name where Name.text == "x" report warn at Name "x" }
  rule N { match Name report info at Name "name" }
  err "falls": Stmt + Stmt where right.name.text < left.name.text
  info "in block": Block Stmt
  warn "long": Stmt > Val where Val.length > 2
  info "free": Stmt:not(Block *)
  info "not under item": Stmt:not(Item > *)
  err "blank": Item + Item where gap.blankLines > 0
  warn "no value": Stmt where Stmt.value.text == ""
  info "same": Stmt where Stmt.name.length == right.value.length
}
"""


def run(spark, sources, document=DOC, **how):
    df = spark.createDataFrame([(p, c.encode() if isinstance(c, str) else c) for p, c in sources], "path string, content binary")
    rows = Analysis(document).diagnostics(df, ordered=True, **how).collect()
    return [(r.path, r.severity, r.message, r.start, r.end) for r in rows]


def test_everything_in_order(spark):
    text = "{b = 1; a = 22 2;}\n\n\nx = ;"
    assert run(spark, [("b.go", "a = 1;"), ("b/f", text), ("skip/x", "x=1;")]) == [
        ("b/f", "info", "name", 1, 2),
        ("b/f", "info", "name", 8, 9),
        ("b/f", "warn", "x", 21, 22),
        ("b/f", "info", "name", 21, 22),
        ("b/f", "info", "in block", 1, 7),
        ("b/f", "info", "not under item", 1, 7),
        ("b/f", "info", "same", 1, 7),
        ("b/f", "info", "in block", 8, 17),
        ("b/f", "info", "not under item", 8, 17),
        ("b/f", "warn", "long", 12, 16),
        ("b/f", "err", "falls", 8, 17),
        ("b/f", "info", "free", 21, 26),
        ("b/f", "warn", "no value", 21, 26),
        ("b/f", "err", "blank", 21, 26),
        ("b.go", "info", "name", 0, 1),
        ("b.go", "info", "free", 0, 6),
        ("b.go", "info", "same", 0, 6),
    ]


def test_failures_keep_what_came_before(spark):
    assert run(spark, [("a", "x = !")]) == [("a", "warn", "x", 0, 1), ("a", "info", "name", 0, 1), ("a", "err", "No token matched at byte offset 4.", 4, 5)]
    assert run(spark, [("a", "1 x")])[-1] == ("a", "err", 'Source text does not match syntax root "Root".', 0, 3)
    assert run(spark, [("a", "x = !")], first=True) == [("a", "warn", "x", 0, 1)]
    assert run(spark, [("a", "= !"), ("b", "=")], first=True) == [("a", "err", "No token matched at byte offset 2.", 2, 3), ("b", "err", 'Source text does not match syntax root "Root".', 0, 1)]


def test_empty_sources_nulls_and_repeats(spark):
    assert run(spark, [("a", ""), ("b", None)]) == []
    assert len(run(spark, [("a", "a = 1;")] * 3)) == 9
    assert run(spark, []) == []


def test_equal_paths_are_separate_sources(spark):
    assert run(spark, [("a", "x = !")] * 2, first=True) == [("a", "warn", "x", 0, 1)] * 2
    df = spark.createDataFrame([("a", b"a = 1;"), ("a", b"{b = 2;}"), ("a", b"a = 1;")], "path string, content binary")
    one = {c: Analysis(DOC).trees(df.filter(F.col("content") == c.encode()).limit(1)).collect()[0].tree for c in ("a = 1;", "{b = 2;}")}
    assert sorted(r.tree for r in Analysis(DOC).trees(df).collect()) == sorted([one["a = 1;"], one["{b = 2;}"], one["a = 1;"]])


def test_partitions_don_t_matter(spark):
    sources = [(f"d{i % 7}/f{i}", f"a{i} = {i};\n" * (i % 5) + "{x = ;}") for i in range(60)]
    df = spark.createDataFrame([(p, c.encode()) for p, c in sources], "path string, content binary")
    one, eight = (Analysis(DOC).diagnostics(df.repartition(n), ordered=True).collect() for n in (1, 8))
    assert one == eight and len(one) > 300


def test_no_shuffle_without_order(spark):
    df = spark.createDataFrame([("a", b"x = 1;")], "path string, content binary")
    plan = Analysis(DOC).diagnostics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_frames_and_trees(spark):
    df = tables.from_table(spark.createDataFrame([("d\\f", "a = 12;")], "p string, c string"), F.col("p"), "c")
    a = Analysis(DOC)
    assert [tuple(r)[1:] for r in a.tokens(df).collect()] == [(0, 1, "Name", b"a", 0, 1), (1, 3, "Eq", b"=", 2, 3), (2, 2, "Num", b"12", 4, 6), (3, 4, "Semi", b";", 6, 7)]
    nodes = {r.kind_name: r for r in a.nodes(df, texts=True).collect()}
    assert (nodes["Val"].field, nodes["Val"].depth, nodes["Val"].text, nodes["Val"].ancestor_kinds) == ("value", 3, b"12", [0, 1, 3])
    assert (nodes["Id"].node_id, nodes["Id"].parent_id, nodes["Root"].node_id, nodes["Root"].parent_id) == (0, 2, 4, None)
    assert a.trees(df).collect()[0].tree == "Tree\n  Node Root [0:4]\n    items: Node Item [0:4]\n      Node Stmt [0:4]\n        name: Node Id [0:1]\n        value: Node Val [2:3]"
    assert [tuple(r) for r in a.errors(spark.createDataFrame([("a", b"!"), ("b", b"1")], "path string, content binary")).orderBy("path").collect()] == [("a", "scan", 0, 1), ("b", "parse", 0, 1)]


def test_empty_nodes_have_zero_width(spark):
    doc = "scope { include \"**\" } tokens { A = 'a' B = 'b' S = ' ' skip } syntax { node R { A e: E B? t: E } node E { C* } node C { 'x' } }".replace("'x'", "A A")
    nodes = Analysis(doc).nodes(spark.createDataFrame([("p", b"a  b"), ("q", b"a ")], "path string, content binary"))
    assert sorted((r.path, r.start, r.end) for r in nodes.filter("kind_name = 'E'").collect()) == [("p", 3, 3), ("p", 4, 4), ("q", 1, 1), ("q", 1, 1)]


def test_nothing_is_parsed_without_a_single_root(spark):
    doc = "scope { include \"**\" } tokens { A = 'a' } syntax { node R { A } node S { A A } } rules { rule T { match A report info at A \"a\" } }"
    assert compile_document(doc).root == -1
    assert run(spark, [("p", "aaa")], doc) == [("p", "info", "a", i, i + 1) for i in range(3)]


def test_non_ascii_lengths_and_order_are_bytewise(spark):
    doc = 'scope { include "**" } tokens { W = fallback } rules { rule A { match W where W.text > "z" report info at W "high" } rule B { match W where W.length == 1 report warn at W "one" } }'
    assert run(spark, [("p", "é")], doc) == [("p", s, m, i, i + 1) for i in (0, 1) for s, m in (("info", "high"), ("warn", "one"))]


def test_counts_and_status(spark):
    df = spark.createDataFrame([("a", b"x = 1;")], "path string, content binary")
    found = Analysis(DOC).diagnostics(df)
    assert {r.severity: r.n for r in D.counts(found).collect()} == {"warn": 1, "info": 3}
    assert (D.exit_status(found), D.exit_status(found.filter("false"))) == (1, 0)


@pytest.mark.parametrize("operator, want", [("==", [2]), ("!=", [0, 4]), ("<", [0]), ("<=", [0, 2]), (">", [4]), (">=", [2, 4]), ("startsWith", [2])])
def test_comparisons(spark, operator, want):
    doc = f"scope {{ include \"**\" }} tokens {{ W = 'a'..'z' S = ' ' skip }} rules {{ rule R {{ match W where W.text {operator} \"b\" report info at W \"m\" }} }}"
    assert [x[3] for x in run(spark, [("p", "a b c")], doc)] == want


def test_token_lists_and_warnings(spark):
    df = spark.createDataFrame([("a", b"x = 1;"), ("b", b"!"), ("c", None)], "path string, content binary")
    got = {r.path: r.tokens and [tuple(t) for t in r.tokens] for r in Analysis(DOC).token_lists(df).collect()}
    assert got == {"a": [("Name", 0, 1), ("Eq", 2, 3), ("Num", 4, 5), ("Semi", 5, 6)], "b": None, "c": []}
    doc = "scope { include \"**\" } tokens { S = ' ' skip } rules { rule R { match S report info at S \"never\" } }"
    assert len(Analysis(doc).program.warnings) == 1 and run(spark, [("p", "  ")], doc) == []


def test_places_scan_each_source_once(spark):
    scanned = spark.sparkContext.accumulator(0)

    def content(text):
        scanned.add(1)
        return text.encode()

    df = spark.createDataFrame([(f"d{i % 9}/f{i}", f"of the and of\nof {i}\n" * (i % 4)) for i in range(200)], "path string, t string")
    found = Analysis(MIXED).diagnostics(df.select("path", F.udf(content, "binary")("t").alias("content")))
    rows = placed(found).orderBy("place").collect()
    assert scanned.value == 200
    want = [(r.path, r.severity, r.message, r.start, r.end, i) for i, r in enumerate(Analysis(MIXED).diagnostics(df.select("path", F.col("t").alias("content")), ordered=True).collect(), 1)]
    assert [tuple(r) for r in rows] == want and len(want) == 50 * (5 + 11 + 17)


def test_places_of_nothing_and_of_equal_paths(spark):
    df = spark.createDataFrame([("b", b"x = 1;"), ("a", b"x = 1;"), ("b", b"x = 1;"), ("a/c", b""), ("c", None)], "path string, content binary")
    found = Analysis(DOC).diagnostics(df)
    assert placed(found.filter("false")).collect() == []
    rows = placed(found).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 13)) and [r.path for r in rows] == ["a"] * 4 + ["b"] * 8


#: Every kind of relation, value and comparison.
ALL = DOC.split("rules")[0] + r"""
rules {
  rule A { match Name where Name.text >= "b" report info at Name "a" }
  rule B { match Name where Name.length < 2 report info at Name "b" }
  rule C { match Name where Name.text startsWith "ab" report info at Name "c" }
  rule D { match Num where Num.text == Num.text report info at Num "d" }
  rule E { match Eq report info at Eq "e" }
  info "f": Stmt + Stmt where gap.blankLines == 0
  info "g": Stmt + Stmt where gap.length > 1
  info "h": Item + Item where gap.text != " "
  info "i": Stmt + Stmt where left.value.text startsWith "1"
  info "j": Stmt + Stmt where right.value.length != left.name.length
  info "k": Item + Item
  info "l": Id where Id.text == "ab"
  info "m": Id where Id.length > 1
  info "n": Block Stmt
  info "o": Stmt:not(Block *) where Stmt.value.text < "2"
  info "p": Item > Stmt where Stmt.length >= 5
  info "q": Val:not(Stmt > *)
  info "r": Root where Root.length == 0
  info "s": Stmt + Stmt where left.text == right.text
}
"""


@pytest.mark.parametrize("document", [DOC, ALL, MIXED])
def test_the_stage_gives_what_rules_hold_for(spark, document):
    """The same diagnostics as from all rows, and no row without one."""
    rng = random.Random(5)
    names = ["a", "ab", "abc", "x", "b1"]

    def stmt():
        return f"{rng.choice(names)} = {rng.choice(['', '1', '12', '2 2'])};" + rng.choice(["", " ", "\n", "\n\n", "\n\n\n"])

    texts = ["".join(rng.choice([stmt(), "{" + "".join(stmt() for _ in range(rng.randrange(4))) + "}"]) for _ in range(rng.randrange(6))) for _ in range(150)] + ["a = !", "{", "", "of and\nof and of\nof", "and\n\n\n"]
    df = spark.createDataFrame([(f"p{i}", t.encode()) for i, t in enumerate(texts)], "path string, content binary").repartition(3).cache()
    program = compile_document(document)
    wanted = Wanted.by_rules(program)
    rows = scan_and_parse(df, program, wanted)
    some, every = (sorted(map(tuple, D.diagnostics_of(x, program).collect())) for x in (rows, scan_and_parse(df, program, replace(wanted, held=False))))
    assert some == every and len(every) > 50
    own = ("path", "rec", "idx")
    assert rows.count() == D.diagnostics_of(rows, program, "rec", "idx").select(*own).distinct().count()
    df.unpersist()
