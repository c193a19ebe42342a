import io

from sourcesieve.cli import run
from sourcesieve.functions.udtf import register_tokens
from sourcesieve.operators.scope import Scope
from sourcesieve.plans.analysis import Analysis
from sourcesieve.sources.directory import directory, files
from sourcesieve.streaming.stream import stream_diagnostics, stream_directory

DOC = """
scope { include "**/*.txt" exclude "out/**" }
tokens { Word = ('a'..'z')+  Space = (' ' | '\\n')+ skip }
syntax { node Root { words*: W } node W { Word } }
rules { rule R { match Word where Word.text == "bad" report err at Word "bad word" } info "last": W + W where right.text < left.text }
"""


def tree(tmp_path, files):
    root = tmp_path / "root"
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (tmp_path / "doc.sieve").write_text(DOC)
    return str(tmp_path / "doc.sieve"), str(root)


FILES = {"b.txt": b"good", "a/z.txt": b"bad a", "a/.hidden.txt": b"bad", "_x/y.txt": b"b a", "out/o.txt": b"bad", "n.md": b"bad"}


def call(spark, *args):
    out, err = io.StringIO(), io.StringIO()
    return run(list(args), out, err, lambda: spark), out.getvalue(), err.getvalue()


def test_diagnostics_in_walk_order(spark, tmp_path):
    doc, root = tree(tmp_path, FILES)
    assert call(spark, doc, root) == (1, "_x/y.txt:2-3: info: last\na/.hidden.txt:0-3: err: bad word\na/z.txt:0-3: err: bad word\na/z.txt:4-5: info: last\n", "")


def test_trees_come_before_diagnostics(spark, tmp_path):
    doc, root = tree(tmp_path, {"f.txt": b"bad", "g.txt": b"!"})
    assert call(spark, doc, "-print-ast", root) == (1, "f.txt\nTree\n  Node Root [0:1]\n    words: Node W [0:1]\nf.txt:0-3: err: bad word\ng.txt:0-1: err: No token matched at byte offset 0.\n", "")


def test_clean_directory(spark, tmp_path):
    doc, root = tree(tmp_path, {"f.txt": b"a b"})
    assert call(spark, root, "--print-ast", doc)[0] == 2
    assert call(spark, doc, root) == (0, "", "")


def test_usage_and_files(spark, tmp_path):
    doc, root = tree(tmp_path, {"f.txt": b"a"})
    usage = "usage: sourcesieve [-print-ast] <dsl-file> <directory>\n"
    assert call(spark, doc) == (2, "", "expected DSL file path and analysis directory\n" + usage)
    assert call(spark, "-x", doc, root) == (2, "", 'unknown flag "-x"\n' + usage)
    assert call(spark, doc + "no", root)[0] == 2
    assert call(spark, doc, root + "/f.txt") == (2, "", f'analysis path "{root}/f.txt" is not a directory\n')
    assert call(spark, doc, root + "/none")[2].startswith("failed to stat analysis directory")
    (tmp_path / "doc.sieve").write_text('scope { exclude "x" } tokens { A = b }')
    assert call(spark, doc, root)[2] == f'{doc}:0-21: error: Scope must contain at least one include.\n{doc}:35-36: error: Definition "b" is not declared.\n'
    (tmp_path / "doc.sieve").write_text("scope }")
    assert call(spark, doc, root)[2] == f"{doc}:6-7: error: Expected '{{', found '}}'.\n"


def test_sources(spark, tmp_path):
    _, root = tree(tmp_path, FILES)
    scope = Scope(("**/*.txt",), ("out/**",))
    assert sorted(r.path for r in directory(spark, root, scope).collect()) == ["_x/y.txt", "a/.hidden.txt", "a/z.txt", "b.txt"]
    assert sorted(r.path for r in files(spark, root, scope).collect()) == ["a/z.txt", "b.txt"]
    (tmp_path / "empty").mkdir()
    assert directory(spark, str(tmp_path / "empty")).count() == 0


def test_sources_agree_on_names_and_scope(spark, tmp_path):
    names = ("src/a b.txt", "src/a%20b.txt", "src/100%.txt", "src/c+d.txt", "src/out/e.txt", "other.txt")
    _, root = tree(tmp_path, {n: b"x" for n in names})
    scope = Scope(("src/*.txt",), ("src/out/**",))
    want = sorted(names[:4])
    assert sorted(r.path for r in directory(spark, root, scope).collect()) == want
    for at in (root, root + "/", "file://" + root):
        assert sorted(r.path for r in files(spark, at, scope).collect()) == want
    stream = stream_directory(spark, root)
    query = stream.filter(scope.condition(stream["path"])).writeStream.format("memory").queryName("named").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.path for r in spark.table("named").collect()) == want


def test_stream_and_table_function(spark, tmp_path):
    _, root = tree(tmp_path, {"a/z.txt": b"bad a", "b.txt": b"x bad"})
    analysis = Analysis(DOC)
    for _ in range(2):  # the second run finds nothing new
        q = stream_diagnostics(analysis, stream_directory(spark, root), str(tmp_path / "found"), str(tmp_path / "checkpoint"))
        q.awaitTermination()
    assert sorted((r.path.rpartition("/")[2], r.start, r.message) for r in spark.read.parquet(str(tmp_path / "found")).collect()) == [("b.txt", 2, "bad word"), ("b.txt", 2, "last"), ("z.txt", 0, "bad word"), ("z.txt", 4, "last")]
    register_tokens(spark, analysis.program)
    assert [tuple(r) for r in spark.sql("SELECT * FROM sieve_tokens(CAST('ab c' AS BINARY))").collect()] == [(0, "Word", 0, 2), (1, "Word", 3, 4)]
