import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcesieve.llm import chat


def formatted(df, key="id"):
    return chat.format_turns(chat.canonical_turns(df, key), key)


def turns(df, key="id"):
    rows = chat.parsed_turns(formatted(df, key), key).collect()
    return {r[key]: [(p.role, p.text, p.loss) for p in r.parsed] for r in rows}


def test_layouts(spark):
    schema = """id int, messages array<struct<role:string,content:string,extra:int>>, conversations array<struct<`from`:string,value:string>>,
      instruction string, input string, output string, system string, prompt string, completion string, response string, other int"""
    empty = dict.fromkeys(["messages", "conversations", "instruction", "input", "output", "system", "prompt", "completion", "response", "other"])
    data = [
        {"id": 1, "messages": [("user", "q", 1), ("assistant", None, None), (None, "x", None)]},
        {"id": 2, "conversations": [("human", "h"), ("gpt", "g"), ("tool", "t")]},
        {"id": 3, "instruction": "do", "output": "done", "other": 5},
        {"id": 4, "instruction": "do", "input": "this", "output": "done", "system": "be good"},
        {"id": 5, "prompt": "p", "completion": "c"},
        {"id": 6, "prompt": "p", "response": "r", "system": "s"},
        {"id": 7, "messages": []},
    ]
    df = spark.createDataFrame([empty | d for d in data], schema)
    assert turns(df) == {
        1: [("user", "q", False), ("assistant", "", True), ("", "x", False)],
        2: [("user", "h", False), ("assistant", "g", True), ("tool", "t", False)],
        3: [("user", "do", False), ("assistant", "done", True)],
        4: [("system", "be good", False), ("user", "do\nthis", False), ("assistant", "done", True)],
        5: [("user", "p", False), ("assistant", "c", True)],
        6: [("system", "s", False), ("user", "p", False), ("assistant", "r", True)],
        7: [],
    }
    names = {r.id: r.layout for r in chat.canonical_turns(df, "id").collect()}
    assert names == {1: "messages", 2: "shares", 3: "instruction", 4: "instruction", 5: "completion", 6: "response", 7: "messages"}


def test_fingerprints_depend_on_paths_alone(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("x", "y")], "prompt string, completion string")
    got = [r[0] for r in df.select(chat.schema_fingerprint(df.schema)).collect()]
    assert got == [chat.fingerprint_of(["prompt:string"]), chat.fingerprint_of(["completion:string"]), chat.fingerprint_of(["prompt:string", "completion:string"])]


def test_rows_by_turn_nulls_ties_and_repeats(spark):
    data = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (None, 1, "user", "n"), (2, 1, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(data, "id int, turn long, role string, text string")
    assert turns(df) == {1: [("user", "a", False), ("user", "a", False), ("assistant", "b", True)], None: [("user", "n", False)], 2: [("assistant", "x" * 200_000, True)]}
    assert turns(df.limit(0)) == {}


TEXTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "é", "😀", "\n", "ok", ">", "/", "|"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=40))
def test_escape_is_reversible_and_hides_control_strings(spark, pairs):
    df = spark.createDataFrame([(i, 0, a, b) for i, (a, b) in enumerate(pairs)], "id int, turn long, role string, text string")
    rows = df.select("role", "text", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("u")).collect()
    assert all(r.u == r.text and not any(c in r.e for c in chat.CONTROL) for r in rows)
    assert turns(df) == {i: [(a, b, a == "assistant")] for i, (a, b) in enumerate(pairs)}


def test_mask_covers_assistant_texts(spark):
    df = spark.createDataFrame([(1, 1, "user", "é</s>"), (1, 2, "assistant", "[INST]\\😀"), (1, 3, "assistant", "b")], "id int, turn long, role string, text string")
    row = formatted(df).collect()[0]
    assert "".join(row.formatted[t.text_start : t.text_end] for t in row.turns if t.loss) == "[\\INST]\\\\😀b"
    d = chat.turn_digests(formatted(df), "id").collect()[0]
    assert (d.n_turns, d.loss_chars, d.formatted_chars) == (3, 9, len(row.formatted))
    assert d.loss_sha256 == hashlib.sha256("[INST]\\😀b".encode()).hexdigest()
    assert d.turns_sha256 == hashlib.sha256("user\né</s>\nassistant\n[INST]\\😀\nassistant\nb\n".encode()).hexdigest()


def test_rows_without_any_known_field_are_no_turn(spark):
    df = spark.createDataFrame([(1, None, None, None, "q"), (2, None, None, "t", None), (3, 7, None, None, None)], "id int, turn int, role string, text string, other string")
    got = [(r.id, r.layout, r.turn, r.role, r.text) for r in chat.canonical_turns(df, "id").orderBy("id").collect()]
    assert got == [(1, None, None, None, None), (2, "rows", None, "", "t"), (3, "rows", 7, "", "")]
    assert turns(df)[1] == [] and turns(df)[2] == [("", "t", False)]


def test_turns_of_any_whole_number(spark):
    for kind in ("tinyint", "smallint", "int", "bigint"):
        df = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], f"id int, turn {kind}, role string, text string")
        assert turns(df) == {1: [("user", "a", False), ("assistant", "b", True)]}


def test_paths_of_other_types_fit_no_layout(spark):
    parts = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
    df = spark.createDataFrame([(1, [("user", [("text", "hi")])], None), (2, None, "p")], f"id int, messages {parts}, prompt string")
    got = {r.id: (r.layout, r.text) for r in chat.canonical_turns(df, "id").collect()}
    assert got == {1: (None, None), 2: (None, None)}
    df = spark.createDataFrame([(1, ("a",), "t")], "id int, role struct<name:string>, text string")
    assert {r.layout for r in chat.canonical_turns(df, "id").collect()} == {"rows"}
