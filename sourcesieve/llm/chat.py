r"""Chat formatting: records of several layouts become canonical turns, and turns become training text with a loss mask.

A row's schema fingerprint is the hash of the sorted nested field paths, with types, that it fills (``messages[].role:string``).
Each layout accepts a few fingerprints over its own paths, and the first layout that accepts selects the mapping, so columns
that a layout doesn't name never matter. Whole numbers of any width count as one type; a path of another type than a layout names
(content that is a list of parts, a role that is a struct) makes that layout accept no row.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>\n`` per turn. Inside roles and texts a backslash is doubled and one is put
after the first character of every control string, so no control string of any kind is left there, and unescape() gives the
same text back.

Edge cases: null roles and texts are empty; turns order by turn (null first), role, text; repeated rows stay repeated turns; rows
with a null key form one conversation; a record without turns gives an empty formatted text; rows that no layout accepts,
such as those with neither turn nor role nor text, are kept with layout null and no turns; an empty table gives no rows. A conversation is one output value, so its turns meet in one
task; nothing else does.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Strings that common chat templates and tokenizers give a meaning.
CONTROL = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: name: paths that must be filled, paths that may be, paths of which one must be, and the turns: (role, text path), or an array with its role and text fields.
LAYOUTS: dict[str, dict] = {
    "messages": {"must": ("messages[].content", "messages[].role"), "may": (), "array": ("messages", "role", "content")},
    "shares": {"must": ("conversations[].from", "conversations[].value"), "may": (), "array": ("conversations", "from", "value")},
    "instruction": {"must": ("instruction", "output"), "may": ("input", "system"), "turns": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    "completion": {"must": ("prompt", "completion"), "may": ("system",), "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    "response": {"must": ("prompt", "response"), "may": ("system",), "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "rows": {"must": (), "any": ("role", "text", "turn"), "may": ("role", "text", "turn"), "row": ("turn", "role", "text")},
}
#: Names that ShareGPT-like layouts use for roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def escape(text: Column) -> Column:
    rest = "|".join(rf"\Q{c[1:]}\E" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={rest})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def field_paths(schema: T.StructType) -> Iterator[tuple[str, str, Column]]:
    """(path, type, whether a row fills it) of the schema's leaves: columns, fields of structs, and fields in arrays of structs."""

    def walk(kind: T.DataType, path: str, get: Column) -> Iterator[tuple[str, str, Column]]:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{path}.{f.name}", get.getField(f.name))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                yield f"{path}[].{f.name}", f.dataType.simpleString(), get.isNotNull()
        else:
            yield path, "bigint" if isinstance(kind, T.IntegralType) else kind.simpleString(), get.isNotNull()

    for f in schema.fields:
        yield from walk(f.dataType, f.name, F.col(f"`{f.name}`"))


def fingerprint_of(paths: list[str]) -> int:
    """What schema_fingerprint() gives for a row that fills these paths."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(paths)), 42)
    return h - (h >> 63 << 64)


def schema_fingerprint(schema: T.StructType, among: tuple[str, ...] | None = None) -> Column:
    """XXH64 of the field paths, with types, that a row fills; only those among the given ones."""
    found = [F.when(there, F.lit(f"{path}:{kind}")) for path, kind, there in field_paths(schema) if among is None or path in among]
    paths = F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
    return F.xxhash64(F.array_join(paths, "\n"))


def accepted(layout: dict) -> list[int]:
    """The fingerprints that select a layout."""
    kind = lambda p: f"{p}:{'bigint' if p == 'turn' else 'string'}"
    filled = [(*layout["must"], *some) for n in range(len(layout["may"]) + 1) for some in itertools.combinations(layout["may"], n)]
    return [fingerprint_of([kind(p) for p in paths]) for paths in filled if "any" not in layout or set(layout["any"]) & set(paths)]


def _turns(layout: dict, schema: T.StructType) -> Column:
    """The turns of a row in this layout, as an array of (turn, role, text)."""
    kinds = {p: k for p, k, _ in field_paths(schema)}

    def get(path: str, kind: str = "string") -> Column:
        return F.col(f"`{path}`").cast(kind) if kinds.get(path) == kind else F.lit(None).cast(kind)

    def turn(at: Column, role: Column, text: Column) -> Column:
        return F.struct(at.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if "row" in layout:
        at, role, text = layout["row"]
        return F.array(turn(get(at, "bigint"), get(role), get(text)))
    if "array" in layout:
        name, role, text = layout["array"]
        if not kinds.get(f"{name}[].{role}") == kinds.get(f"{name}[].{text}") == "string":
            return F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
        known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        named = lambda m: F.coalesce(known[F.coalesce(m[role], F.lit(""))], m[role]) if name == "conversations" else m[role]
        return F.transform(F.col(name), lambda m, i: turn(i, named(m), m[text]))
    parts = [F.when(F.coalesce(*[get(p) for p in paths]).isNotNull(), turn(F.lit(i), F.lit(role), F.concat_ws("\n", *[get(p) for p in paths]))) for i, (role, paths) in enumerate(layout["turns"])]
    return F.array_compact(F.array(*parts))


def canonical_turns(df: DataFrame, key: str) -> DataFrame:
    """(key, layout, turn, role, text): one row per turn, and one with nulls for a record without any."""
    named, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for name, layout in reversed(LAYOUTS.items()):
        fits = schema_fingerprint(df.schema, (*layout["must"], *layout["may"])).isin(accepted(layout))
        named, turns = F.when(fits, F.lit(name)).otherwise(named), F.when(fits, _turns(layout, df.schema)).otherwise(turns)
    rows = df.select(F.col(key), named.alias("layout"), F.explode_outer(turns).alias("t"))
    return rows.select(key, "layout", "t.turn", "t.role", "t.text")


def format_turns(turns: DataFrame, key: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(key, formatted, turns): the text, and per turn where it starts, where its text starts and ends, and whether it bears loss.

    Positions count code points. The loss mask is the union of [text_start, text_end) of the turns with loss.
    """
    rows = turns.select(key, "turn", "role", "text", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("x"))
    rows = rows.withColumn("segment", F.concat(F.lit(START), "r", F.lit(SEP), "x", F.lit(END + "\n")))
    before = Window.partitionBy(key).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    text_start = F.col("start") + len(START) + F.length("r") + len(SEP)
    place = F.struct("start", text_start.alias("text_start"), (text_start + F.length("x")).alias("text_end"), F.col("role").isin(*trained).alias("loss"), "segment")
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), place))).alias("all"))
    return whole.select(
        key,
        F.array_join(F.transform("all", lambda s: s["segment"]), "").alias("formatted"),
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["text_start"].alias("text_start"), s["text_end"].alias("text_end"), s["loss"].alias("loss"))).alias("turns"),
    )


def parsed_turns(formatted: DataFrame, key: str) -> DataFrame:
    """(key, formatted, parsed): role, text and loss of each turn, cut out of the formatted text by its marks and the mask."""

    def cut(segment: Column, place: Column) -> Column:
        text = F.substring(segment, (place["text_start"] - place["start"] - len(START) + 1).cast("int"), (place["text_end"] - place["text_start"]).cast("int"))
        return F.struct(unescape(F.substring_index(segment, SEP, 1)).alias("role"), unescape(text).alias("text"), place["loss"].alias("loss"))

    segments = F.split("formatted", rf"\Q{START}\E", -1)
    parsed = F.transform(F.slice(segments, F.lit(2), F.size("turns")), lambda s, i: cut(s, F.col("turns")[i]))
    return formatted.select(key, "formatted", F.when(F.size("turns") > 0, parsed).otherwise(F.array().cast("array<struct<role:string,text:string,loss:boolean>>")).alias("parsed"))


def turn_digests(formatted: DataFrame, key: str) -> DataFrame:
    rows = parsed_turns(formatted, key)
    every = F.array_join(F.transform("parsed", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parsed", lambda p: p["loss"]), lambda p: p["text"]), "")
    rows = rows.select(key, F.size("parsed").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), loss.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select(key, "n_turns", "turns_sha256", F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
