"""Token files and BPE against the tokenizers library."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sourcesieve.llm import bpe, token_files
from sourcesieve.llm.bpe import WordBpe
from sourcesieve.llm.shared import shared_dir
from sourcesieve.llm.token_files import LibraryPieces

ODD = [
    "", " ", "the the\nThe", "a<|endoftext|>B <|ENDOFTEXT|>", "<|startoftext|><|endoftext|>", "aaaaaaa aaaa", "don't I'LL 're '''s",
    "İΣΑΣ ς Σ", "é é Ω ﬁ", "１２3 ½ ² ٣ 你好。😀👨‍👩‍👧", "a\x1cb\x1d \x85 x　y", "x" * 5000, "\x00\x7f", "<|endoftext", "ǅ ŉ ẞ ạ̈",
]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def own(vocabulary):
    return WordBpe(vocabulary)


@pytest.fixture(scope="module")
def pieces(vocabulary):
    return LibraryPieces(vocabulary)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_odd_texts(library, own, vocabulary):
    import pyarrow as pa

    want = [ids(library, t) for t in ODD]
    assert [x.tolist() for x in own.encode(ODD)] == want
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    edges, found = LibraryPieces(vocabulary).ids(pa.array(ODD))
    assert [found[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF), max_size=30), max_size=5))
def test_any_texts(library, own, texts):
    assert [x.tolist() for x in own.encode(texts)] == [ids(library, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZsT09éÉß×÷ÿĀΣİǰJK.,!'<>|=&_ \u0301\u0338\u030c\u00a0\x1c"), max_size=14), st.sampled_from(["Word.", "word", "l'a,,", "<|endoftext|>.", "É!", "×!", "x'd.", "…."])), max_size=6))
def test_marks_and_case_share_what_is_known(library, own, pieces, texts):
    """Both tables, which live through all examples: units learnt from one piece serve another."""
    import pyarrow as pa

    want = [ids(library, t or "") for t in texts]
    for table in (own, pieces):
        edges, found = table.ids(pa.array(texts, pa.string()))
        assert [found[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


def test_units():
    import pyarrow as pa

    from sourcesieve.llm.pieces import units

    codes, counts, known = units(pa.array(["Ab.", "ab", "é,,", "÷,,", "...", "a'.", "A<.", "x", "…!"]).slice(0, 9))
    assert counts.tolist() == [2, 1, 2, 1, 1, 1, 1, 1, 1]
    assert known.take(pa.array(codes)).to_pylist() == ["ab", ".", "ab", "é", ",,", "÷,,", "...", "a'.", "A<.", "x", "…!"]
    assert [len(x) for x in units(pa.array([], pa.string()))] == [0, 0, 0]


def test_small_cache_gives_the_same(library, vocabulary):
    tiny = WordBpe(vocabulary, size=2)
    for _ in range(3):
        assert [x.tolist() for x in tiny.encode(ODD)] == [ids(library, t) for t in ODD]


def test_one_merge_at_a_time_gives_the_same(library, vocabulary):
    slow = WordBpe(vocabulary)
    slow.single = True
    assert [x.tolist() for x in slow.encode(ODD)] == [ids(library, t) for t in ODD]


def rows(spark):
    long = "word " * 30_000
    data = [(5, "b b", 1), (3, None, 2), (9, "", 3), (None, "no id", 4), (3, "again", 5), (3, "again", 5), (7, long, 6)]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens int")


def test_columns_and_round_trip(spark, library, vocabulary):
    encoded = bpe.encode_column(rows(spark), vocabulary)
    both = bpe.decode_column(encoded, vocabulary).collect()
    assert len(both) == 7 and encoded.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    for r in both:
        assert r.token_ids == ids(library, r.text or "") and r.decoded == library.decode(r.token_ids, skip_special_tokens=False)
    assert bpe.encode_column(rows(spark).limit(0), vocabulary).count() == 0
    assert bpe.digests(rows(spark).limit(0), vocabulary).count() == 0


def test_token_files(spark, library, vocabulary):
    path = shared_dir(spark, "t")
    token_files.write_tokens(rows(spark).repartition(3), path, vocabulary, end_id=2)
    table = token_files.read_tokens(spark, path)
    found = token_files.with_start(spark, path, token_files.crc_column(table)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 3, 3, 3, 5, 7, 9]
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    texts = {5: "b b", 9: "", 7: "word " * 30_000, None: "no id"}
    for r in found:
        if r.doc_id != 3:
            want = [*ids(library, texts[r.doc_id]), 2]
            assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
    assert sorted(r.n_tokens for r in found if r.doc_id == 3) == [1, 2, 2]
    # selective reads: a metadata read doesn't touch the ids, and a key reaches the scan
    plan = table.filter("doc_id = 9").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,9)" in plan and "tokens:array" not in plan


def test_token_files_hold_dictionaries_and_page_indexes(spark, vocabulary):
    import pyarrow.parquet as pq

    path = shared_dir(spark, "t")
    token_files.write_tokens(rows(spark), path, vocabulary)
    files = list(__import__("pathlib").Path(path.removeprefix("file://")).glob("*.parquet"))
    chunk = pq.ParquetFile(files[0]).metadata.row_group(0)
    ids_chunk = next(chunk.column(i) for i in range(chunk.num_columns) if chunk.column(i).path_in_schema.startswith("tokens"))
    assert any("DICTIONARY" in e for e in ids_chunk.encodings) and ids_chunk.has_column_index and ids_chunk.has_offset_index


def test_no_rows(spark, vocabulary):
    path = shared_dir(spark, "t")
    token_files.write_tokens(rows(spark).limit(0), path, vocabulary)
    table = token_files.read_tokens(spark, path)
    assert token_files.with_start(spark, path, token_files.crc_column(table)).collect() == []
