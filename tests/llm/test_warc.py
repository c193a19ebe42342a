import base64
import hashlib

from sourcesieve.llm import warc
from sourcesieve.llm.shared import shared_dir


def written_and_read(spark, df, least=0, **how):
    path = shared_dir(spark, "w")
    warc.write_archives(df, path, least=least)
    return path, warc.read_archives(spark, path, **how)


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, digest string, keeper int")


ROWS = [
    (1, "http://a/ b\r\nX: y%", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "d", 1),
    (2, None, "same", "d", 1), (5, "u", "same", None, 1), (4, "u", "same", None, 1),
    (6, "", None, None, None), (7, "u", "", None, None), (None, "n", "same", None, 1), (None, "n", "alone", None, 1),
    (8, "u", "x" * 300_000, None, 1), (8, "u", "x" * 300_000, None, 1), (9, "u", "\n", None, 1),
]


def test_round_trip(spark):
    path, read = written_and_read(spark, pages(spark, ROWS).repartition(3), payload=True)
    got = read.collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.record_type == "revisit" or r.declared_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    assert {r.url for r in got if r.key == "1"} == {ROWS[0][1]} and {r.payload.decode() for r in got if r.key == "1"} == {ROWS[0][2]}
    facts = [(r.key, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.payload_facts(read).collect()]
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    same, empty, long = ("same", 4, digest("same")), ("", 0, digest("")), ("", 300_000, digest("x" * 300_000))
    want = [
        ("1", "response", None, len(ROWS[0][2].encode()), digest(ROWS[0][2])), ("2", "revisit", "5", *same[1:]), ("5", "response", None, *same[1:]),
        ("4", "revisit", "5", *same[1:]), ("6", "revisit", "7", *empty[1:]), ("7", "response", None, *empty[1:]), (None, "revisit", "5", *same[1:]),
        (None, "response", None, 5, digest("alone")), ("8", "response", None, *long[1:]), ("8", "response", None, *long[1:]), ("9", "response", None, 1, digest("\n")),
    ]
    assert sorted(map(repr, facts)) == sorted(map(repr, want))


def test_archives_are_warc(spark):
    path, _ = written_and_read(spark, pages(spark, ROWS).coalesce(1))
    data = b"".join(p.read_bytes() for p in sorted(__import__("pathlib").Path(path.removeprefix("file://")).glob("part-*")))
    import io

    found = list(warc.records(warc.Lines(io.BytesIO(data), 7)))
    assert len(found) == len(ROWS)
    for head, block in found:
        assert head["warc-record-id"].startswith("<urn:uuid:") and int(head["content-length"]) == len(block)
        assert (head["warc-type"] == "revisit") == ("warc-refers-to" in head) == ("warc-profile" in head)


def test_small_payloads_stay_responses(spark):
    _, read = written_and_read(spark, pages(spark, ROWS), least=5)
    assert {r.key for r in read.filter("record_type = 'revisit'").collect()} == set()


def test_no_rows(spark):
    _, read = written_and_read(spark, pages(spark, []))
    assert warc.payload_facts(read).collect() == []


def test_repeated_ids_with_other_payloads(spark):
    data = [(1, "aaa"), (5, "aaa"), (5, "zzzzzz"), (2, "zzzzzz"), (5, "zzzzzz"), (None, "aaa"), (None, "null"), (7, None)]
    rows = [(k, "u", h, None, 1) for k, h in data]
    _, read = written_and_read(spark, pages(spark, rows).repartition(3))
    got = sorted((str(r.key), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.payload_facts(read).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keeper = {"aaa": 5, "zzzzzz": 5, "null": None, None: 7}
    want = [(str(k), "response" if k == keeper[h] else "revisit", None if k == keeper[h] else str(keeper[h]), len(h or ""), digest(h)) for k, h in data]
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(map(repr, got)) == sorted(map(repr, want))
    ids = {(r.record_id, r.key, r.declared_digest) for r in read.collect()}
    assert len({i for i, *_ in ids}) == len(ids)


def test_null_key_is_not_the_key_null(spark):
    df = spark.createDataFrame([(None, "u", "x"), ("null", "u", "x"), ("", "u", "x")], "page_id string, url string, html string")
    _, read = written_and_read(spark, df)
    assert len({r.record_id for r in read.collect()}) == 3


def test_archives_are_dealt_out_by_bytes(spark):
    df = pages(spark, [(i, "u", f"{i} " * 2000, None, 1) for i in range(64)]).repartition(8)
    _, read = written_and_read(spark, df)
    assert read.rdd.getNumPartitions() >= 4
