import gzip
import hashlib
import io
import math
import struct
import time
import wave
import zipfile
import zlib

import pytest

from sourcesieve.llm import media


def wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", ""))
        w.writeframes(bytes(range(64)))
    return out.getvalue()


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 50)
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04AB\xff\xc0\x00\x05abc\xff\xda\x00\x03zdata\xff\x00more\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
PDF = b"%PDF-1.4\nstuff\nstartxref\n0\n%%EOF"
FLAC = b"fLaC" + b"\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8data"
OGG = b"OggS\x00\x02" + bytes(20) + b"\x01\x05hello"
PNG = media.to_png(bytes(range(64)) * 3)
WHOLE = {"image/png": PNG, "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/wav": wav(), "application/zip": zipped(), "application/gzip": gzip.compress(b"y" * 99), "application/pdf": PDF, "audio/flac": FLAC, "audio/ogg": OGG}


def box(kind, data=b""):
    return struct.pack(">I", 8 + len(data)) + kind + data


def tiff(order):
    pack = lambda f, *x: struct.pack(order + f, *x)
    entries = [(256, 3, 1, 2), (273, 4, 1, 50), (279, 4, 1, 6)]
    return (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + pack("H", 3) + b"".join(pack("HHI", *e[:3]) + (pack("HH", e[3], 0) if e[1] == 3 else pack("I", e[3])) for e in entries) + pack("I", 0) + b"pixels"


FRAME = b"\xff\xfb\x90\x00" + bytes(413)  # 128 kbit/s at 44.1 kHz: 417 bytes
MP3 = b"ID3\x04\0\0\0\0\0\x05title" + FRAME * 2
MATROSKA = b"\x1a\x45\xdf\xa3\x84head\x18\x53\x80\x67\x85video"
MORE = {
    "video/mp4": box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", b"abc") + box(b"mdat", b"defg"),
    "image/heic": box(b"ftyp", b"heic" + bytes(4)) + box(b"meta"),
    "image/avif": box(b"ftyp", b"avif" + bytes(4)) + box(b"meta", b"x"),
    "image/tiff": tiff("<"),
    "audio/mpeg": MP3,
    "video/x-matroska": MATROSKA,
}


@pytest.mark.parametrize("kind", MORE)
def test_kinds_of_real_crawls(kind):
    data = MORE[kind]
    assert media.objects(data) == [(kind, 0, len(data))]
    assert (kind, 9, len(data)) in media.objects(b"BM GIF8 \xff" + data + b"tail")
    assert media.objects(data[:12]) == []


def test_other_forms():
    assert media.objects(tiff(">")) == [("image/tiff", 0, 56)]
    assert media.objects(FRAME * 3) == [("audio/mpeg", 0, 3 * 417)] and media.objects(FRAME * 2) == []
    lasting = b"\x1a\x45\xdf\xa3\x84head\x18\x53\x80\x67\xffvideo"
    assert media.objects(lasting + GIF) == [("video/x-matroska", 0, len(lasting)), ("image/gif", len(lasting), len(GIF))]
    assert media.objects(box(b"ftyp", b"isom" + bytes(4)) + box(b"free")) == []


def test_objects_after_one_without_an_end():
    assert media.objects(FLAC + GIF + PNG) == [("audio/flac", 0, len(FLAC)), ("image/gif", len(FLAC), len(GIF)), ("image/png", len(FLAC + GIF), len(PNG))]


def test_long_gzip_and_revised_pdf():
    zeros = gzip.compress(bytes(10_000_000))
    assert media.objects(zeros) == [("application/gzip", 0, len(zeros))]
    assert media.objects(zeros[:-5]) == []
    revised = PDF + b"\nmore\nstartxref\n9\n%%EOF"
    assert media.objects(revised) == [("application/pdf", 0, len(revised))]
    assert media.objects(PDF + b" " + revised) == [("application/pdf", 0, len(PDF)), ("application/pdf", len(PDF) + 1, len(revised))]


@pytest.mark.parametrize("part", [b"%PDF-1.4 ", b"%PDF-1.4 startxref ", b"PK\x03\x04", b"GIF89a", b"\xff\xd8\xff", b"RIFF\x10\0\0\0WAVEfmt ", b"OggS\0", b"fLaC", b"\x1f\x8b\x08\0", b"BM", b"II*\0\x08\0\0\0", b"ID3", b"\xff\xfb\x90\x00", b"\0\0\0\x10ftypisom", b"\x1a\x45\xdf\xa3\x84"])
def test_repeated_signatures_take_linear_time(part):
    begin = time.process_time()
    media.objects(part * (1_000_000 // len(part)))
    assert time.process_time() - begin < 2


@pytest.mark.parametrize("kind", WHOLE)
def test_valid_objects_are_found_and_carved(kind):
    data = WHOLE[kind]
    assert media.objects(data)[0] == (kind, 0, len(data))
    if kind != "audio/flac":  # it has no end of its own
        assert (kind, 9, len(data)) in media.objects(b"BM GIF8 \xff" + data + b"tail")


@pytest.mark.parametrize("kind", WHOLE)
def test_cut_objects_are_rejected(kind):
    data = WHOLE[kind]
    for n in range(len(data) if kind != "audio/flac" else 40):
        assert (kind, 0) not in [x[:2] for x in media.objects(data[:n])]


def test_broken_checksums_and_unknown_bytes():
    assert media.objects(PNG[:30] + b"!" + PNG[31:]) == []
    assert media.objects(b"") == media.objects(None) == media.objects(b"BM BM GIF89a PK\x03\x04 RIFF1234WAVE") == []


def test_inner_objects_of_a_found_one_are_not_carved():
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.gif", GIF)
    assert [k for k, *_ in media.objects(outer.getvalue())] == ["application/zip"]


def test_sniff_corrects_types(spark):
    data = [(1, PNG, "image/jpeg", "k"), (2, b"text", "text/plain", "k"), (3, None, None, "k"), (4, b"see " + GIF, "text/plain", "k"), (5, PNG, "image/png", "k"), (5, PNG, "image/png", "k"), (6, GIF, None, "k")]
    df = spark.createDataFrame(data, "id int, blob binary, declared string, kind string")
    got = {r.id: (r.kind, r.corrected, [tuple(o) for o in r.objects]) for r in media.sniff(df, "blob", "declared").collect()}
    assert got == {1: ("image/png", True, [("image/png", 0, len(PNG))]), 2: (None, False, []), 3: (None, False, []), 4: (None, False, [("image/gif", 4, len(GIF))]), 5: ("image/png", False, [("image/png", 0, len(PNG))]), 6: ("image/gif", True, [("image/gif", 0, len(GIF))])}
    assert media.sniff(df.limit(0), "blob").collect() == []


TEXTS = [None, "", "a", "x" * 64, "é" * 33, "long text " * 30_000, "GIF89a PK\x03\x04", "a"]


def test_texts_survive_storage(spark):
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(TEXTS)] + [(None, "no id", "m")], "doc_id long, text string, media string")
    stored = media.store(df)
    got = {r.doc_id: r for r in media.read_back(stored).collect()}
    blobs = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        want = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(blobs[i]), hashlib.sha256(blobs[i]).hexdigest())
    assert all(r.feature.startswith("application/octet-stream>image/png;64x") for r in got.values())
    assert got[2][2:] == got[7][2:] and got[0].feature == got[1].feature
    assert media.read_back(stored.limit(0)).collect() == []


def plain_feature(data):
    n, mean = len(data), sum(data) / len(data)
    sd = (sum(x * x for x in data) / n - mean * mean) ** 0.5
    entropy = -sum(data.count(x) / n * math.log2(data.count(x) / n) for x in set(data))
    edges = [int(n * i / 65) for i in range(66)]
    level = [sum(data[min(a, n - 1) : max(b, min(a, n - 1) + 1)]) / max(b - a, 1) for a, b in zip(edges, edges[1:])]
    rise = sum(1 << 63 - i for i in range(64) if level[i + 1] > level[i])
    return f";64x{n // 64};carved=0;mean={mean:.4f};sd={sd:.4f};entropy={entropy + 0.0:.4f};rise={rise:016x}"


@pytest.mark.parametrize("text", ["a", "some words of a text, " * 40, "é" * 500])
def test_feature(text):
    payload, _ = media.padded(text)
    assert media.feature("image/png", 0, payload) == "image/png" + plain_feature(payload)
