r"""Media columns: what bytes are, found by their signatures, and not by what a column declares.

One Aho-Corasick automaton holds the magic bytes of all kinds and passes over a value once. At each hit the kind's validator
follows the format's own structure (chunks, segments, blocks, declared lengths, checksums where there are) and gives the end of
the valid object, or rejects the hit. A valid object at the start gives the detected kind; valid objects further inside, outside
of objects already found, are carved. Kinds without an end of their own (FLAC, streamed Matroska) last until the next object.

Texts go into media as 8-bit grey PNG images of 64 columns: lossless, with checksums.

Edge cases: a null value is an empty one; empty, cut and unknown values have kind null and no objects; a null declared type counts
as wrong if a kind is found; overlapping hits go to the earlier, then the longer; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourcesieve.llm.pieces import blocks

WIDTH = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


class Bytes:
    """A value under search. What find() has passed over isn't passed over again by searches from later places."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)
        self.known: dict[bytes, tuple[int, int]] = {}

    def find(self, what: bytes, at: int) -> int:
        """The first place of what from at on; the size where there is none."""
        begin, found = self.known.get(what, (0, -1))
        if not begin <= at <= found:
            found = self.data.find(what, at)
            self.known[what] = at, (found := self.size if found < 0 else found)
        return found

    def number(self, at: int, n: int, order: str = "big") -> int:
        return int.from_bytes(self.data[at : at + n], order)


#: A validator gives the end of the valid object at a place, or 0; OPEN says that it lasts as long as nothing else begins.
Validator = Callable[[Bytes, int], int]
OPEN = -1


def png_end(v: Bytes, start: int) -> int:
    """Chunks in order from IHDR to IEND, each with a right checksum."""
    at, first, view = start + 8, True, memoryview(v.data)
    while at + 12 <= v.size:
        n, kind = v.number(at, 4), v.data[at + 4 : at + 8]
        end = at + 12 + n
        if end > v.size or first != (kind == b"IHDR") or (first and n != 13):
            return 0
        if zlib.crc32(view[at + 4 : end - 4]) != v.number(end - 4, 4):
            return 0
        if kind == b"IEND":
            return end
        at, first = end, False
    return 0


def gif_end(v: Bytes, start: int) -> int:
    data = v.data

    def past_palette(at: int, flags: int) -> int:
        return at + (3 * 2 ** ((flags & 7) + 1) if flags & 0x80 else 0)

    def past_blocks(at: int) -> int:
        while at < v.size and data[at]:
            at += data[at] + 1
        return at + 1

    if start + 14 > v.size:
        return 0
    at = past_palette(start + 13, data[start + 10])
    while at < v.size:
        if data[at] == 0x3B:
            return at + 1
        if data[at] == 0x21:
            at = past_blocks(at + 2)
        elif data[at] == 0x2C and at + 10 < v.size:
            at = past_blocks(past_palette(at + 10, data[at + 9]) + 1)
        else:
            return 0
    return 0


def jpeg_end(v: Bytes, start: int) -> int:
    """Segments up to a scan, then entropy-coded data up to the end marker."""
    data, at, frame = v.data, start + 2, False
    while at + 4 <= v.size and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return at + 2 if frame else 0
        n = v.number(at + 2, 2)
        if marker < 0xC0 or 0xD0 <= marker <= 0xD8 or n < 2:
            return 0
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if marker == 0xDA:
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < v.size and (not data[at + 1] or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return 0
    return at + 2 if frame and data[at : at + 2] == b"\xff\xd9" else 0


def riff_end(kind: bytes, first: bytes) -> Validator:
    def end_of(v: Bytes, start: int) -> int:
        end = start + 8 + v.number(start + 4, 4, "little")
        if not start + 20 <= end <= v.size or v.data[start + 8 : start + 12] != kind or not v.data.startswith(first, start + 12):
            return 0
        at = start + 12
        while at + 8 <= end:
            n = v.number(at + 4, 4, "little")
            at += 8 + n + n % 2
        return end if at in (end, end + 1) else 0

    return end_of


def bmp_end(v: Bytes, start: int) -> int:
    if start + 54 > v.size:
        return 0
    size, _, pixels, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", v.data, start + 2)
    ok = head in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and height and 14 + head <= pixels <= size <= v.size - start
    return start + size if ok and pixels + (width * depth + 31) // 32 * 4 * abs(height) <= size + 3 else 0


def zip_end(v: Bytes, start: int) -> int:
    """The first end record whose directory stands where it says."""
    at = v.find(b"PK\x05\x06", start)
    while at + 22 <= v.size:
        size, directory, note = struct.unpack_from("<IIH", v.data, at + 12)
        if start + directory + size == at and at + 22 + note <= v.size and (not size or v.data.startswith(b"PK\x01\x02", start + directory)):
            return at + 22 + note
        if directory + size <= at - start:
            return 0  # an archive that begins later
        at = v.find(b"PK\x05\x06", at + 1)
    return 0


def gzip_end(v: Bytes, start: int) -> int:
    """One member; its checksum and size are looked at by the decoder, whose output is thrown away a part at a time."""
    head = v.data[start + 2 : start + 10]
    if start + 18 > v.size or head[0] != 8 or head[1] & 0xE0 or head[6] not in (0, 2, 4) or 13 < head[7] < 255:
        return 0
    engine, at, view = zlib.decompressobj(wbits=31), start, memoryview(v.data)
    try:
        while not engine.eof:
            part = engine.unconsumed_tail or view[at : at + 65536]
            at += 0 if engine.unconsumed_tail else len(part)
            if not engine.decompress(part, 1 << 20) and not len(part):
                return 0  # neither input nor output is left
    except zlib.error:
        return 0
    return at - len(engine.unused_data)


def pdf_end(v: Bytes, start: int) -> int:
    """The last end mark that a cross-reference stands before; revisions are appended, so each has one of its own."""
    end = 0
    at = start if v.data[start + 5 : start + 6].isdigit() and v.data[start + 6 : start + 7] == b"." else v.size
    while at < v.size:
        mark = v.find(b"%%EOF", at)
        if mark == v.size or v.find(b"startxref", at) > mark or v.find(b"%PDF-", at + (at == start)) < mark:
            break
        end = at = mark + 5
    return end


def flac_end(v: Bytes, start: int) -> int:
    """Metadata blocks, then a frame; frames have no length."""
    at, first = start + 4, True
    while at + 4 <= v.size:
        head, n = v.data[at], v.number(at + 1, 3)
        if (head & 0x7F) == 127 or (first and (head & 0x7F or n != 34)):
            return 0
        at, first = at + 4 + n, False
        if head & 0x80:
            return OPEN if at + 2 <= v.size and v.data[at] == 0xFF and v.data[at + 1] & 0xFC == 0xF8 else 0
    return 0


def ogg_end(v: Bytes, start: int) -> int:
    """Pages that are whole."""
    end = at = start
    while at + 27 <= v.size and v.data.startswith(b"OggS\0", at):
        n = v.data[at + 26]
        at += 27 + n + sum(v.data[at + 27 : at + 27 + n])
        end = at if at <= v.size else end
    return end if end > start else 0


def boxes_end(brands: tuple[bytes, ...]) -> Validator:
    """ISO base media: boxes from ftyp on, its brand one of brands (or any that no other kind names)."""

    def end_of(v: Bytes, start: int) -> int:
        brand = v.data[start + 8 : start + 12]
        if not 16 <= v.number(start, 4) <= 1024 or (brand not in brands if brands else brand in NAMED_BRANDS):
            return 0
        end = at = start
        kinds = set()
        while at + 8 <= v.size and v.data[at + 4 : at + 8].isalnum():
            n = v.number(at, 4)
            n = v.number(at + 8, 8) if n == 1 else v.size - at if n == 0 else n
            if n < 8 or at + n > v.size:
                break
            kinds.add(v.data[at + 4 : at + 8])
            end = at = at + n
        return end if kinds & {b"moov", b"mdat", b"meta"} else 0

    return end_of


def tiff_end(order: str) -> Validator:
    """Directories, the values that they point to, and strips or tiles of pixels."""
    # Bytes of each type of value, and tags of the places and sizes of strips and of tiles.
    size_of = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    pixels = ((273, 279), (324, 325))

    def end_of(v: Bytes, start: int) -> int:
        at, end, seen = v.number(start + 4, 4, order), 0, set()
        while at and at not in seen:
            seen.add(at)
            n = v.number(start + at, 2, order)
            if at < 8 or not n or start + at + 6 + 12 * n > v.size:
                return 0
            end = max(end, at + 6 + 12 * n)
            values = {}
            for i in range(start + at + 2, start + at + 2 + 12 * n, 12):
                tag, kind, count = v.number(i, 2, order), v.number(i + 2, 2, order), v.number(i + 4, 4, order)
                width = size_of.get(kind, 0)
                place = v.number(i + 8, 4, order) if width * count > 4 else i + 8 - start
                if not width or start + place + width * count > v.size:
                    return 0
                end = max(end, place + width * count)
                if tag in (273, 279, 324, 325):
                    values[tag] = [v.number(start + place + width * j, width, order) for j in range(count)]
            for places, sizes in pixels:
                end = max([end, *[a + b for a, b in zip(values.get(places, ()), values.get(sizes, ()), strict=False)]])
            at = v.number(start + at + 2 + 12 * n, 4, order)
        return start + end if 8 < end <= v.size - start else 0

    return end_of


def mp3_end(v: Bytes, start: int) -> int:
    """An ID3 tag, if there is one, and frames of MPEG layer 3: one after a tag, else three."""
    # Kilobits a second of MPEG 1 and of MPEG 2, and samples a second of MPEG 1.
    rates = ((32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
    samples = (44100, 48000, 32000)
    at, least, n = start, 3, 0
    if v.data.startswith(b"ID3", start):
        parts = v.data[start + 6 : start + 10]
        if len(parts) < 4 or max(parts) > 127:
            return 0
        at, least = start + 10 + (parts[0] << 21 | parts[1] << 14 | parts[2] << 7 | parts[3]), 1
    while at + 4 <= v.size and v.data[at] == 0xFF and v.data[at + 1] & 0xE6 == 0xE2:
        version, rate, sample, padding = v.data[at + 1] >> 3 & 3, v.data[at + 2] >> 4, v.data[at + 2] >> 2 & 3, v.data[at + 2] >> 1 & 1
        if version == 1 or not 0 < rate < 15 or sample == 3:
            break
        size = (144 if version == 3 else 72) * rates[version != 3][rate - 1] * 1000 // (samples[sample] >> {3: 0, 2: 1, 0: 2}[version]) + padding
        if at + size > v.size:
            break
        at, n = at + size, n + 1
    return at if n >= least else 0


def matroska_end(v: Bytes, start: int) -> int:
    """The EBML header and a segment; a segment of unknown size lasts."""

    def size_at(at: int) -> tuple[int, int]:
        """(size or -1 where unknown, where data begins)"""
        head = v.data[at] if at < v.size else 0
        width = 9 - head.bit_length()
        if width > 8:
            return 0, v.size + 1
        value = v.number(at, width) & (1 << 7 * width) - 1
        return -1 if value == (1 << 7 * width) - 1 else value, at + width

    n, at = size_at(start + 4)
    at += max(n, 0)
    if n < 0 or not v.data.startswith(b"\x18\x53\x80\x67", at):
        return 0
    n, at = size_at(at + 4)
    return OPEN if n < 0 else at + n if at + n <= v.size else 0


# Brands of ISO base media that name a kind of their own.
HEIC, AVIF, QUICKTIME, M4A = (b"heic", b"heix", b"mif1"), (b"avif", b"avis"), (b"qt  ",), (b"M4A ", b"M4B ")
NAMED_BRANDS = frozenset({*HEIC, *AVIF, *QUICKTIME, *M4A})
#: Magic bytes of each kind, how far from an object's start they stand, and its validator.
KINDS: tuple[tuple[str, bytes, int, Validator], ...] = (
    ("image/png", PNG_MAGIC, 0, png_end),
    ("image/gif", b"GIF87a", 0, gif_end),
    ("image/gif", b"GIF89a", 0, gif_end),
    ("image/jpeg", b"\xff\xd8\xff", 0, jpeg_end),
    ("image/webp", b"RIFF", 0, riff_end(b"WEBP", b"VP8")),
    ("image/bmp", b"BM", 0, bmp_end),
    ("image/tiff", b"II*\0", 0, tiff_end("little")),
    ("image/tiff", b"MM\0*", 0, tiff_end("big")),
    ("image/heic", b"ftyp", 4, boxes_end(HEIC)),
    ("image/avif", b"ftyp", 4, boxes_end(AVIF)),
    ("video/quicktime", b"ftyp", 4, boxes_end(QUICKTIME)),
    ("audio/mp4", b"ftyp", 4, boxes_end(M4A)),
    ("video/mp4", b"ftyp", 4, boxes_end(())),
    ("video/x-matroska", b"\x1a\x45\xdf\xa3", 0, matroska_end),
    ("audio/wav", b"RIFF", 0, riff_end(b"WAVE", b"fmt ")),
    ("audio/mpeg", b"ID3", 0, mp3_end),
    ("audio/mpeg", b"\xff\xfb", 0, mp3_end),
    ("audio/flac", b"fLaC", 0, flac_end),
    ("audio/ogg", b"OggS", 0, ogg_end),
    ("application/zip", b"PK\x03\x04", 0, zip_end),
    ("application/gzip", b"\x1f\x8b", 0, gzip_end),
    ("application/pdf", b"%PDF-", 0, pdf_end),
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found: dict[bytes, list[int]] = {}
    for i, (_, magic, _, _) in enumerate(KINDS):
        found.setdefault(magic, []).append(i)
    out = ahocorasick.Automaton()
    for magic, kinds in found.items():
        out.add_word(magic.decode("latin-1"), (len(magic), tuple(kinds)))
    out.make_automaton()
    return out


def objects(data: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, offset, length) of the valid objects in data, none inside another. One without an end lasts until the next."""
    value = Bytes(data or b"")
    hits = sorted((end + 1 - n - KINDS[k][2], k) for end, (n, kinds) in automaton().iter(value.data.decode("latin-1")) for k in kinds)
    found: list[tuple[str, int, int]] = []
    free = 0  # where the next object may begin
    for start, same in itertools.groupby(hits, key=lambda hit: hit[0]):
        if start < free or start < 0:
            continue
        for _, k in same:
            if end := KINDS[k][3](value, start):
                if found and found[-1][2] == OPEN:
                    found[-1] = (*found[-1][:2], start - found[-1][1])
                found.append((KINDS[k][0], start, OPEN if end == OPEN else end - start))
                free = start + 1 if end == OPEN else end
                break
    if found and found[-1][2] == OPEN:
        found[-1] = (*found[-1][:2], value.size - found[-1][1])
    return found


def sniff(df: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """df with kind (the object at the start), corrected (declared is not the kind), and objects, the carved ones among them."""
    rest = df.drop("kind", "corrected", "objects")
    at, said = rest.columns.index(media), rest.columns.index(declared) if declared else None
    fields = T.StructType([*rest.schema.fields, T.StructField("kind", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("objects", OBJECTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at):
            found = [objects(x) for x in batch.column(at).to_pylist()]
            kinds = [next((k for k, start, _ in x if start == 0), None) for x in found]
            claims = batch.column(said).to_pylist() if said is not None else kinds
            extra = [pa.array(kinds, pa.string()), pa.array([k is not None and k != c for k, c in zip(kinds, claims, strict=True)]), pa.array([[{"kind": k, "start": a, "length": n} for k, a, n in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "kind", "corrected", "objects"])

    return rest.mapInArrow(run, fields)


OBJECTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """payload, a positive multiple of WIDTH bytes, as a grey image."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a grey 8-bit image without filters, interlace or palette."""
    width, height, depth, colour, _, _, interlace = struct.unpack_from(">IIBBBBB", data, 16)
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("not an 8-bit grey image without interlace")
    at, packed = 8, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    size = max(64, -(-len(data) // 64) * 64)
    return data + bytes(size - len(data)), len(data)


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, declared, media): each text's bytes, padded, as an image; the column declares no type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sizes, images = [], []
            for t in batch.column(1).to_pylist():
                payload, n = padded(t)
                sizes.append(n)
                images.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(["application/octet-stream"] * len(sizes)), pa.array(images, pa.binary())], names=[key, "n_bytes", "declared", "media"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("declared", T.StringType()), T.StructField("media", T.BinaryType())]))


def feature(kind: str | None, carved: int, samples: bytes) -> str:
    """Kind, shape, mean and deviation of the samples, their entropy, and a hash of which rows of a 9 x 8 thumbnail rise."""
    grey = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(grey, minlength=256)
    share = counts[counts > 0] / len(grey)
    total = int((counts * np.arange(256)).sum())
    square = int((counts * np.arange(256, dtype=np.int64) ** 2).sum())
    mean = total / len(grey)
    edges = np.linspace(0, len(grey), 66).astype(np.int64)
    sums = np.add.reduceat(grey.astype(np.int64), np.minimum(edges[:-1], len(grey) - 1))
    level = sums / np.maximum(np.diff(edges), 1)
    bits = int.from_bytes(np.packbits(level[1:] > level[:-1]).tobytes(), "big")
    return f"{kind};{WIDTH}x{len(grey) // WIDTH};carved={carved};mean={mean:.4f};sd={max(0.0, square / len(grey) - mean * mean) ** 0.5:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f};rise={bits:016x}"


def read_back(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per stored row: sizes and digests of the payload cut out of the media, of the media, and a feature. sniff() finds the image
    and corrects the type that the column declares, and the feature says which was corrected to which; what isn't a valid image
    fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2):
            rows = []
            for media, declared, kind, corrected, found in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if kind != "image/png":
                    raise ValueError(f"stored media isn't a valid image but {kind}")
                payload = from_png(media[: found[0]["length"]])
                said = f"{declared}>{kind}" if corrected else kind
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(said, len(found) - 1 + len(objects(payload)), payload)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[key].dataType.simpleString()
    found = sniff(stored.select(key, "n_bytes", "media", "declared"), "media", "declared")
    return found.select(key, "n_bytes", "media", "declared", "kind", "corrected", "objects").mapInArrow(run, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
