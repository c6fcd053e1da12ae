"""Media columns: signature sniffing over binary columns, with type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass; a validator per format then checks the
structure from there (chunk lengths, checksums, offsets) and says how long the medium is. What passes at offset 0 and
covers the whole value is the value's true type, whatever type was declared; what passes elsewhere is an embedded medium
and can be carved. Magic bytes that no validator confirms are ordinary data.

Formats: WAV (8-bit PCM and other RIFF WAVE), BMP, PNG, GIF, binary PGM. ``store`` writes a payload losslessly as 8-bit
samples in one of three of them, chosen by the payload's checksum. Every other stored form also carries a small medium of its own, a PGM thumbnail of
the samples, where its format leaves room: an extra RIFF chunk, a gap before a bitmap's pixels, a private PNG chunk. ``declared`` says what
a careless source would: the right type for half of the payloads, another one for a quarter, none for the rest.
``media_columns`` stores texts so, then corrects the types, reads the samples back and carves what is embedded from the stored bytes alone.

Edge cases: a null or empty text is the empty text, padded to one unit; equal texts give equal rows; an empty or null
value sniffs as ``application/octet-stream`` without media; truncated media and lengths that point past the end fail
validation. Other columns pass through, clashing names are replaced.

Scale: a row-wise map with no shuffle; a worker holds the payload and the stored form of one row at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, pieces, table

#: Payloads are padded with spaces to a multiple of this: 64 pixels of three samples.
UNIT, WIDTH, RATE = 192, 64, 8000
OCTETS = "application/octet-stream"


class Found(NamedTuple):
    kind: str
    offset: int
    length: int
    #: The place of the samples in the value and their number, where they are stored plainly.
    data_at: int
    data_len: int


# --- writers --------------------------------------------------------------------------------------------------------


def write_wav(samples: bytes, inner: bytes = b"") -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    form = b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)) + chunk(b"data", samples) + (chunk(b"thmb", inner) if inner else b"")
    return chunk(b"RIFF", form)


def write_bmp(samples: bytes, inner: bytes = b"") -> bytes:
    """24-bit pixels, top row first (a negative height says so): rows of 192 bytes need no padding."""
    height, start = len(samples) // UNIT, 54 + len(inner)
    head = b"BM" + struct.pack("<IHHI", start + len(samples), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, WIDTH, -height, 1, 24, 0, len(samples), 2835, 2835, 0, 0) + inner + samples


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: bytes, inner: bytes = b"") -> bytes:
    rows = b"".join(b"\0" + samples[at : at + UNIT] for at in range(0, len(samples), UNIT))
    head = struct.pack(">IIBBBBB", WIDTH, len(samples) // UNIT, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", head) + (_png_chunk(b"thMb", inner) if inner else b"") + _png_chunk(b"IDAT", zlib.compress(rows, 1)) + _png_chunk(b"IEND", b"")


def thumbnail(samples: bytes) -> bytes:
    """A binary PGM of 8 x 8: means of 64 equal stretches of the samples."""
    means = np.frombuffer(samples, np.uint8).reshape(64, -1).mean(axis=1)
    return b"P5\n8 8\n255\n" + means.astype(np.uint8).tobytes()


WRITERS = (("audio/wav", write_wav), ("image/bmp", write_bmp), ("image/png", write_png))


def store(payload: bytes) -> bytes:
    key = zlib.crc32(payload)
    return WRITERS[key % 3][1](payload, thumbnail(payload) if key // 3 % 2 else b"")


def declared(payload: bytes) -> str:
    """The type that the payload's stored form is said to have: right, right, another one, or none."""
    key = zlib.crc32(payload)
    return (WRITERS[key % 3][0], WRITERS[key % 3][0], WRITERS[(key + 1) % 3][0], OCTETS)[key // 6 % 4]


# --- validators: the medium that starts at ``at``, or None -------------------------------------------------------------


def check_wav(b: bytes, at: int) -> Found | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    form, data, pos = None, None, at + 12
    while pos + 8 <= end:
        kind, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + size > end:
            return None
        if kind == b"fmt ":
            if size < 16:
                return None
            form = struct.unpack_from("<HHIIHH", b, pos + 8)
        elif kind == b"data":
            data = (pos + 8, size)
        pos += 8 + size + (size & 1)
    if pos != end or form is None or data is None or not form[1] or form[3] != form[2] * form[4] or data[1] % form[4]:
        return None
    return Found("audio/wav", at, end - at, *data)


def check_bmp(b: bytes, at: int) -> Found | None:
    if len(b) < at + 54:
        return None
    total, r1, r2, start = struct.unpack_from("<IHHI", b, at + 2)
    size, width, height, planes, bits, packed, image = struct.unpack_from("<IiiHHII", b, at + 14)
    if r1 or r2 or size < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or not height:
        return None
    need = (width * bits + 31) // 32 * 4 * abs(height)
    if start < 14 + size or image not in (0, need) or total != start + need or at + total > len(b):
        return None
    return Found("image/bmp", at, total, at + start, need)


def check_png(b: bytes, at: int) -> Found | None:
    pos, first, seen_data = at + 8, True, False
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        end = pos + 12 + size
        if end > len(b) or zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if first != (kind == b"IHDR") or (first and size != 13):
            return None
        first, seen_data = False, seen_data or kind == b"IDAT"
        if kind == b"IEND":
            return Found("image/png", at, end - at, 0, 0) if not size and seen_data else None
        pos = end
    return None


def check_gif(b: bytes, at: int) -> Found | None:
    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    if len(b) < at + 14:
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    pos, images = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), 0
    while width and height and pos < len(b):
        if b[pos] == 0x3B:
            return Found("image/gif", at, pos + 1 - at, 0, 0) if images else None
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            own = b[pos + 9]
            pos, images = blocks(pos + 11 + (3 << ((own & 7) + 1) if own & 128 else 0)), images + 1
        else:
            return None
    return None


def check_pgm(b: bytes, at: int) -> Found | None:
    pos, numbers = at + 2, []
    for _ in range(3):
        began = pos
        while pos < min(len(b), began + 8) and b[pos] in b" \t\r\n":
            pos += 1
        digits = pos
        while pos < min(len(b), digits + 8) and 48 <= b[pos] <= 57:
            pos += 1
        if began == digits or digits == pos:
            return None
        numbers.append(int(b[digits:pos]))
    width, height, most = numbers
    end = pos + 1 + width * height
    if not (width and height and 0 < most < 256 and end <= len(b) and b[pos] in b" \t\r\n"):
        return None
    return Found("image/x-portable-graymap", at, end - at, pos + 1, width * height)


#: Fixed values of the formats: magic bytes at a medium's start.
MAGIC = (
    (b"RIFF", check_wav),
    (b"BM", check_bmp),
    (b"\x89PNG\r\n\x1a\n", check_png),
    (b"GIF87a", check_gif),
    (b"GIF89a", check_gif),
    (b"P5", check_pgm),
)


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, check in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), check))
    found.make_automaton()
    return found


def sniff(value: bytes | None) -> list[Found]:
    """All valid media, in order; a medium inside another one's bounds is reported after it."""
    out = []
    for end, (size, check) in _automaton().iter((value or b"").decode("latin-1")):
        if found := check(value, end + 1 - size):
            out.append(found)
    return sorted(out, key=lambda f: (f.offset, -f.length))


def true_type(value: bytes | None, declared: str | None = None, found: list[Found] | None = None) -> str:
    """The sniffed type of the whole value; the declared one only where it cannot be refuted (no known format claims it)."""
    if whole := whole_of(value, sniff(value) if found is None else found):
        return whole.kind
    known = {"audio/wav", "image/bmp", "image/png", "image/gif", "image/x-portable-graymap"}
    return declared if declared and declared not in known else OCTETS


def whole_of(value: bytes | None, found: list[Found]) -> Found | None:
    return next((f for f in found if f.offset == 0 and f.length == len(value)), None)


def carve(value: bytes | None, found: list[Found] | None = None) -> list[tuple[str, int, bytes]]:
    """(type, offset, bytes) of the outermost media that are not the value as a whole."""
    out, free = [], 0
    for f in sniff(value) if found is None else found:
        if (f.offset, f.length) != (0, len(value)) and f.offset >= free:
            out.append((f.kind, f.offset, value[f.offset : f.offset + f.length]))
            free = f.offset + f.length
    return out


def read_samples(value: bytes, found: Found) -> bytes:
    """The 8-bit samples of a medium."""
    if found.kind != "image/png":
        return value[found.data_at : found.data_at + found.data_len]
    pos, packed, row = found.offset + 8, [], 0
    while pos < found.offset + found.length:
        size, kind = struct.unpack_from(">I", value, pos)[0], value[pos + 4 : pos + 8]
        if kind == b"IHDR":
            width, _, depth, colours, _, how, laced = struct.unpack_from(">IIBBBBB", value, pos + 8)
            if (depth, colours, how, laced) != (8, 2, 0, 0):
                raise ValueError("only plain 8-bit RGB rows are read")
            row = 3 * width
        elif kind == b"IDAT":
            packed.append(value[pos + 8 : pos + 8 + size])
        pos += 12 + size
    rows = zlib.decompress(b"".join(packed))
    if any(rows[at] for at in range(0, len(rows), row + 1)):
        raise ValueError("only unfiltered rows are read")
    return b"".join(rows[at + 1 : at + 1 + row] for at in range(0, len(rows), row + 1))


class Stored(NamedTuple):
    """A stored text: sizes, the stored bytes, what was said of them and what they are, the samples read back, what is embedded."""

    n_bytes: int
    media: bytes
    declared: str
    true_type: str
    payload: bytes
    embedded: list[dict]
    feature: str


def media_row(text: str | None) -> Stored:
    """Store a text as a medium; correct its type, read it back and carve it from the stored bytes; describe the samples."""
    raw = (text or "").encode()
    padded = raw + b" " * (-len(raw) % UNIT if raw else UNIT)
    media, said = store(padded), declared(padded)
    found = sniff(media)
    kind = true_type(media, said, found)
    payload = read_samples(media, whole_of(media, found))
    parts = carve(media, found)
    samples = np.frombuffer(payload, np.uint8)
    inner = ",".join(f"{k}@{o}+{len(b)}:{zlib.crc32(b):08x}" for k, o, b in parts) or "none"
    feature = f"{said}->{kind};samples={len(samples)};least={samples.min()};most={samples.max()};sum={samples.sum(dtype=np.int64)};embedded={inner}"
    return Stored(len(raw), media, said, kind, payload, [{"type": k, "offset": o, "data": b} for k, o, b in parts], feature)


_EMBEDDED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("data", pa.binary())]))
_ARROW = (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.binary(), _EMBEDDED, pa.string())
_KINDS = "n_bytes long, media binary, declared string, true_type string, payload binary, embedded array<struct<type:string,offset:bigint,data:binary>>, feature string"


def _rows(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [media_row(t) for t in batch.column("text").to_pylist()]
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *Stored._fields])

    return run


def media_columns(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` and with its stored form and what was found in that (the fields of ``Stored``)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*Stored._fields)
    kept = [c for c in docs.columns if c != "text"]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), _KINDS])
    return docs.mapInArrow(_rows(kept), kinds)


def _sniffed(kept: list[str], column: str, declared: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).to_pylist()
            said = batch.column(declared).to_pylist() if declared else [None] * len(values)
            found = [sniff(v) for v in values]
            kinds = pa.array([true_type(v, d, f) for v, d, f in zip(values, said, found, strict=True)], pa.string())
            cut = pa.array([[{"type": k, "offset": o, "data": b} for k, o, b in carve(v, f)] for v, f in zip(values, found, strict=True)], _EMBEDDED)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), kinds, cut], [*kept, "true_type", "embedded"])

    return run


def sniff_column(df: DataFrame, column: str, declared: str | None = None) -> DataFrame:
    """``df`` with ``true_type`` of a binary column and the media ``embedded`` in its values."""
    bounded_batches(df.sparkSession)
    df = df.drop("true_type", "embedded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_sniffed(df.columns, column, declared), f"{kinds}, true_type string, embedded array<struct<type:string,offset:bigint,data:binary>>")


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    made = media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
