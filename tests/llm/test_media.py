from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import media_columns as M

GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
PGM = b"P5\n4 2\n255\n" + bytes(8)


def samples_by_hand(media):
    """(type, samples, the bytes of the thumbnail or none), by the formats' fixed places and the standard library."""
    if media[:4] == b"RIFF":
        with wave.open(io.BytesIO(media)) as f:
            assert (f.getnchannels(), f.getsampwidth()) == (1, 1)
            samples = f.readframes(f.getnframes())
        last = media[44 + len(samples) :]
        return "audio/wav", samples, last[8 : 8 + int.from_bytes(last[4:8], "little")]
    if media[:2] == b"BM":
        start = int.from_bytes(media[10:14], "little")
        assert int.from_bytes(media[2:6], "little") == len(media)
        return "image/bmp", media[start:], media[54:start]
    assert media[:8] == b"\x89PNG\r\n\x1a\n"
    chunks = {kind: media[at + 4 :][: int.from_bytes(media[at - 4 : at], "big")] for kind in (b"IHDR", b"IDAT", b"thMb") if (at := media.find(kind)) > 0}
    rows = zlib.decompress(chunks[b"IDAT"])
    assert int.from_bytes(chunks[b"IHDR"][:4], "big") * 3 == 192
    return "image/png", b"".join(rows[at + 1 : at + 193] for at in range(0, len(rows), 193)), chunks.get(b"thMb", b"")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400))
def test_round_trip(text):
    raw = text.encode()
    payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
    got = M.media_row(text)
    kind, samples, inner = samples_by_hand(got.media)
    assert got.n_bytes == len(raw)
    assert got.payload == samples == payload
    assert got.true_type == kind
    if inner:
        assert {"type": "image/x-portable-graymap", "offset": got.media.rindex(inner) if kind != "image/png" else got.media.index(inner), "data": inner} in got.embedded
        assert inner[:11] == b"P5\n8 8\n255\n"
        n = len(payload) // 64
        assert list(inner[11:]) == [sum(payload[k * n : k * n + n]) // n for k in range(64)]
    assert M.media_row(text) == got
    assert got.feature.startswith(f"{got.declared}->{kind};samples={len(payload)};least={min(payload)};most={max(payload)};sum={sum(payload)};")


def test_types_are_corrected_and_media_carved():
    rows = [M.media_row(f"text {k}") for k in range(400)]
    wrong = sum(r.declared not in (r.true_type, M.OCTETS) for r in rows)
    none = sum(r.declared == M.OCTETS for r in rows)
    assert 60 < wrong < 140 and 60 < none < 140
    assert {r.true_type for r in rows} == {k for k, _ in M.WRITERS}
    assert 150 < sum(bool(r.embedded) for r in rows) < 250
    for r in rows:
        for e in r.embedded:
            assert M.true_type(e["data"]) == e["type"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"RIFF", b"BM", b"P5", b"GIF89a", b"x", b"\n1 1\n255\n", M.write_wav(b"ab"), M.write_bmp(bytes(192)), M.write_png(bytes(192), b"P5\n1 1\n9\nz")]), max_size=6))
def test_places_by_hand(parts):
    """Every place of every magic, found without the automaton."""
    value = b"".join(parts)
    wanted = [f for magic, check in M.MAGIC for at in range(len(value)) if value.startswith(magic, at) and (f := check(value, at))]
    assert M.sniff(value) == sorted(wanted, key=lambda f: (f.offset, -f.length))


@pytest.mark.parametrize(("kind", "write"), M.WRITERS)
def test_formats(kind, write):
    value = write(bytes(range(192)) * 3)
    assert M.true_type(value, "image/gif") == kind
    (found,) = [f for f in M.sniff(value) if f.offset == 0]
    assert M.read_samples(value, found) == bytes(range(192)) * 3
    assert M.true_type(value[:-1], "audio/wav") == M.OCTETS
    assert M.true_type(value + b"x") == M.OCTETS
    assert M.carve(b"RIFF" + value + b"BM tail") == [(kind, 4, value)]


def test_other_formats_and_faults():
    assert M.true_type(GIF) == "image/gif"
    assert M.true_type(PGM) == "image/x-portable-graymap"
    assert M.true_type(b"GIF89a and text") == M.OCTETS
    assert M.true_type(b"BM" * 60, "image/bmp") == M.OCTETS
    assert M.true_type(b"plain", "text/plain") == "text/plain"
    assert M.true_type(None) == M.true_type(b"") == M.OCTETS
    broken = bytearray(M.write_png(bytes(192)))
    broken[40] ^= 1
    assert M.true_type(bytes(broken)) == M.OCTETS
    assert M.carve(None) == []
    both = M.write_wav(b"abc") + GIF + PGM
    assert [(k, o) for k, o, _ in M.carve(b"--" + both)] == [("audio/wav", 2), ("image/gif", 2 + len(M.write_wav(b"abc"))), ("image/x-portable-graymap", 2 + len(M.write_wav(b"abc")) + len(GIF))]
    # a medium inside another one's samples belongs to that one
    outer = M.write_bmp((GIF + bytes(192))[:192])
    assert [f.kind for f in M.sniff(outer)] == ["image/bmp", "image/gif"]
    assert [k for k, _, _ in M.carve(b"x" + outer)] == ["image/bmp"]


def test_columns(spark):
    rows = [(1, None, "a"), (1, "", "b"), (2, "é" * 5000, "c"), (3, "RIFF BM P5\n1 1\n255\nx", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = M.media_columns(df).collect()
    assert sorted(r.n_bytes for r in got) == [0, 0, 20, 10000]
    assert len({str(tuple(r)[1:]) for r in got if not r.n_bytes}) == 1
    assert "image/x-portable-graymap" in next(r.feature for r in got if r.doc_id == 3)
    assert M.media_columns(df.limit(0)).count() == 0
    blobs = spark.createDataFrame([(GIF, "image/png"), (b"--" + GIF, "text/plain"), (None, None)], "blob binary, said string")
    found = M.sniff_column(blobs, "blob", "said").collect()
    assert [r.true_type for r in found] == ["image/gif", "text/plain", M.OCTETS]
    assert [[(e.type, e.offset, bytes(e.data)) for e in r.embedded] for r in found] == [[], [("image/gif", 2, GIF)], []]


def test_query(spark, tmp_path):
    texts = [None, "", "a" * 191, "a" * 192, "a" * 193, "é" * 400, "a" * 192]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in M.op3_media_columns(spark, str(tmp_path)).collect()}
    for d, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert tuple(got[d])[1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = M.media_row(text).media
        assert (got[d].media_bytes, got[d].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert tuple(got[3])[1:] == tuple(got[6])[1:]
