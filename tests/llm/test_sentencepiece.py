from __future__ import annotations

import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_conftest import thue_morse

from readloom.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    with open(S.default_model(), "rb") as f:
        return S.Codec(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t▁ab<s>0x1éß日😀"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_parity(codec, text):
    (ids,) = codec.encode([text])
    assert ids == codec.theirs.encode(text)
    assert ids == codec.whole.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text.replace(S.MARK, " ") == codec.theirs.decode(ids).replace(S.MARK, " ") or text.startswith(("▁", " "))
    assert codec.decode(ids) == text.replace(S.MARK, " ")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(" \n\t▁ab<é日"), max_size=20)), max_size=6))
def test_columns_of_texts(codec, texts):
    ids, ends, agrees = codec.encode_column(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == codec.theirs.encode([t or "" for t in texts])
    assert agrees.all()
    assert codec.decode_column(ids, ends).to_pylist() == [(t or "").replace(S.MARK, " ") for t in texts]


@pytest.mark.parametrize("length", [16, 1024, 2048])
def test_words_that_polynomial_hashes_confuse(codec, length):
    one, two = thue_morse(length)
    texts = [f"{one} x {two}", f"{two} x {one}", two, one, f"{one} {one}"]
    for _ in range(2):  # the second time from memory
        ids, ends, agrees = codec.encode_column(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == codec.theirs.encode(texts)
        assert agrees.all()
        assert codec.decode_column(ids, ends).to_pylist() == texts


def test_cuts_with_one_name_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "named", lambda lo, hi: lo & S.np.uint64(1))
    with open(S.default_model(), "rb") as f:
        codec = S.Codec(f.read())
    texts = ["the cat sat on the mat", "a cat", "sat the", "the cat sat on the mat", "  mat  "]
    for _ in range(2):
        ids, ends, agrees = codec.encode_column(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == codec.theirs.encode(texts)
        assert agrees.all()


def test_disagreement_shows():
    with open(S.default_model(), "rb") as f:
        codec = S.Codec(f.read())
    codec.theirs = type("Other", (), {"encode": lambda self, x, **k: [[1]] * len(x) if isinstance(x, list) else [1, 2]})()
    assert codec.encode_column(pa.array(["a b", "", "c"]))[2].tolist() == [False, True, False]


def test_model(codec):
    m = codec.model
    assert (len(m.pieces), m.model_type, m.byte_fallback, m.unk_id) == (32000, S.BPE, True, 0)
    assert m.pieces[1][0] == "<s>" and m.pieces[1][2] == S.CONTROL
    with pytest.raises(ValueError):
        list(S._fields(b"\x0a\x05ab"))


def message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_scores_decide():
    pieces = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL), ("▁", -3.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -4.5, 1), ("ba", -5.0, 1)] + [(f"<0x{k:02X}>", -20.0, S.BYTE) for k in range(256)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, S.UNIGRAM), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    codec = S.Codec(data)
    for text in ["ab", "aab", "abba ab", "a  b", "é", "ba ba", ""]:
        (ids,) = codec.encode([text])
        assert ids == codec.theirs.encode(text), text
        assert codec.decode(ids) == text


def test_columns(spark):
    rows = [(1, None, "x"), (1, "", "y"), (2, "Hello  world\n", "z"), (2, "Hello  world\n", "u"), (3, "é" * 50000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.encode(df).collect()
    assert all(r.parity and r.round_trip for r in got)
    assert {r.doc_id: r.decoded for r in got} == {1: "", 2: "Hello  world\n", 3: "é" * 50000}
    assert sorted(len(r.ids) == 0 for r in got) == [False, False, False, True, True]
    assert S.encode(df.limit(0)).count() == 0
