from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_conftest import shingles, thue_morse, words

from readloom.llm import base
from readloom.llm.base import PIECE_BYTES, Words, flat, pieces, shingle_sets

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("abAÉ ß\t\n\r\x0b\x0c\x85 .,x"), max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    for lower in (False, True):
        w = Words(pa.array(texts, pa.string()), lower)
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
        wanted = [words(t, lower) for t in texts]
        assert got == [x for own in wanted for x in own]
        assert w.counts.tolist() == [len(x) for x in wanted]
        named = {}
        for name, x in zip(w.names.tolist(), [x for t in texts for x in words(t, lower)], strict=True):
            assert named.setdefault(x, name) == name
        assert len(set(named.values())) == len(named)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    names, offsets = shingle_sets(Words(pa.array(texts, pa.string()), True), 3)
    sets = [shingles(t, 3) for t in texts]
    assert [offsets[i + 1] - offsets[i] for i in range(len(texts))] == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            a, b = (set(names[offsets[k] : offsets[k + 1]].tolist()) for k in (i, j))
            assert len(a & b) == len(sets[i] & sets[j])


def test_whole_and_slices():
    column = pa.array(["zz", "a b", None, "a  b", "a b c", "ab"])
    prints = Words(column.slice(1), False).fingerprints().tolist()
    assert prints[0] == prints[2]
    assert len({tuple(p) for p in prints}) == 4
    data, offsets = flat(column.slice(1))
    assert offsets.tolist() == [0, 3, 3, 7, 12, 14]
    assert bytes(data) == b"a ba  ba b cab"


def test_words_that_polynomial_hashes_confuse_are_told_apart():
    for length in (16, 17, 1024, 2048):
        one, two = thue_morse(length)
        w = Words(pa.array([one, two, f"x{one} {one}", " ".join(one), " ".join(two)]), False)
        assert len({*w.names[:4].tolist()}) == 3  # one, two, the one with an x
        assert len({*zip(w.lo[:4].tolist(), w.hi[:4].tolist(), strict=True)}) == 3
        prints = w.fingerprints().tolist()
        assert prints[3] != prints[4]


def test_names_that_clash_are_told_apart():
    column = pa.array(["a b c a", "b b", "a", "c d a b"])
    w = Words(column, False)
    first, back = base.numbered(w.names, w.lo, w.hi)
    clash = base.numbered(np.zeros(len(w.names), np.uint64), w.lo, w.hi)
    for f, b in ((first, back), clash):
        assert len(f) == 4
        assert [bytes(w.data[w.starts[f[k]] : w.ends[f[k]]]) for k in b] == [x.encode() for t in column.to_pylist() for x in t.split()]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_exact_shingles(texts, size):
    numbers, offsets = base.exact_shingles(Words(pa.array(texts, pa.string()), True), size)
    sets = [shingles(t, size) for t in texts]
    assert np.diff(offsets).tolist() == [len(s) for s in sets]
    got = [set(numbers[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert all(len(got[i] & got[j]) == len(sets[i] & sets[j]) for i in range(len(texts)) for j in range(i))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 40))
def test_windows(letters, size):
    names = Words(pa.array([" ".join("abc"[k] for k in letters)]), False).windows(size)
    wanted = [tuple(letters[i : i + size]) for i in range(len(letters) - size + 1)]
    assert len(names) == len(wanted)
    assert len(set(zip(names.tolist(), wanted, strict=True))) == len(set(names.tolist())) == len(set(wanted))


def test_pieces():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * (PIECE_BYTES // 3)] * 5 + [None, "y" * (3 * PIECE_BYTES), "z"]})
    got = list(pieces(iter([batch, batch.slice(0, 0)])))
    assert sum(b.num_rows for b in got) == 8
    assert max(len(t or "") for b in got for t in b.column(0).to_pylist()) == 3 * PIECE_BYTES
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= PIECE_BYTES for b in got)


def test_scratch(spark):
    table = base.materialize(spark.range(5), "five")
    other = base.materialize(spark.range(6), "six")
    assert table.count() == 5
    base.discard(table)
    assert other.count() == 6
    base.clear_scratch(spark)
    base.clear_scratch(spark)
    assert base.materialize(spark.range(3), "three").count() == 3
