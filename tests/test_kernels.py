from __future__ import annotations

import naive
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.functions.alignment import align_block, align_pairs, compare_pairs, homopolymers
from readloom.functions.poisson import abundance_pvalue, gamma_parts, pvalue_ladder
from readloom.operators.errmodel import error_rates

CASES = [
    ("ACTG", "ACTG", None, -1, 20, "ACTG", "ACTG"),
    ("ACTG", "AAACTG", None, -1, 20, "--ACTG", "AAACTG"),
    ("CTGAAAAACTG", "CTGAAACTG", None, -1, 29, None, None),
    ("CTGAAAAACTG", "CTGAAACTG", -2, -1, 41, None, None),
    ("A", "C", None, -1, 0, "-A", "C-"),
    ("A", "C", None, 0, -4, "A", "C"),
    ("", "ACG", None, -1, 0, "---", "ACG"),
    ("", "", None, -1, 0, "", ""),
]


@pytest.mark.parametrize(("s1", "s2", "homo", "band", "score", "x", "y"), CASES)
def test_known_alignments(s1, s2, homo, band, score, x, y):
    got = align_pairs([(s1, s2)], 5, -4, -8, homo, band)[0]
    assert got[0] == score
    if x is not None:
        assert got[1:] == (x, y)


@settings(max_examples=300, deadline=None)
@given(st.text("ACGTN", max_size=14), st.text("ACG", max_size=14), st.sampled_from([None, -2]), st.sampled_from([-1, 0, 1, 3, 16]))
def test_alignment_is_that_of_the_plain_recursion(s1, s2, homo, band):
    assert align_pairs([(s1, s2)], 5, -4, -8, homo, band)[0] == naive.align(s1, s2, 5, -4, -8, homo, band)


@pytest.mark.parametrize("history", [1 << 12, 1 << 27])
@pytest.mark.parametrize("band", [-1, 16])
def test_lengths_mix_in_a_block_and_no_matrix_is_filled(monkeypatch, history, band):
    def filled(*_):
        raise AssertionError("the whole matrix of a pair")

    monkeypatch.setattr("readloom.functions.antidiagonal.HISTORY", history)
    rng = np.random.default_rng(5)
    text = lambda k: "".join(rng.choice(list("ACGT"), k))
    center = text(60)
    pairs = [(center, x) for x in (text(1), center, center[20:] + text(30), text(90) + center, text(240), center[:30] + "AAAAAA" + center[30:], text(17))]
    want = [naive.align(a, b, 5, -4, -8, -2, band) for a, b in pairs]
    monkeypatch.setattr("readloom.functions.alignment.align_block", filled)
    assert align_pairs(pairs, 5, -4, -8, -2, band) == want


def test_scores_below_that_of_cells_beside_the_band():
    rng = np.random.default_rng(6)
    near = "".join(rng.choice(list("ACGT"), 2600))
    pairs = [("A" * 2600, "C" * 2600), (near, near[5:] + "ACGTA")]
    raw = [tuple(np.frombuffer(x.encode(), np.uint8)[None] for x in pair) for pair in pairs]
    assert [s for s, _, _ in align_pairs(pairs, 5, -4, -8, -2, 16)] == [int(align_block(a, b, 5, -4, -8, -2, 16)[0][0]) for a, b in raw]


def test_blocks_mix_shapes():
    pairs = [("ACGT", "ACG"), ("AAA", "AAA"), ("ACGT", "AGG"), ("", "A")]
    assert align_pairs(pairs, 5, -4, -8, -2, 16) == [naive.align(a, b, 5, -4, -8, -2, 16) for a, b in pairs]


def test_homopolymers():
    assert homopolymers(np.frombuffer(b"AAACCCGGT", np.uint8)[None])[0].tolist() == [True] * 6 + [False] * 3
    assert not homopolymers(np.frombuffer(b"AA", np.uint8)[None]).any()
    assert homopolymers(np.frombuffer(b"NNN", np.uint8)[None]).all()


def test_error_rates():
    r = error_rates(40)
    assert r.shape == (16, 41)
    assert np.allclose(r.reshape(4, 4, 41).sum(axis=1), 1)
    assert r[0, 0] == r[0, 1] == 0.25
    assert r[1, 40] == pytest.approx(1e-4 / 3)


def lam(center, raw, quals, use_quals=True):
    a, b = compare_pairs([(center, raw)], [quals], error_rates(40), 5, -4, -8, -2, 16, use_quals)
    return a[0], b[0]


def test_likelihood():
    seq = "ACGTACGTACGTACGTACGTACGTACGTACGT"
    other = "ACGTACGTACGTACGAACGTACGTACGTACGT"
    good = error_rates(40)[0, 40]
    assert lam(seq, seq, [40] * 32) == (pytest.approx(good**32), 0)
    value, h = lam(seq, other, [40] * 32)
    assert h == 1
    assert value == pytest.approx(good**31 * 1e-4 / 3)
    assert lam(seq, seq, [93] * 32)[0] == pytest.approx(good**32)  # past the last column
    assert lam(seq, seq, [40] * 32, use_quals=False)[0] == pytest.approx(0.25**32)
    # N is read as A but differs from it
    value, h = lam(seq, "N" + seq[1:], [40] * 32)
    assert h in (0, 1)
    assert value > 0
    # an inserted base counts as read right, a missing one is skipped
    assert lam(seq, seq[:16] + seq[17:], [40] * 31)[0] <= 1


def test_likelihood_vanishes():
    seq = "ACGT" * 40
    other = seq.translate(str.maketrans("ACGT", "CGTA"))
    moves = np.ones((1, 160), np.uint8)
    from readloom.functions.alignment import likelihood_block

    a, b = (np.frombuffer(s.encode(), np.uint8)[None] for s in (seq, other))
    value, h = likelihood_block(a, b, moves, np.full((1, 160), 40), error_rates(40))
    assert value[0] == 0
    assert h[0] == 160


@pytest.mark.parametrize(("n", "mean"), [(1, 0.1), (5, 2.0), (10, 20.0), (200, 190.0), (30, 5.0)])
def test_poisson_tail(n, mean):
    assert abundance_pvalue([n], [mean], [True])[0] == pytest.approx(1 - naive.poisson_cdf(n - 1, mean), abs=1e-12)
    low, high = gamma_parts(np.array([float(n)]), np.array([mean]))
    assert low[0] + high[0] == pytest.approx(1)


def test_tail_rules():
    assert abundance_pvalue([3], [3e-9], [False])[0] == 0  # one minus the distribution function has no such small values
    assert abundance_pvalue([3], [3e-9], [True], "stable")[0] == pytest.approx(4.5e-27, rel=1e-6)
    assert abundance_pvalue([2], [3e-9], [False], "stable")[0] == pytest.approx(1.5e-9, rel=1e-3)
    assert abundance_pvalue([0, 5], [1.0, 0.0], [False, False]).tolist() == [1, 1]
    assert abundance_pvalue([400_000], [380_000.0], [False])[0] < 1e-12


def test_ladder():
    p = pvalue_ladder([5, 1, 5, 5, 1], [False, True, True, True, True], [0.1, 0.1, 0.1, 0.0, 0.1], [1, 1, 0, 1, 1], 10, [False, False, False, False, True])
    assert p[:4].tolist() == [1, 1, 1, 0]
    assert p[4] == pytest.approx(1 - naive.poisson_cdf(0, 1.0))


def test_tails_settle_in_few_steps(monkeypatch):
    from readloom.functions import poisson

    monkeypatch.setattr(poisson, "MOST_STEPS", 1000)
    n = np.array([1, 2, 3, 17, 150, 900, 5000, 20_000, 377_368], float)
    for scale in (1e-6, 1e-3, 0.2, 0.9, 0.9999, 1.0001, 1.1, 2, 30):
        near = n <= 5000 if 0.9 <= scale <= 1.1 else n > 0
        low, high = gamma_parts(n[near], n[near] * scale)
        assert np.all((low >= 0) & (high >= 0) & (np.abs(low + high - 1) < 1e-12))
    monkeypatch.setattr(poisson, "MOST_STEPS", 3)
    with pytest.raises(ArithmeticError):
        gamma_parts(np.array([50.0]), np.array([49.0]))
    with pytest.raises(ArithmeticError):
        gamma_parts(np.array([50.0]), np.array([60.0]))
