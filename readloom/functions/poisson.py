"""The upper tail of the Poisson distribution, vectorised, and the abundance p-value built on it."""

from __future__ import annotations

import math

import numpy as np

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


#: Relative change at which a sum or fraction counts as settled, and a guard that raises.
SETTLED, MOST_STEPS = 4 * np.finfo(float).eps, 10_000_000


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of x**k / (a (a + 1) ... (a + k)), which has only positive terms."""
    out = 1 / a
    term, total, at = out.copy(), out.copy(), np.arange(len(a))
    for k in range(1, MOST_STEPS):
        if not len(at):
            return out
        term = term * x / (a + k)
        total = total + term
        done = term <= total * 1e-17
        if done.any():
            out[at[done]] = total[done]
            a, x, term, total, at = (v[~done] for v in (a, x, term, total, at))
    raise ArithmeticError(f"the series did not settle in {MOST_STEPS} steps for a={a}, x={x}")


def _fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the upper function by Lentz's method; rows leave the loop as they settle."""
    out, at = np.empty(len(a)), np.arange(len(a))
    b = x + 1 - a
    c, d = np.full(len(a), 1e300), 1 / b
    h = d.copy()
    for k in range(1, MOST_STEPS):
        if not len(at):
            return out
        an = -k * (k - a)
        b = b + 2
        d, c = an * d + b, b + an / c
        d, c = (np.where(np.abs(v) < 1e-300, 1e-300, v) for v in (d, c))
        d = 1 / d
        step = d * c
        h = h * step
        done = np.abs(step - 1) <= SETTLED
        if done.any():
            out[at[done]] = h[done]
            a, b, c, d, h, at = (v[~done] for v in (a, b, c, d, h, at))
    raise ArithmeticError(f"the fraction did not settle in {MOST_STEPS} steps for a={a}")


def gamma_parts(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete gamma functions (lower, upper) for a >= 1, x > 0: a series below a + 1, else a fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lower, upper = np.zeros(a.shape), np.zeros(a.shape)
    front = np.exp(-x + a * np.log(x) - _LGAMMA(a))
    low = x < a + 1
    lower[low] = _series(a[low], x[low]) * front[low]
    upper[low] = 1 - lower[low]
    upper[~low] = _fraction(a[~low], x[~low]) * front[~low]
    lower[~low] = 1 - upper[~low]
    return np.clip(lower, 0, 1), np.clip(upper, 0, 1)


def abundance_pvalue(n: np.ndarray, expected: np.ndarray, prior: np.ndarray, method: str = "one_minus_cdf") -> np.ndarray:
    """P(at least n reads | expected), given at least one read unless there was a prior reason for the sequence.

    ``one_minus_cdf`` takes one minus the distribution function, which is 0 or at least about 1e-16; ``stable`` takes the
    tail itself.
    """
    n, expected, prior = np.broadcast_arrays(np.asarray(n, float), np.asarray(expected, float), np.asarray(prior, bool))
    out = np.ones(n.shape)
    ask = (n > 0) & (expected > 0) & np.isfinite(expected)
    if ask.any():
        tail, cdf = gamma_parts(n[ask], expected[ask])
        p = tail if method == "stable" else 1 - cdf
        e = expected[ask]
        norm = 1 - np.exp(-e)
        norm = np.where(norm < 1e-7, e - e * e / 2, norm)
        out[ask] = np.clip(np.where(prior[ask], p, p / norm), 0, 1)
    return out


def pvalue_ladder(abundance, has_comparison, lam, hamming, total_reads, prior, detect_singletons: bool = False, method: str = "one_minus_cdf") -> np.ndarray:
    """The p-value by case: nothing to compare with, a lone read, no substitution, an impossible one, else the tail."""
    abundance, lam, hamming = np.asarray(abundance), np.asarray(lam, float), np.asarray(hamming)
    sure = np.asarray(prior, bool) | detect_singletons
    one = ~np.asarray(has_comparison, bool) | ((abundance == 1) & ~sure) | (hamming == 0)
    zero = ~one & (lam == 0)
    out = np.where(one, 1.0, 0.0)
    rest = ~one & ~zero
    if rest.any():
        totals = np.broadcast_to(np.asarray(total_reads, float), abundance.shape)
        out[rest] = abundance_pvalue(abundance[rest], lam[rest] * totals[rest], sure[rest], method)
    return out
