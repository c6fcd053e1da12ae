"""Recompression of word sequences: rounds that name runs and pairs of symbols by content.

A run round replaces every maximal run of one symbol by a symbol named after it and its length. A pair round splits the
alphabet in two by a bit of each name and replaces every pair of a left and a right symbol by one symbol named after the
two. Names are 64-bit functions of what they stand for, so all tasks of a round agree on them without exchanging any.

Each symbol carries its cone: the words that its making looked at. A symbol whose cone lies inside some window of words
is made wherever that window occurs, in any document; so equal windows have equal symbols with cones inside them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .base import mix

ROUNDS = ("run", "pair", "pair", "pair", "run", "pair", "pair", "pair", "pair")
_RUN, _LEFT, _RIGHT = np.uint64(0x8F14E45FCEEA167B), np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)


class Symbols(NamedTuple):
    name: np.ndarray
    #: The text that a symbol belongs to.
    owner: np.ndarray
    #: First and one past the last word of the cone; a text's edge counts as a word outside it.
    lo: np.ndarray
    hi: np.ndarray


def _edges(s: Symbols, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each symbol has a left neighbour in its text, a right one, and the cones' ends that looking there gives."""
    n = len(s.name)
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:] = s.owner[1:] == s.owner[:-1]
    right[:-1] = left[1:]
    see_lo, see_hi = first[s.owner] - 1, first[s.owner + 1] + 1
    see_lo[1:][left[1:]] = s.lo[:-1][left[1:]]
    see_hi[:-1][right[:-1]] = s.hi[1:][right[:-1]]
    return left, right, see_lo, see_hi


def run_round(s: Symbols, first: np.ndarray) -> Symbols:
    left, _, see_lo, see_hi = _edges(s, first)
    head = np.ones(len(s.name), bool)
    head[1:] = ~left[1:] | (s.name[1:] != s.name[:-1])
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(head)))
    name = np.where(length > 1, mix(s.name[at] * _RUN + length.astype(np.uint64)), s.name[at])
    lo = np.minimum(np.minimum.reduceat(s.lo, at), see_lo[at])
    hi = np.maximum(np.maximum.reduceat(s.hi, at), see_hi[at + length - 1])
    return Symbols(name, s.owner[at], lo, hi)


def pair_round(s: Symbols, first: np.ndarray, salt: int) -> Symbols:
    left, right, see_lo, see_hi = _edges(s, first)
    is_left = (mix(s.name + np.uint64(salt)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(s.name), bool)
    joins[:-1] = is_left[:-1] & ~is_left[1:] & right[:-1]
    joined = np.zeros(len(s.name), bool)
    joined[1:] = joins[:-1]
    lo = np.where(joins | joined | is_left, s.lo, np.minimum(s.lo, see_lo))
    hi = np.where(joins | joined | ~is_left, s.hi, np.maximum(s.hi, see_hi))
    name = s.name.copy()
    pair = np.flatnonzero(joins)
    name[pair] = mix(s.name[pair] * _LEFT + mix(s.name[pair + 1] + _RIGHT))
    lo[pair], hi[pair] = np.minimum(s.lo[pair], s.lo[pair + 1]), np.maximum(s.hi[pair], s.hi[pair + 1])
    stay = ~joined
    return Symbols(name[stay], s.owner[stay], lo[stay], hi[stay])


def recompress(names: np.ndarray, first: np.ndarray, rounds: tuple[str, ...] = ROUNDS) -> Symbols:
    """The symbols of texts whose words are ``names[first[i]:first[i + 1]]``, after all rounds."""
    at = np.arange(len(names))
    s = Symbols(names, np.repeat(np.arange(len(first) - 1), np.diff(first)), at, at + 1)
    for k, kind in enumerate(rounds):
        if len(s.name):
            s = run_round(s, first) if kind == "run" else pair_round(s, first, 0x1D8E4E27C47D124F * (k + 1) % (1 << 64))
    return s


def inside(s: Symbols, size: int) -> np.ndarray:
    """Symbols whose cones some window of ``size`` words holds."""
    return s.hi - s.lo <= size


def per_window(s: Symbols, which: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """For the window from each word on, how many of the chosen symbols it holds with their cones."""
    lo, hi = s.lo[which], s.hi[which]
    steps = np.bincount(np.maximum(hi - size, 0), minlength=n_words + 2) - np.bincount(lo + 1, minlength=n_words + 2)
    return np.cumsum(steps)[:n_words]
