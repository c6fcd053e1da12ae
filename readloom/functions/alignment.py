"""Ends-free global alignment of many pairs at once, and the error-model likelihood along it.

A block holds pairs of one shape. Row by row, the best of diagonal and vertical moves is known for the whole block; the
horizontal moves inside a row only add costs known beforehand, so with G the running sum of those costs the row is
G + running maximum of (candidate - G). All scores are whole numbers, so the result is that of the cell-by-cell recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from readloom.functions import antidiagonal

#: Fixed value: the score of cells next to the band.
OUTSIDE = -9999
DIAGONAL, LEFT, UP = 1, 2, 3
#: Cells of a block's path matrices.
BLOCK_CELLS = 32 << 20
GAP = ord("-")


def homopolymers(x: np.ndarray) -> np.ndarray:
    """For rows of bytes: whether each stands in a run of three or more."""
    out = np.zeros(x.shape, bool)
    if x.shape[1] >= 3:
        triple = (x[:, 2:] == x[:, 1:-1]) & (x[:, 1:-1] == x[:, :-2])
        for shift in range(3):
            out[:, shift : shift + triple.shape[1]] |= triple
    return out


def align_block(a: np.ndarray, b: np.ndarray, match: int, mismatch: int, gap: int, homo_gap: int | None, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, and the moves of each pair first to last with their number. ``a`` and ``b``: rows of bytes."""
    size, n, m = len(a), a.shape[1], b.shape[1]
    extra = gap if homo_gap is None else homo_gap
    runs_a, runs_b = homopolymers(a), homopolymers(b)
    low, high = (band + max(0, n - m), band + max(0, m - n)) if band >= 0 else (n + m, n + m)
    j = np.arange(m + 1)
    across = np.where(runs_b, extra, gap).astype(np.int32)
    sums = np.zeros((size, m + 1), np.int32)
    np.cumsum(across, axis=1, out=sums[:, 1:])
    row = np.zeros((size, m + 1), np.int32)
    row[:, j > high] = OUTSIDE
    path = np.zeros((n + 1, size, m + 1), np.uint8)
    path[0, :, 1:] = LEFT
    path[1:, :, 0] = UP
    for i in range(1, n + 1):
        down = np.where(runs_a[:, i - 1], extra, gap).astype(np.int32)[:, None]
        up = row[:, 1:] + down
        up[:, -1:] = row[:, -1:]
        diagonal = row[:, :-1] + np.where(a[:, i - 1, None] == b, match, mismatch)
        outside = (j < i - low) | (j > i + high)
        best = np.zeros((size, m + 1), np.int32)
        np.maximum(up, diagonal, out=best[:, 1:])
        best[:, outside] = OUTSIDE
        cost = np.zeros_like(sums) if i == n else sums
        now = cost + np.maximum.accumulate(best - cost, axis=1)
        now[:, outside] = OUTSIDE
        inner = now[:, 1:]
        left = now[:, :-1] + (0 if i == n else across)
        path[i, :, 1:] = np.where(up == inner, UP, np.where(left == inner, LEFT, DIAGONAL))
        row = now
    moves = np.zeros((size, n + m), np.uint8)
    at_i, at_j, count = np.full(size, n), np.full(size, m), np.zeros(size, np.int64)
    rows = np.arange(size)
    for _ in range(n + m):
        going = (at_i > 0) | (at_j > 0)
        if not going.any():
            break
        move = np.where(going, path[at_i, rows, at_j], 0)
        moves[rows[going], count[going]] = move[going]
        count += going
        at_i -= (move == DIAGONAL) | (move == UP)
        at_j -= (move == DIAGONAL) | (move == LEFT)
    # The walk went from the end: turn each row around.
    order = count[:, None] - 1 - np.arange(n + m)
    turned = np.where(order >= 0, np.take_along_axis(moves, np.maximum(order, 0), axis=1), 0)
    return row[:, m], turned, count


def _sides(a: np.ndarray, b: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of each column (0 beyond the end), and the place in b of its b side."""
    take_a, take_b = (moves == DIAGONAL) | (moves == UP), (moves == DIAGONAL) | (moves == LEFT)
    place_a, place_b = np.cumsum(take_a, axis=1) - 1, np.cumsum(take_b, axis=1) - 1

    def side(x: np.ndarray, take: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not x.shape[1]:
            return np.where(moves > 0, GAP, 0).astype(np.uint8)
        return np.where(take, np.take_along_axis(x, np.clip(place, 0, x.shape[1] - 1), axis=1), np.where(moves > 0, GAP, 0)).astype(np.uint8)

    return side(a, take_a, place_a), side(b, take_b, place_b), place_b


def likelihood_block(a: np.ndarray, b: np.ndarray, moves: np.ndarray, quals: np.ndarray | None, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lambda, hamming) of each pair: the probability of reading ``b`` where ``a`` is true, and substitutions.

    Columns without a base of ``b`` are skipped, inserted bases count as read right, and anything but A, C, G, T is read
    as A. ``quals``: of ``b``; None: the first column of ``rates`` throughout. The product runs from left to right.
    """
    code = np.zeros(256, np.int64)
    for k, base in enumerate(b"ACGT"):
        code[base] = code[base + 32] = k
    side_a, side_b, place = _sides(a, b, moves)
    read = (side_b != GAP) & (side_b != 0)
    true = np.where(side_a == GAP, code[side_b], code[side_a])
    if quals is None or not b.shape[1]:
        column = np.zeros(moves.shape, np.int64)
    else:
        column = np.minimum(np.take_along_axis(quals, np.clip(place, 0, b.shape[1] - 1), axis=1), rates.shape[1] - 1)
    factor = np.where(read, rates[true * 4 + code[side_b], column], 1.0)
    out = np.ones(len(a))
    for k in range(moves.shape[1]):
        out *= factor[:, k]
    hamming = (read & (side_a != GAP) & (side_a != side_b)).sum(axis=1)
    return np.clip(out, 0.0, 1.0), hamming


def _blocks(pairs: list[tuple[bytes, bytes]]) -> Iterator[np.ndarray]:
    """Indices of pairs of one shape, in blocks."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(pairs):
        shapes.setdefault((len(x), len(y)), []).append(i)
    for (n, m), own in shapes.items():
        step = max(1, BLOCK_CELLS // ((n + 1) * (m + 1)))
        for at in range(0, len(own), step):
            yield np.array(own[at : at + step])


def _stack(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1) if texts[0] else np.zeros((len(texts), 0), np.uint8)


def align_pairs(pairs: list[tuple[str, str]], match: int, mismatch: int, gap: int, homo_gap: int | None, band: int) -> list[tuple[int, str, str]]:
    """(score, first side, second side) of each pair.

    By antidiagonals in the band; row by row where costs are too large for that, or where scores sink to ``OUTSIDE``.
    """
    raw = [(x.encode(), y.encode()) for x, y in pairs]
    out: list = [None] * len(raw)
    if antidiagonal.fits(match, mismatch, gap, homo_gap):
        by_length: dict[int, list[int]] = {}
        for i, (x, y) in enumerate(raw):
            if x and y:
                by_length.setdefault(len(x), []).append(i)
        history = np.empty(antidiagonal.HISTORY, np.uint8)
        for n, own in by_length.items():
            own.sort(key=lambda i: len(raw[i][1]))
            for start, end in antidiagonal.blocks(n, [len(raw[i][1]) for i in own], band):
                block = own[start:end]
                found = antidiagonal.Block([raw[i][0] for i in block], [raw[i][1] for i in block], match, mismatch, gap, homo_gap, band, homopolymers, history).run()
                for i, f in zip(block, found, strict=True):
                    out[i] = f
    rest = [i for i, f in enumerate(out) if f is None]
    for places in _blocks([raw[i] for i in rest]):
        own = [rest[k] for k in places]
        a, b = _stack([raw[i][0] for i in own]), _stack([raw[i][1] for i in own])
        score, moves, count = align_block(a, b, match, mismatch, gap, homo_gap, band)
        side_a, side_b, _ = _sides(a, b, moves)
        for k, i in enumerate(own):
            out[i] = (int(score[k]), side_a[k, : count[k]].tobytes().decode(), side_b[k, : count[k]].tobytes().decode())
    return out


def compare_pairs(pairs: list[tuple[str, str]], quals: list, rates: np.ndarray, match: int, mismatch: int, gap: int, homo_gap: int, band: int, use_quals: bool) -> tuple[np.ndarray, np.ndarray]:
    """(lambda, hamming) of each (center, raw) pair with the raws' qualities."""
    raw = [(x.encode(), y.encode()) for x, y in pairs]
    lam, ham = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
    for own in _blocks(raw):
        a, b = _stack([raw[i][0] for i in own]), _stack([raw[i][1] for i in own])
        _, moves, _ = align_block(a, b, match, mismatch, gap, homo_gap, band)
        q = np.stack([np.asarray(quals[i], np.int64) for i in own]) if use_quals and b.shape[1] else None
        lam[own], ham[own] = likelihood_block(a, b, moves, q, rates)
    return lam, ham
