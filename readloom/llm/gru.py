"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

The vocabulary is ``WORDS`` words in ``CLASSES`` classes of equal size, by frequency, and one more class for all other
words: P(w | h) = P(class | h) * P(w | class, h), where in the last class the second factor is a fixed unigram that the
caller applies. The input layer is a table with one row a word. Texts run side by side in ``STREAMS`` streams, window by
window of ``STEPS`` words; a stream's state is carried from window to window and reset where a text begins, so a text's
likelihood is that of the whole text. Gradients end at a window's first word.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

WORDS, CLASSES, HIDDEN = 2048, 32, 24
#: Streams in scoring; in training there are fewer, which gives more steps of the weights. Words of a window, and Adam's step size.
STREAMS, LEARN_STREAMS, STEPS, RATE = 256, 128, 32, 0.01
PER = WORDS // CLASSES
#: Ids: words 0 to WORDS - 1, any other word, and the begin of a text (input only).
OTHER, BEGIN = WORDS, WORDS + 1


class Params(NamedTuple):
    table: np.ndarray  # (WORDS + 2, 3 H): reset, update, candidate
    state: np.ndarray  # (H, 3 H)
    classes: np.ndarray  # (H, CLASSES + 1)
    class_bias: np.ndarray
    words: np.ndarray  # (CLASSES, H, PER)
    word_bias: np.ndarray  # (CLASSES, PER)


SHAPES = ((WORDS + 2, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, CLASSES + 1), (CLASSES + 1,), (CLASSES, HIDDEN, PER), (CLASSES, PER))


def initial(counts: np.ndarray, other: float, seed: int = 1) -> Params:
    """Small random weights; biases that give the unigram of ``counts`` (WORDS of them) and ``other``."""
    rng = np.random.default_rng(seed)
    table, state, classes, words = (rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.1, SHAPES[0]), (0.2, SHAPES[1]), (0.05, SHAPES[2]), (0.05, SHAPES[4])))
    table[:, HIDDEN : 2 * HIDDEN] += 1.0  # states are kept for long at first
    by_class = counts.reshape(CLASSES, PER).astype(float)
    class_bias = np.log(np.append(by_class.sum(axis=1), other) + 0.5)
    word_bias = np.log(by_class + 1e-3)
    return Params(table, state, classes, (class_bias - class_bias.max()).astype(np.float32), words, (word_bias - word_bias.max(axis=1, keepdims=True)).astype(np.float32))


def pack(params: Params) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params]).astype(np.float32)


def unpack(flat: np.ndarray) -> Params:
    out, at = [], 0
    for shape in SHAPES:
        size = int(np.prod(shape))
        out.append(np.array(flat[at : at + size], np.float32).reshape(shape))
        at += size
    return Params(*out)


class Streams:
    """Texts dealt to streams, longest first, each to the shortest stream; the longest stream comes first."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, most: int = STREAMS):
        """``ids[first[i]:first[i + 1]]``: the tokens of text i, its end token last."""
        lengths = np.diff(first)
        # No more streams than the longest text leaves full: the rest would wait for it, in memory too.
        full = -(-int(lengths.sum()) // max(1, int(lengths.max(initial=0))))
        heap = [(0, k) for k in range(min(most, max(1, full)))]
        dealt: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-lengths, kind="stable").tolist():
            if lengths[i]:
                size, k = heapq.heappop(heap)
                dealt[k].append(i)
                heapq.heappush(heap, (size + int(lengths[i]), k))
        sizes = {k: size for size, k in heap}
        order = sorted(range(len(dealt)), key=lambda k: -sizes[k])
        self.sizes = np.array([sizes[k] for k in order], np.int64)
        shape = (int(self.sizes[0]) if len(order) else 0, len(order))
        self.y, self.x = np.full(shape, OTHER, np.int16), np.full(shape, BEGIN, np.int16)
        self.text = np.zeros(shape, np.int32)
        self.begins = np.zeros(shape, bool)
        for col, k in enumerate(order):
            at = 0
            for i in dealt[k]:
                own, to = ids[first[i] : first[i + 1]], at + int(lengths[i])
                self.y[at:to, col] = own
                self.x[at + 1 : to, col] = own[:-1]
                self.text[at:to, col] = i
                self.begins[at, col] = True
                at = to

    def windows(self):
        """(first step, one past the last, streams that are not over) of each window."""
        for at in range(0, len(self.y), STEPS):
            yield at, min(at + STEPS, len(self.y)), int((self.sizes > at).sum())


class Trace(NamedTuple):
    """What a window's steps leave for the way back, each (steps, streams, H or 2 H): states before, gates, candidates, and the
    candidates' part of the recurrent input."""

    before: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray
    act: np.ndarray


class Net:
    def __init__(self, params: Params):
        self.p = params

    def forward(self, x: np.ndarray, begins: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, Trace]:
        """States after each step, (steps, streams, H), and the trace."""
        p, n = self.p, HIDDEN
        given, kind = p.table[x], p.table.dtype
        gates, candidate = given[..., : 2 * n].copy(), given[..., 2 * n :].copy()
        out, before, act = (np.empty((*x.shape, n), kind) for _ in range(3))
        gate_state, candidate_state = p.state[:, : 2 * n].copy(), p.state[:, 2 * n :].copy()
        fresh = begins.any(axis=1)
        for t in range(len(x)):
            now, g, c, a = before[t], gates[t], candidate[t], act[t]
            now[:] = h
            if fresh[t]:
                now[begins[t]] = 0
            g += now @ gate_state
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.matmul(now, candidate_state, out=a)
            c += g[:, :n] * a
            np.tanh(c, out=c)
            h = out[t]
            np.subtract(now, c, out=h)
            h *= g[:, n:]
            h += c
        return out, Trace(before, gates, candidate, act)

    def outputs(self, states: np.ndarray, y: np.ndarray, grads: bool = False):
        """Natural log-probability of each token; with ``grads``, also the gradients of the summed loss."""
        p = self.p
        cls = np.minimum(y // PER, CLASSES).astype(np.int64)
        logits = states @ p.classes
        logits += p.class_bias
        logits -= logits.max(axis=1, keepdims=True)
        rows = np.arange(len(y))
        logp = logits[rows, cls].astype(np.float64)
        e = np.exp(logits, out=logits)
        total = e @ np.ones(CLASSES + 1, e.dtype)
        logp -= np.log(total)
        # Words inside their classes: tokens in the order of classes, one product a class, the rest for all at once.
        order = np.argsort(cls.astype(np.int8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        order = order[: cuts[-1]]
        some, own = states[order], cls[order]
        word, at = y[order] % PER, np.arange(len(order))
        u = p.word_bias[own]
        used = [(k, int(cuts[k]), int(cuts[k + 1])) for k in range(CLASSES) if cuts[k] < cuts[k + 1]]
        for k, a, b in used:
            u[a:b] += some[a:b] @ p.words[k]
        u -= u.max(axis=1, keepdims=True)
        logp[order] += u[at, word]
        eu = np.exp(u, out=u)
        s = eu @ np.ones(PER, eu.dtype)
        logp[order] -= np.log(s)
        if not grads:
            return logp
        e /= total[:, None]
        e[rows, cls] -= 1
        d_states = e @ p.classes.T
        eu /= s[:, None]
        eu[at, word] -= 1
        d_words, d_word_bias, d_some = np.zeros_like(p.words), np.zeros_like(p.word_bias), np.empty_like(some)
        for k, a, b in used:
            np.matmul(some[a:b].T, eu[a:b], out=d_words[k])
            np.matmul(eu[a:b], p.words[k].T, out=d_some[a:b])
        if used:
            d_word_bias[[k for k, _, _ in used]] = np.add.reduceat(eu, [a for _, a, _ in used], axis=0)
        d_states[order] += d_some
        return logp, d_states, states.T @ e, e.sum(axis=0), d_words, d_word_bias


def score(params: Params, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each whole text (without what the caller adds for words of the last class)."""
    net, streams = Net(params), Streams(ids, first)
    out, h = np.zeros(len(first) - 1), np.zeros((streams.y.shape[1], HIDDEN), np.float32)
    for a, b, n in streams.windows():
        states, _ = net.forward(streams.x[a:b, :n], streams.begins[a:b, :n], h[:n])
        h = states[-1]
        real = np.arange(a, b)[:, None] < streams.sizes[:n]
        logp = net.outputs(states[real], streams.y[a:b, :n][real])
        out += np.bincount(streams.text[a:b, :n][real], weights=logp, minlength=len(out))
    return out


class Trainer:
    """Adam over windows; one pass over whatever texts it is given."""

    def __init__(self, params: Params, rate: float = RATE):
        self.net, self.rate, self.k = Net(params), rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def learn(self, ids: np.ndarray, first: np.ndarray) -> float:
        """Train on some texts; returns their summed loss as met."""
        streams, loss = Streams(ids, first, LEARN_STREAMS), 0.0
        h = np.zeros((streams.y.shape[1], HIDDEN), np.float32)
        for a, b, n in streams.windows():
            loss += self._window(streams, a, b, n, h)
        return loss

    def _window(self, s: Streams, a: int, b: int, n: int, carried: np.ndarray) -> float:
        net, p, size = self.net, self.net.p, HIDDEN
        x, begins = s.x[a:b, :n], s.begins[a:b, :n]
        states, trace = net.forward(x, begins, carried[:n])
        carried[:n] = states[-1]
        real = np.arange(a, b)[:, None] < s.sizes[:n]
        logp, d_real, d_classes, d_class_bias, d_words, d_word_bias = net.outputs(states[real], s.y[a:b, :n][real], grads=True)
        d_states = np.zeros_like(states)
        d_states[real] = d_real
        before, gates, candidate, act = trace
        r, z = gates[..., :size], gates[..., size:]
        # How a state's gradient goes into candidate, reset and update inputs, for all steps at once.
        to_candidate = (1 - z) * (1 - candidate * candidate)
        to_reset = act * r * (1 - r)
        to_update = (before - candidate) * z * (1 - z)
        d_candidate, d_act = np.empty_like(states), np.empty((*x.shape, 3 * size), states.dtype)
        back = np.zeros((n, size), states.dtype)
        turn = p.state.T.copy()
        fresh = begins.any(axis=1)
        for t in range(len(x) - 1, -1, -1):
            c, q = d_candidate[t], d_act[t]
            back += d_states[t]
            np.multiply(back, to_candidate[t], out=c)
            np.multiply(c, to_reset[t], out=q[:, :size])
            np.multiply(back, to_update[t], out=q[:, size : 2 * size])
            np.multiply(c, r[t], out=q[:, 2 * size :])
            back *= z[t]
            back += q @ turn
            if fresh[t]:
                back[begins[t]] = 0
        d_state = before.reshape(-1, size).T @ d_act.reshape(-1, 3 * size)
        d_act[..., 2 * size :] = d_candidate  # now the gradient of the words' rows
        flat_x = x.ravel()
        order = np.argsort(flat_x, kind="stable")
        sorted_x = flat_x[order]
        heads = np.flatnonzero(np.append(True, sorted_x[1:] != sorted_x[:-1]))
        d_table = np.zeros_like(p.table)
        d_table[sorted_x[heads]] = np.add.reduceat(d_act.reshape(-1, 3 * size)[order], heads, axis=0)
        self._step((d_table, d_state, d_classes, d_class_bias, d_words, d_word_bias), max(1, len(logp)))
        return -float(logp.sum())

    def _step(self, grads: tuple, tokens: int) -> None:
        self.k += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.k) / (1 - 0.9**self.k)
        scale = 1 / tokens
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads))) * scale
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        for p, g, m, v in zip(self.net.p, grads, self.m, self.v, strict=True):
            g = g * np.float32(scale)
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            g *= g
            v += 0.001 * g
            p -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-6))
