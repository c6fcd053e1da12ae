from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_conftest import made_docs, thue_morse, words

from readloom.llm import gru, lm_score


def base_by_hand(rows):
    toks = [(d, [*words(t, True), None]) for d, t in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(x for d, own in toks if not held(d) for x in own)
    n, v = sum(c.values()), len(c)
    return sorted((-1 if d is None else d, held(d), len(own), sum(c[x] > 0 for x in own), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own)) for d, own in toks)


def shown(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 200)  # so that many words come by the join
    rows = made_docs(6, 120)
    got = shown(lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    wanted = base_by_hand(rows)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted])
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    assert sum(g[6] for g in got if g[1]) > 1.1 * sum(g[5] for g in got if g[1])  # not much worse than the base, after a few windows


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 700)
    rows = [(d, t) for d, t in made_docs(12, 150)] + [(3, "twice"), (3, "twice"), (None, "x y")]
    assert lm_score.n_shards(sum(len(words(t)) + 1 for _, t in rows)) > 3
    got = [shown(lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(n))) for n in (1, 4, 13)]
    for other in got[1:]:
        assert [g[:5] for g in other] == [g[:5] for g in got[0]]
        assert np.allclose([g[5:] for g in other], [g[5:] for g in got[0]], rtol=1e-5)


def test_shards():
    assert [lm_score.n_shards(n) for n in (0, 1, 10**6, 10**6 + 1, 10**8, 2 * 10**13)] == [1, 1, 1, 2, 10, 4473]
    assert len(lm_score.ROUNDS) == len(lm_score.RATES)


def test_words_that_polynomial_hashes_confuse(spark):
    one, two = thue_morse(2048)
    rows = [(1, f"{one} {two} {one}"), (2, two), (3, f"{one} {two}"), (4, "a b")]
    got = shown(lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")))
    wanted = base_by_hand(rows)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted])


def test_a_shard_is_the_plain_loop():
    """What tasks and averages do, done by hand over two shards in an order of rows."""
    rng = np.random.default_rng(6)
    flat = gru.pack(gru.initial(rng.integers(1, 50, gru.WORDS), 500.0))
    docs = [rng.integers(0, gru.OTHER + 1, n).astype(np.int16) for n in (5, 300, 1, 40)]
    rows = pa.RecordBatch.from_pydict({"shard": pa.array([0, 0, 1, 1], pa.int32()), "ids": pa.array([d.tobytes() for d in docs], pa.binary())})
    out = list(lm_score._learned(type("B", (), {"value": flat})(), 0.01)(iter([rows.slice(0, 3), rows.slice(3)])))
    wanted = []
    for own in (docs[:2], docs[2:]):
        trainer = gru.Trainer(gru.unpack(flat), 0.01)
        trainer.learn(np.concatenate(own), np.cumsum([0, *map(len, own)]))
        wanted.append((gru.pack(trainer.net.p), sum(map(len, own))))
    got = pa.Table.from_batches(out).sort_by([("chunk", "ascending"), ("shard", "ascending")])
    assert set(got.column("weight").to_pylist()) == {305.0, 41.0}
    means = pa.Table.from_batches(lm_score._averaged(iter(got.to_batches(3)))).sort_by("chunk")
    mean = np.concatenate([np.frombuffer(m, np.float32) for m in means.column("mean").to_pylist()])
    assert np.allclose(mean, (wanted[0][0] * 305.0 + wanted[1][0] * 41.0) / 346, atol=1e-6)
    assert not np.allclose(mean, flat, atol=1e-4)


def test_edges(spark):
    rows = [(None, "a b"), (None, None), (5, "A b"), (5, ""), (9, "b " * 3000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = shown(lm_score.lm_scores(df))
    wanted = base_by_hand(rows)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted])
    assert lm_score.lm_scores(df.limit(0)).count() == 0
    only_held = spark.createDataFrame([(next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2), "x y")], "doc_id long, text string")
    (r,) = lm_score.lm_scores(only_held).collect()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)


def by_hand(params, ids):
    """Log-probability of one text, token by token."""
    h, x, out = np.zeros(gru.HIDDEN), gru.BEGIN, 0.0
    n = gru.HIDDEN
    for y in ids:
        a, g = h @ params.state, params.table[x]
        r, z = (1 / (1 + np.exp(-(g[k * n : (k + 1) * n] + a[k * n : (k + 1) * n]))) for k in (0, 1))
        c = np.tanh(g[2 * n :] + r * a[2 * n :])
        h = (1 - z) * c + z * h
        u = h @ params.classes + params.class_bias
        k = min(y // gru.PER, gru.CLASSES)
        out += u[k] - np.log(np.exp(u).sum())
        if y != gru.OTHER:
            w = h @ params.words[k] + params.word_bias[k]
            out += w[y % gru.PER] - np.log(np.exp(w).sum())
        x = y
    return out


def texts(rng, lengths):
    ids = rng.integers(0, gru.OTHER + 1, sum(lengths)).astype(np.int16)
    return ids, np.cumsum([0, *lengths])


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(2)
    params = gru.initial(rng.integers(1, 50, gru.WORDS), 500.0)
    ids, first = texts(rng, [1, 100, 33, 0, 64, 2])
    got = gru.score(params, ids, first)
    assert np.allclose(got, [by_hand(params, ids[a:b]) for a, b in zip(first, first[1:], strict=False)], rtol=1e-4)


def test_probabilities_sum_to_one():
    params = gru.initial(np.arange(gru.WORDS) % 9 + 1, 50.0)
    total = sum(math.exp(s) for s in gru.score(params, np.arange(gru.OTHER + 1, dtype=np.int16), np.arange(gru.OTHER + 2)))
    assert abs(total - 1) < 1e-4


def test_gradients(monkeypatch):
    rng = np.random.default_rng(3)
    params = gru.Params(*(p.astype(np.float64) for p in gru.initial(rng.integers(1, 50, gru.WORDS), 500.0)))
    ids, first = texts(rng, [9, 20, 3])
    grads = {}
    monkeypatch.setattr(gru.Trainer, "_step", lambda self, g, n: grads.setdefault("g", g))
    gru.Trainer(params).learn(ids, first)
    loss = lambda p: -gru.score(p, ids, first).sum()
    for k, (p, g) in enumerate(zip(params, grads["g"], strict=True)):
        for at in np.argsort(-np.abs(g).ravel())[[0, 3, 11]]:
            moved = [q.copy() for q in params]
            step = 1e-2
            moved[k].flat[at] += step
            up = loss(gru.Params(*moved))
            moved[k].flat[at] -= 2 * step
            down = loss(gru.Params(*moved))
            assert abs((up - down) / (2 * step) - g.flat[at]) < 2e-2 * max(1, abs(g.flat[at])), (k, at)
        assert p.shape == g.shape


def test_learning_helps():
    rng = np.random.default_rng(4)
    # Each text stays in one half of the words: what came before tells.
    lengths = [60] * 400
    half = np.repeat(rng.integers(0, 2, 400), 60)
    ids = (rng.integers(0, 300, 24000) * 2 + half).astype(np.int16)
    first = np.cumsum([0, *lengths])
    params = gru.initial(np.bincount(ids, minlength=gru.WORDS).astype(float), 1.0)
    before = gru.score(params, ids, first).sum()
    trainer = gru.Trainer(params)
    for _ in range(6):
        trainer.learn(ids, first)
    gain = (gru.score(trainer.net.p, ids, first).sum() - before) / len(ids)
    assert gain > 0.4  # of at most ln 2
    assert np.array_equal(gru.pack(gru.unpack(gru.pack(trainer.net.p))), gru.pack(trainer.net.p))
