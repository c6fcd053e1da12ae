from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa

from readloom.llm import toxicity as T


def made(n=600, seed=1):
    rng = random.Random(seed)
    words = ["w" + "".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    bad = ["badmouthing", "badmouthed", "Scumbag,", "scumbags"]
    rows = []
    for d in range(n):
        toxic, low = rng.random() < 0.2, rng.random() < 0.2
        ws = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if toxic:
            ws[rng.randrange(len(ws))] = rng.choice(bad)
        if low:
            ws += ["click", "here"]
        rows.append((d, " ".join(ws), 0 if low else 1, int(toxic)))
    return rows


def test_held_out(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.score(docs, T.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] % 2 == 0]
    assert np.mean([got[r[0]].is_toxic == bool(r[3]) for r in held]) > 0.97
    assert np.mean([(got[r[0]].p_low_quality > 0.5) == (r[2] == 0) for r in held]) > 0.97


def test_later_models_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    n = 400
    first = rng.random(n) < 0.5
    noise = [f"n{rng.integers(1 << 40)} n{rng.integers(1 << 40)}" for _ in range(n)]
    texts = [("alpha " if y else "beta ") + t for y, t in zip(first, noise, strict=True)]
    rows, feats = T.features(pa.array(texts))
    # The second category is the first one: only the chain's input tells it once alpha and beta are gone.
    labels = np.stack([first, first], axis=1).astype(float)
    folds = np.arange(n) % T.FOLDS
    universe = np.unique(feats)
    x = T._dense(rows, feats, universe, n)
    cells = [(labels[:, k] == v) & (folds == f) for k, v, f in T._cells()]
    counts, totals = T._shaped([x[c].sum(axis=0) for c in cells]), T._shaped([c.sum() for c in cells])
    chosen = [np.sort(f) for f, _ in T.rank_features(universe, counts, totals)]
    chain = T.fit_chain(x, universe, chosen, labels, folds, np.ones(n))
    assert chain.models[1].earlier[0] > 0.5
    p1 = T.predict(chain.models[0], rows, feats, n, np.zeros((n, 0)))
    none = np.zeros(0, np.int64)
    p2 = T.predict(chain.models[1], none, none, n, p1[:, None])
    assert np.corrcoef(p2, first)[0, 1] > 0.9


def by_hand(x, universe, labels, folds):
    """The features of each fit, a feature and a row at a time."""
    out = []
    for k in range(labels.shape[1]):
        for fold in (*range(T.FOLDS), -1):
            use = [i for i in range(len(x)) if folds[i] != fold and not math.isnan(labels[i, k])]
            n_yes = sum(labels[i, k] == 1 for i in use)
            n_no = len(use) - n_yes
            scored = []
            for c, feat in enumerate(universe.tolist()):
                if not n_yes or not n_no:
                    break
                table = [[sum(x[i, c] == has and labels[i, k] == v for i in use) for v in (0, 1)] for has in (True, False)]
                g = 0.0
                for row in table:
                    for v, total in ((0, n_no), (1, n_yes)):
                        if row[v]:
                            g += row[v] * math.log(row[v] / (sum(row) * total / len(use)))
                if g >= T.LEAST_G:
                    scored.append((-g, feat))
            out.append(np.sort(np.array([f for _, f in sorted(scored)[: T.FEATURES]], np.int64)))
    return out


def test_features_and_scores_by_hand(spark):
    """What Spark counts and ranks, and what scoring gives, by plain loops over the same texts."""
    rows = made(150, 7)
    rows = [(*r[:2], None if r[0] % 17 == 0 else r[2], r[3]) for r in rows]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5, rows[5][1])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    chain = T.fit(docs, labels)
    own, feats = T.features(pa.array([r[1] for r in rows]))
    universe = np.unique(feats)
    x = T._dense(own, feats, universe, len(rows))
    values = np.array([[math.nan if r[2] is None else 1 - r[2], r[3]] for r in rows], float)
    folds = np.array([r.f for r in spark.createDataFrame([(r[0],) for r in rows], "doc_id long").selectExpr(f"pmod(xxhash64('fold', doc_id), {T.FOLDS}) AS f").collect()])
    wanted = by_hand(x, universe, values, folds)
    assert chain.models[0].features.tolist() == wanted[T.FOLDS].tolist()
    assert chain.models[1].features.tolist() == wanted[2 * T.FOLDS + 1].tolist()
    for r in T.score(docs, chain).collect():
        mine = set(feats[own == r.doc_id].tolist())
        p = []
        for model in chain.models:
            z = model.intercept + sum(w for f, w in zip(model.features, model.weights, strict=True) if f in mine) + sum(a * b for a, b in zip(model.earlier, p, strict=True))
            p.append(1 / (1 + math.exp(-z)))
        assert np.allclose([r.p_low_quality, r.p_toxic], p, atol=1e-6)
        assert r.is_toxic == (p[1] >= chain.threshold)


def test_threshold_weighs_classes():
    p, y = np.array([0.9, 0.8, 0.7, 0.6, 0.4, 0.3]), np.array([True, True, False, True, False, False])
    assert T._threshold(p, y, np.ones(6)) < 0.61
    assert T._threshold(p, y, np.where(y, 1.0, 50.0)) > 0.7  # one flagged wrongly stands for fifty


def test_edges(spark, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, "fine words", 5), (2, None, 6), (2, "", 7), (None, "other", 8), (3, "x " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic int")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == 5
    assert all(0 <= r.p_toxic <= 1 for r in got)
    none = labels.limit(0)
    chain = T.fit(docs, none)
    assert chain.models == (None, None)
    assert not any(r.is_toxic for r in T.score(docs, chain).collect())
    assert T.score(empty, T.fit(empty, labels)).count() == 0


def test_a_model_that_learned_nothing_flags_nothing(spark):
    docs = spark.createDataFrame([(d, f"w{d}") for d in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, d % 2) for d in range(20)], "doc_id long, quality int, toxic int")
    assert not any(r.is_toxic for r in T.score(docs, T.fit(docs, labels)).collect())


def test_features_are_words_and_beginnings():
    rows, feats = T.features(pa.array(["Loser", "loser", "los", None, "lo ser"]))
    by = [set(feats[rows == i].tolist()) for i in range(5)]
    assert by[0] == by[1]
    assert len(by[0]) == 2  # the word and its first four bytes
    assert not by[0] & by[4]
    assert not by[3]
