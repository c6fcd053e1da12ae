"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by logistic regressions on hashed words and word beginnings; each later one also
gets the probabilities of the earlier ones. In training these are out-of-fold: a fold's rows get the probability from a
model that did not see them, so a later model learns from inputs as unsure as those that it will meet. The label table
here names one toxicity category and one of low quality; the chain runs ``low_quality`` first, then ``toxic``.

The fit is on a bounded sample of labelled documents, ``PER_CLASS`` of each value of the last category, chosen by a hash of the
doc_id (parameters); scoring covers every document. Features are chosen and fitted again within each fold. The sample holds as
many toxic documents as others, so the threshold, the cut of best F1, weighs each class by its share of all labelled documents.

Edge cases: a null or empty text has no features and gets the prior; a null label leaves its row out of that category's
fit; a category without both values in the sample gets probability 0, and one that the sample does not teach is never flagged; of repeated rows each is
scored, and of those of a sampled doc_id one text (of the smallest hash) is learned from; repeated labels of a doc_id count by their largest values; an empty table gives an empty result; other columns
pass through, clashing names are replaced.

Scale: no shuffle of texts but the sampled ones. The sampled ids (at most twice ``PER_CLASS``) are broadcast to find their texts. Features
are counted by Spark, a row a feature (at most 2**``BITS``), and each task passes on its best ``FEATURES`` of every fit; then the
driver gets a bit a document and chosen feature, 6 MB at most whatever the texts' lengths. The model (a few thousand numbers) goes
out with the scoring function.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, bounded_batches, materialize, mix, pieces, span_names, table

#: Sampled rows of each class, folds, features of a model, and bits of a feature's hash.
PER_CLASS, FOLDS, FEATURES, BITS = 4000, 5, 512, 20
#: The G statistic that a feature needs to be taken (about one chance in a thousand).
LEAST_G = 10.8
#: A threshold that no probability reaches.
NEVER = 2.0
BEGINNINGS = (4, 5, 6, 8)
CATEGORIES = ("low_quality", "toxic")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, sorted and distinct: words and their first bytes, A-Z lower-cased."""
    words = Words(column, lower=True)
    owner, parts, owners = words.owner(), [], []
    for k in (0, *BEGINNINGS):
        some = np.flatnonzero(words.ends - words.starts > k) if k else np.arange(len(words.starts))
        start = words.starts[some]
        end = start + k if k else words.ends[some]
        parts.append(mix(span_names(words.data, start, end) + np.uint64(k)) >> np.uint64(64 - BITS))
        owners.append(owner[some])
    pair = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(parts))
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Linear(NamedTuple):
    """One category's model: features with weights, weights of earlier probabilities, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


class Chain(NamedTuple):
    models: tuple[Linear | None, ...]
    threshold: float


def _g(yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float) -> np.ndarray:
    """The G statistic of features that ``yes`` of ``n_yes`` and ``no`` of ``n_no`` rows have."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    share = (yes + no) / (n_yes + n_no)
    return part(yes, share * n_yes) + part(no, share * n_no) + part(n_yes - yes, (1 - share) * n_yes) + part(n_no - no, (1 - share) * n_no)


def _fits(n_categories: int) -> list[tuple[int, int]]:
    """(category, fold left out) of every model that is fitted; -1 leaves none out."""
    return [(k, fold) for k in range(n_categories) for fold in (*range(FOLDS), -1)]


def rank_features(feats: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every fit, the best of some features and their G statistics.

    ``counts``: (features, categories, values, folds) rows that have them; ``totals``: (categories, values, folds) rows.
    """
    out = []
    for k, fold in _fits(totals.shape[0]):
        own = [f for f in range(FOLDS) if f != fold]
        n_no, n_yes = totals[k][:, own].sum(axis=1)
        if not n_no or not n_yes:
            out.append((feats[:0], np.zeros(0)))
            continue
        no, yes = counts[:, k, :, :][:, :, own].sum(axis=2).T
        g = _g(yes, no, n_yes, n_no)
        order = np.lexsort((feats, -g))[:FEATURES]
        order = order[g[order] >= LEAST_G]
        out.append((feats[order], g[order]))
    return out


def _dense(rows: np.ndarray, feats: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Which of the chosen features each of ``n`` rows has."""
    at = np.searchsorted(chosen, feats)
    hit = (at < len(chosen)) & (np.append(chosen, -1)[np.minimum(at, len(chosen))] == feats)
    x = np.zeros((n, len(chosen)), bool)
    x[rows[hit], at[hit]] = True
    return x


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam with all rows in each step."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log((y.sum() + 1) / ((~y).sum() + 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    target = y.astype(np.float32)
    for k in range(1, steps + 1):
        off = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target
        grad = np.append(x.T @ off / len(y) + penalty * w, off.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), np.float32(b - step[-1])
    return w, float(b)


def _model(x: np.ndarray, chosen: np.ndarray, universe: np.ndarray, y: np.ndarray, take: np.ndarray, earlier: np.ndarray) -> Linear | None:
    if not (take & y).any() or not (take & ~y).any():
        return None
    own = np.hstack([x[:, np.searchsorted(universe, chosen)], earlier]).astype(np.float32)[take]
    w, b = _fit(own, y[take])
    return Linear(chosen, w[: len(chosen)], w[len(chosen) :], b)


def predict(model: Linear | None, rows: np.ndarray, feats: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    if model is None:
        return np.zeros(n)
    at = np.searchsorted(model.features, feats)
    hit = (at < len(model.features)) & (np.append(model.features, -1)[np.minimum(at, len(model.features))] == feats)
    z = np.bincount(rows[hit], weights=model.weights[at[hit]], minlength=n) + model.intercept
    if earlier.shape[1]:
        z = z + earlier @ model.earlier
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(x: np.ndarray, universe: np.ndarray, chosen: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, weights: np.ndarray) -> Chain:
    """``x``: rows by features of ``universe`` (sorted); ``chosen``: sorted features of each of ``_fits``; ``labels``: one column a
    category in chain order, NaN where unknown; ``folds``: each row's fold; ``weights``: each row's for the threshold."""
    n = len(labels)
    by = dict(zip(_fits(labels.shape[1]), chosen, strict=True))
    rows, at = np.nonzero(x)
    out_of_fold, models = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        known, y = ~np.isnan(labels[:, k]), labels[:, k] == 1
        p = np.zeros(n)
        for fold in range(FOLDS):
            held = folds == fold
            p[held] = predict(_model(x, by[k, fold], universe, y, known & ~held, out_of_fold), rows, universe[at], n, out_of_fold)[held]
        models.append(_model(x, by[k, -1], universe, y, known, out_of_fold))
        out_of_fold = np.hstack([out_of_fold, p[:, None]])
    return Chain(tuple(models), _threshold(out_of_fold[known, -1], y[known], weights[known]))


def _threshold(p: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The cut of best weighted F1 on out-of-fold probabilities, of equally good ones the nearest to a half.

    Where none is better than to flag everything, the model has learned nothing and flags nothing.
    """
    yes = float(weights[y].sum())
    best, at = 2 * yes / max(1e-9, float(weights.sum()) + yes), NEVER
    for t in sorted(np.linspace(0.05, 0.95, 91), key=lambda t: abs(t - 0.5)):
        f1 = 2 * float(weights[y & (p >= t)].sum()) / max(1e-9, yes + float(weights[p >= t].sum()))
        if f1 > best + 1e-12:
            best, at = f1, float(t)
    return at


_FEATURED = f"doc_id long, fold int, {', '.join(f'{c} double' for c in CATEGORIES)}, feats array<int>"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows, feats = features(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(feats.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", *CATEGORIES)), lists], ["doc_id", "fold", *CATEGORIES, "feats"])


def _cells() -> list[tuple[int, int, int]]:
    return [(k, v, f) for k in range(len(CATEGORIES)) for v in (0, 1) for f in range(FOLDS)]


def _shaped(columns: list) -> np.ndarray:
    """Counts in the order of ``_cells`` as (..., categories, values, folds)."""
    return np.stack(columns, axis=-1).astype(float).reshape(*np.shape(columns[0]), len(CATEGORIES), 2, FOLDS)


def _ranked(totals: np.ndarray):
    """The best features of every fit in a task's part of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in _fits(len(CATEGORIES))]
        for batch in batches:
            counts = _shaped([batch.column(f"n{i}").to_numpy() for i in range(len(_cells()))])
            for i, (feats, g) in enumerate(rank_features(batch.column("feat").to_numpy().astype(np.int64), counts, totals)):
                feats, g = np.append(best[i][0], feats), np.append(best[i][1], g)
                order = np.lexsort((feats, -g))[:FEATURES]
                best[i] = feats[order], g[order]
        for i, (feats, g) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(feats), i, np.int32)), pa.array(feats.astype(np.int32)), pa.array(g)], ["fit", "feat", "g"])

    return run


def _bits(universe: np.ndarray):
    """Which of the chosen features each text has, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("feats")
            x = _dense(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64), universe, batch.num_rows)
            packed = pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", *CATEGORIES)), packed], ["doc_id", "fold", *CATEGORIES, "bits"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain:
    """The chain, fitted on a hash-chosen sample of labelled documents."""
    bounded_batches(docs.sparkSession)
    named = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((1 - F.max("quality")).cast("double").alias("low_quality"), F.max("toxic").cast("double").alias("toxic"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [named.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    sample = materialize(sample, "sample")
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "fold", *CATEGORIES).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    known = materialize(met.select("doc_id", "fold", *CATEGORIES, F.col("one.text").alias("text")).mapInArrow(_featured, _FEATURED), "featured")

    cells = [F.count_if((F.col(CATEGORIES[k]) == v) & (F.col("fold") == f)).alias(f"n{i}") for i, (k, v, f) in enumerate(_cells())]
    totals = _shaped([np.array(x) for x in known.agg(*cells).first()])
    counted = known.select("fold", *CATEGORIES, F.explode("feats").alias("feat")).groupBy("feat").agg(*cells)
    best = counted.mapInArrow(_ranked(totals), "fit int, feat int, g double").toArrow()
    fits, feats, g = (best.column(c).to_numpy() for c in ("fit", "feat", "g"))
    chosen = []
    for i in range(len(_fits(len(CATEGORIES)))):
        own = np.flatnonzero(fits == i)
        own = own[np.lexsort((feats[own], -g[own]))[:FEATURES]]
        chosen.append(np.sort(feats[own]).astype(np.int64))
    universe = np.unique(np.concatenate(chosen))

    got = known.mapInArrow(_bits(universe), _FEATURED.replace("feats array<int>", "bits binary")).toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Chain((None,) * len(CATEGORIES), NEVER)
    packed = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, -1)
    x = np.unpackbits(packed, axis=1, count=len(universe)).astype(bool)
    values = np.stack([got.column(c).to_numpy(zero_copy_only=False).astype(float) for c in CATEGORIES], axis=1)
    # A sampled document stands for its class's share of all labelled ones.
    population = named.agg(*(F.count_if(F.col("toxic") == v).alias(f"n{v}") for v in (0, 1))).first()
    weights = np.ones(len(values))
    for v in (0, 1):
        own = values[:, -1] == v
        weights[own] = population[v] / max(1, own.sum())
    return fit_chain(x, universe, chosen, values, got.column("fold").to_numpy(), weights)


def _scored(chain: Chain, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, feats = features(batch.column("text"))
            p = np.zeros((batch.num_rows, 0))
            for model in chain.models:
                p = np.hstack([p, predict(model, rows, feats, batch.num_rows, p)[:, None]])
            flag = (p[:, -1] >= chain.threshold) & (chain.models[-1] is not None)
            new = [*(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(flag)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *(f"p_{c}" for c in CATEGORIES), "is_toxic"])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with each category's probability (``p_...``) and ``is_toxic``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("is_toxic", *(f"p_{c}" for c in CATEGORIES))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"p_{c} double" for c in CATEGORIES), "is_toxic boolean"])
    return docs.mapInArrow(_scored(chain, docs.columns), kinds)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
