"""LM scoring: a gated recurrent language model learned from the corpus, and an add-one unigram as the base.

Documents whose crc32 of the doc_id (as text) leaves another remainder than ``HELD_OUT`` modulo ``FOLDS`` are learned
from; all are scored. Tokens are words (A-Z lower-cased) and one end a document.

1. Counts of all training tokens, by a grouped sum of counts that tasks have added up before.
2. The ``gru.WORDS`` most frequent tokens are the model's vocabulary. Every document is written once as vocabulary ids, with
   what the base needs.
3. The weights are learned in ``ROUNDS`` rounds over disjoint parts of the training documents, which together are all of
   them. A round's documents are dealt to shards by a hash; a shard goes through its own, in the order of another hash, by
   truncated backpropagation from the last round's weights, and the shards' weights are averaged by tokens. How many shards there are follows from the number
   of training tokens alone (its square root, so that shards and what each of them learns grow alike). So nothing
   depends on how the table or the cluster is partitioned.
4. Scoring runs the model over whole documents with carried state. A token outside the vocabulary gets the probability
   of the last class times (c + 1) / (N' + V' + 1), with the counts of such tokens.

Counts of the most frequent tokens, ``KNOWN`` at most and the vocabulary at least, go out with the coding function (a bounded table); the rest, a few percent of
the text, meet their counts by a join on the token. Tokens are known by 64-bit names of their bytes: among V distinct ones
V**2 / 2**65 pairs are expected to share a name (one pair at six billion), whose counts are then added up.

Edge cases: a null or empty text is its end token alone; a null doc_id counts as the empty text, of remainder 0; rows that
share a doc_id are scored each for itself; without training documents N = V = 0 and the model is its initial self; an
empty table gives an empty result; extra columns are ignored here.

Scale: words leave a task only as counts or as a document's rare words; learning moves two bytes a token. Averages are made a
slice of the weights a task, over sorted rows as they come, so no task holds more than one slice's sums however many shards there were. The driver gets
the vocabulary and the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .base import Words, bounded_batches, materialize, pieces, signed, table

FOLDS, HELD_OUT = 7, 2
#: The most tokens, of the most frequent ones, whose counts are sent to all tasks.
KNOWN = 1 << 18
#: Sixteenths of the training documents that each round learns from, and its share of the first round's step size.
ROUNDS, RATES = (1, 2, 3, 4, 6), (1.0, 1.0, 0.7, 0.5, 0.3)
#: Training tokens of the square of the number of shards: s shards from (s - 1)**2 times as many tokens on.
SHARD_TOKENS = 1_000_000
#: Tokens dealt to streams at once in scoring and in training, and distinct tokens that a counting task holds.
BLOCK_TOKENS, LEARN_TOKENS, HELD_COUNTS = 1 << 22, 1 << 21, 1 << 20
#: Weights in a slice of an average.
CHUNK = 1 << 12
END = np.uint64(0x6E5D3C1B2A490817)


class Lexicon(NamedTuple):
    """Names, counts and vocabulary ids (``gru.OTHER`` outside) of the most frequent tokens, by name; corpus totals."""

    names: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    n: int
    v: int
    other_n: int
    other_v: int


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens, and each text's first one; the last token of a text is its end."""
    words = Words(column, lower=True)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, np.uint64)
    place = np.ones(first[-1], bool)
    place[first[1:] - 1] = False
    out[place] = words.names
    return out, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    size = 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([names, *waiting])
        u, back = np.unique(every, return_inverse=True)
        return u, np.bincount(back, weights=np.concatenate([counts, np.ones(len(every) - len(counts))])).astype(np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([signed(names), pa.array(counts)], ["name", "c"])

    for batch in pieces(batches):
        waiting.append(tokens(batch.column("text"))[0])
        size += len(waiting[-1])
        if size > HELD_COUNTS:
            names, counts = added()
            waiting, size = [], 0
            if len(names) > HELD_COUNTS:
                yield out()
                names, counts = names[:0], counts[:0]
    if size:
        names, counts = added()
    if len(names):
        yield out()


def _lookup(lexicon: Lexicon, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (0 outside the lexicon) and vocabulary ids."""
    if not len(lexicon.names):
        return np.zeros(len(names), np.int64), np.full(len(names), gru.OTHER, np.int16)
    u, back = np.unique(names, return_inverse=True)
    at = np.minimum(np.searchsorted(lexicon.names, u), len(lexicon.names) - 1)
    hit = lexicon.names[at] == u
    return np.where(hit, lexicon.counts[at], 0)[back], np.where(hit, lexicon.ids[at], np.int16(gru.OTHER))[back]


def _coded(lexicon):
    """Documents as vocabulary ids, with the base's sums over known tokens and each document's tokens that are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        rid = TaskContext.get().partitionId() << 33
        log_all, log_other = np.log10(known.n + known.v + 1.0), np.log10(known.other_n + known.other_v + 1.0)
        for batch in pieces(batches):
            names, first = tokens(batch.column("text"))
            n = batch.num_rows
            counts, ids = _lookup(known, names)
            n_tokens = np.diff(first)
            owner = np.repeat(np.arange(n), n_tokens)
            log_c = np.log10(counts + 1.0)
            rare = counts == 0
            pair = np.stack([owner[rare].astype(np.uint64), names[rare]])
            pair = pair[:, np.lexsort(pair[::-1])]
            new = np.ones(pair.shape[1], bool)
            new[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
            heads = np.flatnonzero(new)
            ends = pa.array(np.searchsorted(pair[0][heads], np.arange(n + 1).astype(np.uint64)), pa.int32())
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + np.arange(n)),
                    *(batch.column(c) for c in ("doc_id", "part", "shard", "place")),
                    pa.array(n_tokens.astype(np.int64)),
                    pa.array(np.bincount(owner, weights=counts > 0, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(owner, weights=log_c, minlength=n) - n_tokens * log_all),
                    pa.array(np.bincount(owner, weights=np.where(ids == gru.OTHER, log_c - log_other, 0.0), minlength=n)),
                    pa.ListArray.from_arrays(ends, signed(np.ascontiguousarray(pair[1][heads]))),
                    pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(heads, pair.shape[1])).astype(np.int32))),
                    pa.array([raw[2 * a : 2 * b] for a, b in pairwise(first.tolist())], pa.binary()),
                ],
                [f.split()[0] for f in _CODED.format("long").split(", ")],
            )
            rid += n

    return run


_CODED = "rid long, doc_id {}, part int, shard int, place long, n_tokens long, n_known long, base double, other double, names array<long>, tf array<int>, ids binary"


def _learned(weights, rate: float):
    """The weights that each shard has learned, in slices; the rows of a shard come one after the other, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, shard, seen = None, None, 0
        held: list[bytes] = []
        size = 0

        def learn() -> None:
            nonlocal held, size, seen
            if held:
                trainer.learn(*_joined(held))
                seen += size // 2
            held, size = [], 0

        def out() -> pa.RecordBatch:
            flat = gru.pack(trainer.net.p)
            cut = [flat[at : at + CHUNK].tobytes() for at in range(0, len(flat), CHUNK)]
            n = len(cut)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([shard] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(cut, pa.binary())], ["chunk", "shard", "weight", "mean"])

        for batch in batches:
            for own, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != shard:
                    if trainer:
                        learn()
                        yield out()
                    trainer, shard, seen = gru.Trainer(gru.unpack(weights.value), rate), own, 0
                held.append(ids)
                size += len(ids)
                if size >= 2 * LEARN_TOKENS:
                    learn()
        if trainer:
            learn()
            yield out()

    return run


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some documents put together, and where each begins."""
    return np.frombuffer(b"".join(parts), np.int16), np.cumsum([0, *map(len, parts)]) // 2


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean by weight of each slice; rows come in the order of (chunk, shard)."""
    now, weight, total = None, 0.0, 0.0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["chunk", "mean"])

    for batch in batches:
        for chunk, w, mean in zip(*(batch.column(c).to_pylist() for c in ("chunk", "weight", "mean")), strict=True):
            if chunk != now:
                if now is not None:
                    yield out()
                now, weight, total = chunk, 0.0, 0.0
            weight += w
            total = total + w * np.frombuffer(mean, np.float32).astype(np.float64)
    if now is not None:
        yield out()


def n_shards(n: int) -> int:
    """Shards for ``n`` training tokens."""
    return max(1, math.ceil(math.sqrt(n / SHARD_TOKENS)))


def learn(coded: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """The model's weights after all rounds over the coded training documents."""
    context = coded.sparkSession.sparkContext
    counts = np.zeros(gru.WORDS)
    inside = lexicon.ids != gru.OTHER
    counts[lexicon.ids[inside]] = lexicon.counts[inside]
    flat = gru.pack(gru.initial(counts, lexicon.other_n))
    shards, slices = n_shards(lexicon.n), -(-len(flat) // CHUNK)
    for part, rate in enumerate(RATES):
        weights = context.broadcast(flat)
        mine = coded.where(F.col("part") == part).select("shard", "place", "ids").repartitionById(shards, "shard").sortWithinPartitions("shard", "place")
        means = mine.mapInArrow(_learned(weights, gru.RATE * rate), "chunk int, shard int, weight double, mean binary")
        means = means.repartitionById(slices, "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_averaged, "chunk int, mean binary")
        rows = means.collect()  # one set of weights
        if rows:
            flat = np.concatenate([np.frombuffer(r.mean, np.float32) for r in sorted(rows)])
    return flat


def _scored(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = gru.unpack(weights.value)
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            log_p = gru.score(params, *_joined([x for b in held for x in b.column("ids").to_pylist()])) / np.log(10)
            at = 0
            for b in held:
                model = pa.array(b.column("other").to_numpy() + log_p[at : at + b.num_rows])
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "doc_id", "n_tokens", "n_known", "base")), model], ["rid", "doc_id", "n_tokens", "n_known", "base", "model"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("ids").nbytes
            if size >= 2 * BLOCK_TOKENS:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return run


def count_tokens(train: DataFrame) -> DataFrame:
    """(name, c) of every training token."""
    return train.select("text").mapInArrow(_counted, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


def lexicon_of(counts: DataFrame) -> Lexicon:
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The least count that at most KNOWN tokens reach, from a histogram of a few hundred bins.
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    least, size = None, 0
    for row in sorted(bins, key=lambda r: -r.bin):
        size += row.n
        if size > KNOWN:
            break
        least = row.least
    top = counts.where(F.col("c") >= least if least is not None else F.lit(False)).toArrow().combine_chunks()
    names, c = top.column("name").to_numpy().view(np.uint64), top.column("c").to_numpy()
    if len(names) < gru.WORDS and len(names) < totals.v:
        # The vocabulary does not depend on where the bins are cut.
        first = counts.orderBy(F.desc("c"), "name").limit(gru.WORDS).toArrow().combine_chunks()
        names, c = first.column("name").to_numpy().view(np.uint64), first.column("c").to_numpy()
    order = np.lexsort((names.view(np.int64), -c))
    ids = np.full(len(names), gru.OTHER, np.int16)
    ids[order[: gru.WORDS]] = np.arange(min(gru.WORDS, len(names)))
    by_name = np.argsort(names)
    inside = ids != gru.OTHER
    return Lexicon(names[by_name], c[by_name], ids[by_name], int(totals.n), int(totals.v), int(totals.n - c[inside].sum()), int(totals.v - inside.sum()))


def held_out(doc_id) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("doc_id", "text")
    counts = materialize(count_tokens(texts.where(~held_out(F.col("doc_id")))), "counts")
    lexicon = lexicon_of(counts)
    # Where a document is learned from: its round, its shard there and its place in that, by hashes of what it is.
    sixteenth = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(sum(ROUNDS)))
    part = F.lit(len(ROUNDS) - 1)
    for k in range(len(ROUNDS) - 2, -1, -1):
        part = F.when(sixteenth < sum(ROUNDS[: k + 1]), k).otherwise(part)
    dealt = texts.select(
        "doc_id",
        "text",
        F.when(~held_out(F.col("doc_id")), part).otherwise(-1).cast("int").alias("part"),
        F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "text"), F.lit(n_shards(lexicon.n))).cast("int").alias("shard"),
        F.xxhash64(F.lit("place"), "doc_id", "text").alias("place"),
    )
    kind = dict(texts.dtypes)["doc_id"]
    coded = materialize(dealt.mapInArrow(_coded(spark.sparkContext.broadcast(lexicon)), _CODED.format(kind)), "coded", by="part")
    weights = spark.sparkContext.broadcast(learn(coded, lexicon))
    scored = coded.select("rid", "doc_id", "n_tokens", "n_known", "base", "other", "ids").mapInArrow(_scored(weights), f"rid long, doc_id {kind}, n_tokens long, n_known long, base double, model double")
    rare = coded.select("rid", F.explode(F.arrays_zip("names", "tf")).alias("x")).select("rid", F.col("x.names").alias("name"), F.col("x.tf").alias("tf"))
    met = rare.join(counts.hint("merge"), "name")  # tokens without a count add log10(1) = 0
    extra = met.groupBy("rid").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log_c"))
    out = scored.join(extra.hint("merge"), "rid", "left")
    log_c = F.coalesce("log_c", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(lexicon.n).cast("long").alias("train_tokens"),
        (F.col("base") + log_c).alias("base_score"),
        (F.col("model") + log_c).alias("score"),
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
