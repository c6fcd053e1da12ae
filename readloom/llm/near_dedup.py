"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles (A-Z lower-cased; a shorter document is one shingle of all its words).
Documents with equal word sequences (by 128 bits of blake2b of the folded words) have equal sets and are one class, stood for
by the smallest doc_id. Each class has a MinHash signature of
``bands * rows`` samples. Bands of the signature propose candidate pairs; an odd sketch, the parity bitmap of the
samples, estimates each candidate's similarity from the population count of the XOR of two bitmaps and throws out those
that are far too low; a second parity bitmap, of the whole set, rules out without error what differs in more shingles than
the threshold allows. The rest is confirmed on the full sets. Links are put together into components.

No pairs of a whole bucket are emitted. First every document is held against one center, then against the center of each
of its buckets where that is in another component; the center is the member that shares most buckets, as an original does
among its variants. Most buckets are then one component. In
buckets that still span several, members meet block by block inside tasks: sketches are compared in blocks of ``BLOCK``
rows, and only pairs that pass the sketch and would join two components go on to be confirmed, once each. So any pair
that some band proposes is judged or already joined, whatever the bucket's size.

Chance of a miss at the threshold itself: ``(1 - t**rows) ** bands`` in banding (7e-9 for 0.85 with 5 x 32), and about
1e-8 in the sketch (``SLACK`` is six standard deviations of the estimate at the threshold).

Edge cases: a null or empty text, or one of white space, has an empty set and is linked with nothing; rows that share a
doc_id count as one document with the union of their links; rows with a null doc_id keep a null component and are kept;
ties go to the smallest doc_id; an empty table gives an empty result; extra columns are ignored here.

Scale: one pass over the texts makes the sketches; after that only band hashes (8 bytes each) move, and the texts of
documents in some candidate pair. Joins on hot buckets or hot documents may be split by Spark; sizes decide broadcasts. A bucket
of n members that is still open goes out as n**2 / ``BLOCK`` rows of sketches, and a task meets two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, bounded_batches, discard, exact_shingles, materialize, mix, pieces, shingle_sets, signed, table
from .components import connected_components

BLOCK = 4096
#: Bits of the odd sketch of the samples, and of the parity bitmap of the whole set.
BITS, SET_BITS = 512, 2048


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(names: np.ndarray, offsets: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of each set, one row a set (of an empty set: all ones)."""
    low = (names >> np.uint64(32)).astype(np.uint32)
    by, plus = _multipliers(samples)
    out = np.full((len(offsets) - 1, samples), 0xFFFFFFFF, np.uint32)
    for i in range(len(offsets) - 1):
        own = low[offsets[i] : offsets[i + 1]]
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            x = part[None, :] * by[:, None]
            x += plus[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(out[i], x.min(axis=1), out=out[i])
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, ``BITS // 64`` words a row."""
    n, k = samples.shape
    places = mix(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    cells = np.bincount((places.astype(np.int64) + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(cells.reshape(n, BITS).astype(bool), axis=1).view(np.uint64)


def parities(names: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the whole sets, ``SET_BITS // 64`` words a row."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    cells = np.bincount(owner * SET_BITS + (names & np.uint64(SET_BITS - 1)).astype(np.int64), minlength=n * SET_BITS) & 1
    return np.packbits(cells.reshape(n, SET_BITS).astype(bool), axis=1).view(np.uint64)


def allowed(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, threshold: float) -> np.ndarray:
    """False where the XOR of whole sets' parity bitmaps rules the threshold out: it has at most a bit a differing shingle."""
    most = (n_x + n_y) * (1 - threshold) / (1 + threshold) + 1e-6
    return np.bitwise_count(x ^ y).sum(axis=-1) <= most


def estimate(x: np.ndarray, y: np.ndarray, samples: int) -> np.ndarray:
    """Estimated Jaccard similarity from the XOR of odd sketches: -inf where the bitmaps look independent."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(2 * differ < BITS, 1 + BITS / (4 * samples) * np.log1p(-2 * np.minimum(differ, BITS / 2) / BITS), -np.inf)


def slack(threshold: float, samples: int) -> float:
    """Six standard deviations of the estimate at the threshold: of the samples, and of bits that fall together."""
    sampled = threshold * (1 - threshold) / samples
    size = 2 * samples * (1 - threshold)
    folded = (BITS / (4 * samples)) ** 2 * max(0.0, np.exp(4 * size / BITS) - 1 - 4 * size / BITS + 4 * size / BITS**2) / BITS
    return 6 * float(np.sqrt(sampled + folded))


def band_hashes(samples: np.ndarray, bands: int) -> np.ndarray:
    n, k = samples.shape
    rows = k // bands
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, 1))
    for r in range(rows):
        out = mix(out ^ samples[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
    return out


def _sketched(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=True)
            names, offsets = shingle_sets(words, size)
            prints = words.fingerprints()
            n = np.diff(offsets)
            samples = signatures(names, offsets, bands * rows)
            hashes = band_hashes(samples, bands)
            sketches = odd_sketches(samples)
            has = n > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * bands))), pa.int32()), signed(np.ascontiguousarray(hashes[has].ravel())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *(pa.array(prints[:, k]) for k in (0, 1)), lists, *(pa.array([x.tobytes() for x in s], pa.binary()) for s in (sketches, parities(names, offsets)))],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "odd", "parity"],
            )

    return run


def _bitmaps(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, bits // 64)


def _passed(threshold: float, samples: int):
    """Candidate pairs whose sketches allow the threshold."""
    least = threshold - slack(threshold, samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_bitmaps(batch.column(c), BITS) for c in ("odd_a", "odd_b"))
            p, q = (_bitmaps(batch.column(c), SET_BITS) for c in ("parity_a", "parity_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            fits = (estimate(x, y, samples) >= least) & allowed(p, q, n_a, n_b, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    return run


def _confirmed(size: int, percent: int):
    """Pairs whose full sets, of shingles told apart exactly, reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "text_a"), "text_b"):
            n = batch.num_rows
            x, at = exact_shingles(Words(pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]), lower=True), size)
            good = []
            for i in range(n):
                p, q = x[at[i] : at[i + 1]], x[at[n + i] : at[n + i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(bool(both) and 100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _blocks_met(threshold: float, samples: int):
    """Within each run of rows of one (key, x, y): pairs of its blocks that the sketches allow, across components."""
    least = threshold - slack(threshold, samples)

    def pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, comps, n = (rows.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
        odd, parity = _bitmaps(rows.column("odd"), BITS), _bitmaps(rows.column("parity"), SET_BITS)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        before = bands[:, : rows.column("band")[0].as_py()]
        mine, x, y = (rows.column(c).to_numpy() for c in ("block", "x", "y"))
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        for i in left:
            others = right[ids[right] > ids[i]] if x[0] == y[0] else right
            others = others[comps[others] != comps[i]]
            if len(others):
                new = ~(before[others] == before[i]).any(axis=1)
                good = others[new & allowed(parity[i], parity[others], n[i], n[others], threshold)]
                good = good[estimate(odd[i], odd[good], samples) >= least]
                yield np.minimum(ids[i], ids[good]), np.maximum(ids[i], ids[good])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([rows.column(c).to_numpy() for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
            found = [p for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for p in pairs(rows.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in found])) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows come in order of key, x, y: all but the last run are whole.
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy() for c in ("key", "x", "y")])
            last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield from out(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: the exact components up to banding's misses."""
    spark = docs.sparkSession
    bounded_batches(spark)
    threshold, samples = percent / 100, bands * rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(texts.mapInArrow(_sketched(size, bands, rows), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, odd binary, parity binary"), "sketches")
    known = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")

    def sketched_pairs(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose odd sketches allow the threshold."""
        a, b = (classes.select(F.col("rep").alias(x), F.col("odd").alias(f"odd_{x}"), F.col("parity").alias(f"parity_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
        both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "odd_a", "odd_b", "parity_a", "parity_b", "n_a", "n_b")
        return both.mapInArrow(_passed(threshold, samples), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), judged on full sets."""
        likely = materialize(pairs, "likely")
        wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        full = materialize(texts.join(wanted.hint("merge"), "doc_id"), "texts")
        a, b = (full.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        met = likely.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b")
        found = materialize(met.mapInArrow(_confirmed(size, percent), "a long, b long").distinct(), "links")
        discard(full)
        return found

    # Classes of equal word sequences; the smallest doc_id stands for its class.
    one = F.min(F.struct("doc_id", "bands", "odd", "parity")).alias("one")
    classes = known.groupBy("f1", "f2", "n_shingles").agg(one).select("f1", "f2", "n_shingles", "one.*")
    classes = materialize(classes.withColumnRenamed("doc_id", "rep"), "classes")
    keys = ["f1", "f2", "n_shingles"]
    member = known.select("doc_id", *keys).join(classes.select(*keys, "rep").hint("merge"), keys).select("doc_id", "rep").distinct()
    member = materialize(member, "members")

    # Buckets with several members, each with the member that shares the most buckets with others as its center. First each
    # member is held against the most central of its centers.
    banded = classes.select(F.posexplode("bands").alias("band", "key"), F.col("rep").alias("id"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(buckets, "buckets")
    shared = materialize(banded.join(buckets.hint("merge"), "key"), "shared")
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    best = F.max(F.struct(F.col("weight"), (-F.col("id")).alias("back"))).alias("best")
    centers = materialize(shared.join(weight.hint("merge"), "id").groupBy("key").agg(best), "centers")
    met = materialize(shared.join(centers.hint("merge"), "key").select("key", "band", "id", "n", (-F.col("best.back")).alias("center"), "best"), "buckets")
    discard(shared)
    star = met.where("id <> center").groupBy(F.col("id").alias("b")).agg(F.max("best").alias("best")).select((-F.col("best.back")).alias("a"), "b")
    links = confirmed(sketched_pairs(star))
    # Texts of rows that share a doc_id belong together.
    ways = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    same = member.join(ways.select("doc_id", "a").hint("merge"), "doc_id").select("a", F.col("rep").alias("b"))
    parts = connected_components(links.unionByName(same))

    # Then against the center of each bucket, where that is in another component; then block by block.
    def opened(parts: DataFrame) -> DataFrame:
        """The members of buckets that span several components."""
        labelled = met.join(parts.hint("merge"), "id", "left").select("key", "band", "id", "n", "center", F.coalesce("component", "id").alias("component"))
        spans = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("id") == F.col("center"), F.col("component"))).alias("central"))
        spans = materialize(spans.where("lo < hi").select("key", "central"), "open")
        return labelled.join(spans.hint("merge"), "key")

    def joined(parts: DataFrame, more: DataFrame) -> DataFrame:
        if more.isEmpty():
            return parts
        return connected_components(parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    stars = opened(parts).where("component <> central").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    parts = joined(parts, confirmed(sketched_pairs(stars)))

    # A pair is judged in the first band that it shares.
    placed = opened(parts).where("id <> center").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", "band", "id", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    spread = spread.join(classes.select(F.col("rep").alias("id"), "n_shingles", "odd", "parity", "bands").hint("merge"), "id")
    ordered = spread.repartition(F.col("key"), F.col("x"), F.col("y")).sortWithinPartitions("key", "x", "y")
    parts = joined(parts, confirmed(ordered.mapInArrow(_blocks_met(threshold, samples), "a long, b long")))

    # Members of a class have its representative's component.
    of = member.join(parts.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    of = of.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = sketched.select("doc_id", "n_shingles").join(of.hint("merge"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """``docs`` without the near duplicates of a smaller doc_id."""
    gone = materialize(near_duplicates(docs, size, percent, bands, rows).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Three words, similarity 0.85: 32 bands of 5 rows."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85, bands=32, rows=5)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS p FROM w)),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
