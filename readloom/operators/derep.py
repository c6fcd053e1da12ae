"""Dereplication: identical reads become one unique sequence with abundance and positional qualities.

Each task first adds up what it has read, a count and a vector of quality sums a sequence, in Arrow batches; only these
partial sums are shuffled. Rank within a sample is by abundance, of equals by sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.scratch import written

#: Bases of sequences (and quality sums) that a task holds before it passes its sums on.
HELD_BASES = 8 << 20


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        sums = pa.ListArray.from_arrays(np.cumsum([0, *(len(v[1]) for v in values)]).astype(np.int32), np.concatenate([v[1] for v in values]) if values else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[0] for v in values], pa.int64()), sums], ["sample", "sequence", "n", "sums"])

    for batch in batches:
        if not batch.num_rows:
            continue
        samples, sequences, quals = (batch.column(c) for c in ("sample", "sequence", "qualities"))
        lengths = np.array([len(s) for s in sequences.to_pylist()])
        ends = quals.offsets.to_numpy()
        if quals.null_count or (np.diff(ends) != lengths).any():
            k = next(i for i, q in enumerate(quals.to_pylist()) if q is None or len(q) != lengths[i])
            raise ValueError(f"read {batch.column('id')[k].as_py()}: {lengths[k]} bases but {len(quals[k].as_py() or [])} qualities")
        keys = pa.StructArray.from_arrays([samples, sequences], ["a", "b"])
        coded = pa.compute.binary_join_element_wise(samples, sequences, "\n").dictionary_encode() if not samples.null_count else None
        code = coded.indices.to_numpy() if coded is not None else np.unique([str(k) for k in keys.to_pylist()], return_inverse=True)[1]
        values = quals.flatten().to_numpy().astype(np.int64)
        starts = ends[:-1] - ends[0]
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]
            length = int(lengths[own[0]])
            total = values[starts[own][:, None] + np.arange(length)].sum(axis=0) if length else np.zeros(0, np.int64)
            key = (samples[int(own[0])].as_py(), sequences[int(own[0])].as_py())
            if key in held:
                held[key][0] += len(own)
                held[key][1] += total
            else:
                held[key] = [len(own), total]
                size += length + 64
        if size > HELD_BASES:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


def quality_sums(reads: DataFrame) -> DataFrame:
    """(sample, sequence, n, sums) of each task's reads."""
    return reads.select("sample", "id", "sequence", "qualities").where("sequence IS NOT NULL").mapInArrow(_partial, "sample string, sequence string, n long, sums array<long>")


def abundances(reads: DataFrame) -> DataFrame:
    """(sample, sequence, abundance)."""
    return reads.where("sequence IS NOT NULL").groupBy("sample", "sequence").agg(F.count(F.lit(1)).alias("abundance"))


def position_means(reads: DataFrame) -> DataFrame:
    """(sample, sequence, abundance, average_qualities, consensus_qualities); consensus rounds halves up, to 255 at most."""
    partial = quality_sums(reads)
    spread = partial.select("sample", "sequence", "n", F.posexplode_outer("sums").alias("pos", "s"))
    at = spread.groupBy("sample", "sequence", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    mean = F.struct(F.col("pos"), (F.col("s") / F.col("n")).alias("mean"))
    made = at.groupBy("sample", "sequence").agg(F.max("n").alias("abundance"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), mean))).alias("m"))
    return made.select(
        "sample",
        "sequence",
        "abundance",
        F.transform("m", lambda x: x.mean).alias("average_qualities"),
        F.transform("m", lambda x: F.least(F.round(x.mean), F.lit(255.0)).cast("int")).alias("consensus_qualities"),
    )


def rank(uniques: DataFrame) -> DataFrame:
    """``uniques`` with ``raw_index``, from 0 in each sample."""
    order = Window.partitionBy("sample").orderBy(F.col("abundance").desc(), F.col("sequence"))
    return uniques.withColumn("raw_index", (F.row_number().over(order) - 1).cast("int"))


def rank_large(uniques: DataFrame) -> DataFrame:
    """As ``rank``, for samples that are too large to be sorted by one task each.

    Rows are dealt by ranges of (sample, abundance, sequence), sorted in their parts and written; a row's rank is its place in its
    part and the sizes of the sample's parts before it, which are a row a part and sample.
    """
    order = [F.col("sample"), F.col("abundance").desc(), F.col("sequence")]
    placed = written(uniques.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("__part", part).withColumn("__place", place).drop("__id")
    sizes = placed.groupBy("sample", "__part").agg(F.min("__place").alias("__begin"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("sample").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("sample").alias("__sample"), "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__begin")).alias("__plus"))
    met = placed.join(sizes, (F.col("sample").eqNullSafe(F.col("__sample"))) & (placed["__part"] == sizes["__part"]))
    return met.select(*uniques.columns, (F.col("__place") + F.col("__plus")).cast("int").alias("raw_index"))


def dereplicate(reads: DataFrame, large: bool = False) -> DataFrame:
    """The unique sequences of each sample, ranked; ``large``: where a sample is too large for one task."""
    return (rank_large if large else rank)(position_means(reads)).select("sample", "raw_index", "sequence", "abundance", "average_qualities", "consensus_qualities")


def totals(reads: DataFrame) -> DataFrame:
    """(sample, total_reads, unique_sequences)."""
    return abundances(reads).groupBy("sample").agg(F.sum("abundance").alias("total_reads"), F.count(F.lit(1)).alias("unique_sequences"))
