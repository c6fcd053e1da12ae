"""All sequences against one center: likelihood under the error model, and the upsert of comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.alignment import compare_pairs
from readloom.operators.errmodel import error_rates
from readloom.plans.partition import Settings


def against_center(raws: DataFrame, center: str, settings: Settings | None = None, rates: np.ndarray | None = None) -> DataFrame:
    """(raw_index, lambda, hamming) of each row of ``raws`` (raw_index, sequence, consensus_qualities) against ``center``.

    The center goes out with the function; filter rows that need no alignment before, so that none is made.
    """
    s = settings or Settings()
    rates = error_rates(s.max_q) if rates is None else rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(center, x or "") for x in batch.column("sequence").to_pylist()]
            quals = batch.column("consensus_qualities").to_pylist() if s.use_quals else None
            lam, ham = compare_pairs(pairs, quals, rates, s.match, s.mismatch, s.gap, s.homo_gap, s.band, s.use_quals)
            yield pa.RecordBatch.from_arrays([batch.column("raw_index"), pa.array(lam), pa.array(ham.astype(np.int32))], ["raw_index", "lambda", "hamming"])

    return raws.select("raw_index", "sequence", "consensus_qualities").mapInArrow(run, "raw_index int, lambda double, hamming int")


def ungapped_lambda(true: Column, read: Column, quals: Column, rates: Column) -> Column:
    """The likelihood of an alignment without gaps, as an expression: a left fold in the order of the bases.

    ``rates``: the error model as an array of 16 arrays.
    """

    def code(base: Column) -> Column:
        return F.greatest(F.instr(F.lit("ACGT"), F.upper(base)) - 1, F.lit(0))

    cells = F.zip_with(F.zip_with(F.split(true, ""), F.split(read, ""), lambda t, r: code(t) * 4 + code(r)), quals, lambda k, q: F.struct(k.alias("k"), q.alias("q")))
    last = F.size(F.element_at(rates, 1)) - 1
    return F.aggregate(cells, F.lit(1.0), lambda p, c: p * F.element_at(F.element_at(rates, c.k + 1), F.least(c.q, last) + 1))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two gap-free sequences of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def upsert(records: DataFrame, comparisons: DataFrame, new: DataFrame, cluster: int, center: int, center_reads: int, total_reads: int) -> tuple[DataFrame, DataFrame]:
    """(records, comparisons) after new comparisons with a cluster's center.

    One is kept if it expects more of all reads than the sequence's highest expectation so far; older comparisons of rows
    that fail stay. ``records`` must hold raw_index, e_minmax and the three ``comp_`` columns.
    """
    cols = records.columns
    met = records.join(new.select("raw_index", F.col("lambda").alias("__l"), F.col("hamming").alias("__h")), "raw_index", "left")
    passed = F.coalesce(F.col("__l") * F.lit(float(total_reads)) > F.col("e_minmax"), F.lit(False))
    mine = passed & ((F.lit(cluster) == 0) | (F.col("raw_index") == center))
    kept = met.where(passed).select(F.lit(cluster).cast("int").alias("cluster_index"), "raw_index", F.col("__l").alias("lambda"), F.col("__h").alias("hamming"))
    changed = {
        "e_minmax": F.when(passed, F.greatest("e_minmax", F.col("__l") * F.lit(float(center_reads)))).otherwise(F.col("e_minmax")),
        "comp_cluster": F.when(mine, F.lit(cluster)).otherwise(F.col("comp_cluster")).cast("int"),
        "comp_lambda": F.when(mine, F.col("__l")).otherwise(F.col("comp_lambda")),
        "comp_hamming": F.when(mine, F.col("__h")).otherwise(F.col("comp_hamming")).cast("int"),
    }
    stale = comparisons.join(kept.select("cluster_index", "raw_index"), ["cluster_index", "raw_index"], "left_anti")
    return met.select(*(changed.get(c, F.col(c)).alias(c) for c in cols)), stale.select("cluster_index", "raw_index", "lambda", "hamming").unionByName(kept)
