"""Abundance p-values as a column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.poisson import abundance_pvalue


def pvalues(rows: DataFrame, detect_singletons: bool = False, method: str = "one_minus_cdf") -> DataFrame:
    """``rows`` (abundance, lambda, hamming, total_reads, prior, ...) with ``p_value``; a null lambda is no comparison.

    The cases that need no tail are decided by an expression; only the rest goes through Python.
    """
    names = [c for c in rows.columns if c != "p_value"]
    sure = F.col("prior") | F.lit(detect_singletons)
    case = (
        F.when(F.col("lambda").isNull(), 1.0)
        .when((F.col("abundance") == 1) & ~sure, 1.0)
        .when(F.col("hamming") == 0, 1.0)
        .when(F.col("lambda") == 0, 0.0)
    )
    cased = rows.select(*names, case.alias("p_value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lam, total = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("abundance", "lambda", "total_reads"))
            prior = batch.column("prior").to_numpy(zero_copy_only=False).astype(bool) | detect_singletons
            p = pa.array(abundance_pvalue(n, lam * total, prior, method).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), p], [*names, "p_value"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cased.schema)
    return cased.where("p_value IS NOT NULL").unionByName(cased.where("p_value IS NULL").mapInArrow(run, kinds))
