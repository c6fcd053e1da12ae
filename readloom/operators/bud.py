"""The sequence that should found the next cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(records: DataFrame, clusters: DataFrame, min_fold: float = 1.0, min_hamming: int = 1, min_abundance: int = 1) -> DataFrame:
    """Members that may found a cluster: not the first of theirs, compared, and different enough."""
    totals = clusters.select("cluster_index", "total_reads")
    first = records.groupBy("cluster_index").agg(F.min("ord").alias("__first"))
    met = records.join(totals, "cluster_index").join(first, "cluster_index").where(F.col("ord") > F.col("__first")).drop("__first")
    fold = F.lit(True) if min_fold <= 1 else F.col("abundance") >= F.lit(min_fold) * F.col("comp_lambda") * F.col("total_reads")
    return met.where((F.col("abundance") >= min_abundance) & F.col("comp_lambda").isNotNull() & (F.col("comp_hamming") >= min_hamming) & fold)


def bud_candidate(records: DataFrame, clusters: DataFrame, only_prior: bool = False, **limits) -> DataFrame:
    """At most one row: the least p-value, of equals the most abundant, then the first by (cluster, place)."""
    found = candidates(records, clusters, **limits)
    if only_prior:
        found = found.where("prior")
    best = found.orderBy("p_value", F.col("abundance").desc(), "cluster_index", "ord").limit(1)
    return best.select("cluster_index", "raw_index", "ord", "abundance", "p_value", "comp_lambda", "total_reads", (F.col("comp_lambda") * F.col("total_reads")).alias("birth_e"))
