"""Reassignment, census and centers of a partition, over state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_cluster(comparisons: DataFrame, clusters: DataFrame) -> DataFrame:
    """(raw_index, best_cluster, expected): the cluster that expects a sequence most, of equals the lowest."""
    totals = clusters.select("cluster_index", "total_reads")
    expected = comparisons.join(totals, "cluster_index").select("raw_index", "cluster_index", "lambda", "hamming", (F.col("lambda") * F.col("total_reads")).alias("expected"))
    best = F.max(F.struct("expected", (-F.col("cluster_index")).alias("back"), "lambda", "hamming")).alias("b")
    return expected.groupBy("raw_index").agg(best).select("raw_index", (-F.col("b.back")).cast("int").alias("best_cluster"), F.col("b.expected").alias("expected"), F.col("b.lambda").alias("best_lambda"), F.col("b.hamming").alias("best_hamming"))


def moves(records: DataFrame, best: DataFrame, clusters: DataFrame) -> DataFrame:
    """``records`` with ``target``, the cluster each sequence belongs in now, and ``moved``; a center stays in its cluster."""
    centers = clusters.select("cluster_index", "center_index")
    met = records.join(best, "raw_index", "left").join(centers, "cluster_index")
    goes = F.coalesce((F.col("best_cluster") != F.col("cluster_index")) & (F.col("raw_index") != F.col("center_index")), F.lit(False))
    return met.withColumn("moved", goes).withColumn("target", F.when(F.col("moved"), F.col("best_cluster")).otherwise(F.col("cluster_index"))).drop("center_index")


def census(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_index, census_total, changed): reads of each cluster's members, and whether the known total differs."""
    counted = records.groupBy("cluster_index").agg(F.sum("abundance").alias("counted"))
    total = F.coalesce("counted", F.lit(0))
    return clusters.join(counted, "cluster_index", "left").select("cluster_index", total.alias("census_total"), (total != F.col("total_reads")).alias("changed"))


def centers(records: DataFrame) -> DataFrame:
    """(cluster_index, center_index): the most abundant member, of equals the first in member order."""
    return records.groupBy("cluster_index").agg(F.min_by("raw_index", F.struct((-F.col("abundance")).alias("a"), F.col("ord"))).alias("center_index"))
