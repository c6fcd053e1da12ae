"""Reports of a denoised sample: variants, members, lineage, and text like that of the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Representative sequences longer than this are shown cut, with an ellipsis.
SHOWN = 60


def asv_report(members: DataFrame, uniques: DataFrame) -> DataFrame:
    """A row a variant in order of birth; ``Census_Total`` counts its members anew, ``Total_Reads`` may be older."""
    sizes = members.join(uniques.select("sample", "raw_index", "abundance"), ["sample", "raw_index"])
    cluster = ["center_index", "total_reads", "birth_type"]
    made = sizes.groupBy("sample", "cluster_index").agg(*(F.first(c).alias(c) for c in cluster), F.count(F.lit(1)).alias("n"), F.sum("abundance").alias("census"))
    center = uniques.select("sample", F.col("raw_index").alias("center_index"), F.col("abundance").alias("center_abundance"), "sequence")
    return made.join(center, ["sample", "center_index"]).select(
        "sample",
        (F.col("cluster_index") + 1).alias("ASV_ID"),
        F.concat(F.lit("Unique_"), F.col("center_index") + 1).alias("Center_Unique"),
        F.col("center_abundance").alias("Center_Abund"),
        F.col("total_reads").alias("Total_Reads"),
        F.col("n").alias("Unique_Seqs"),
        F.col("birth_type").alias("Birth_Type"),
        F.col("census").alias("Census_Total"),
        F.col("sequence").alias("Sequence"),
    )


def lineage(members: DataFrame) -> DataFrame:
    """A row a variant: where it was split off, and how unlikely and how much more abundant than expected it was."""
    names = ["center_index", "birth_type", "birth_from", "birth_pval", "birth_fold", "birth_e", "self_lambda"]
    return members.groupBy("sample", "cluster_index").agg(*(F.first(c, ignorenulls=False).alias(c) for c in names))


def trace(members: DataFrame) -> DataFrame:
    """(sample, step, line): what each step of the run did; the last one of a sample finds nothing to split off."""
    names = ["birth_type", "birth_from", "birth_pval", "founder", "shuffles"]
    born = members.groupBy("sample", "cluster_index").agg(*(F.first(c, ignorenulls=False).alias(c) for c in names))
    text = F.format_string("Step %d: Unique_%d leaves ASV %d (%s), p %.2e, %d rounds of moves", "cluster_index", F.col("founder") + 1, F.col("birth_from") + 1, "birth_type", "birth_pval", "shuffles")
    steps = born.where("birth_from IS NOT NULL").select("sample", F.col("cluster_index").alias("step"), text.alias("line"))
    last = members.groupBy("sample").agg((F.max("cluster_index") + 1).alias("step"))
    return steps.unionByName(last.select("sample", "step", F.format_string("Step %d: nothing to split off, %d variants", "step", "step").alias("line")))


def shown(sequence):
    return F.when(F.length(sequence) > SHOWN, F.concat(F.substring(sequence, 1, SHOWN - 3), F.lit("..."))).otherwise(sequence)


def report_lines(report: DataFrame) -> DataFrame:
    """(sample, ASV_ID, line): left-aligned columns, and the representative sequence."""
    widths = (("ASV_ID", 6), ("Center_Unique", 16), ("Center_Abund", 12), ("Total_Reads", 12), ("Unique_Seqs", 10), ("Birth_Type", 12))
    line = F.concat_ws(" ", *(F.rpad(F.col(c).cast("string"), w, " ") for c, w in widths))
    return report.select("sample", "ASV_ID", line.alias("line"), F.format_string("ASV %d (Abundance = %d): %s", "ASV_ID", "Center_Abund", shown(F.col("Sequence"))).alias("representative"))
