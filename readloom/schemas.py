"""Schemas of the tables that pass between operators."""

from __future__ import annotations

READS = "sample string, id string, sequence string, qualities array<int>"
UNIQUES = "sample string, raw_index int, sequence string, abundance long, average_qualities array<double>, consensus_qualities array<int>"
COMPARISONS = "cluster_index int, raw_index int, lambda double, hamming int"
#: One row a unique sequence: its cluster, its place there, and its own comparison (null: none).
RECORDS = (
    "sample string, raw_index int, sequence string, abundance long, p_value double, lock boolean, e_minmax double, prior boolean, "
    "cluster_index int, ord int, comp_cluster int, comp_lambda double, comp_hamming int"
)
CLUSTERS = (
    "sample string, cluster_index int, center_index int, total_reads long, self_lambda double, birth_type string, birth_from int, "
    "birth_pval double, birth_fold double, birth_e double, center_abundance long, unique_seqs long, census_total long, sequence string"
)
ALIGNMENTS = "score int, query_align string, ref_align string"
