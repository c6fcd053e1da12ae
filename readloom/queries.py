"""Queries over the derived fixtures, one or more an operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom import scratch
from readloom.fixtures import AMP_SQL, DOC_SQL, STATE_SQL, amplicon_reads, document_reads, state_tables, table
from readloom.partition_sql import compared_sql, gap_sql, partition_sql
from readloom.operators import align, assign, bud, compare, derep, errmodel, homopolymers, kmers, pvalue
from readloom.plans import denoise, report
from readloom.plans.partition import Settings
from readloom.scratch import written
from readloom.sources import fastx, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derep.rank(derep.abundances(amplicon_reads(spark, sf_dir)))


def _doc_uniques(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return derep.rank_large(derep.abundances(document_reads(spark, sf_dir, whole)))


def _with_center(uniques: DataFrame) -> DataFrame:
    """Each unique sequence beside the most abundant one (one row, so it may be broadcast)."""
    center = uniques.where("raw_index = 0").select(F.col("sequence").alias("center"))
    return uniques.crossJoin(F.broadcast(center))


DOC_U = f"""{DOC_SQL},
doc_u AS (SELECT sequence, count(*) AS abundance, row_number() OVER (ORDER BY count(*) DESC, sequence) - 1 AS raw_index FROM doc GROUP BY sequence)"""


# --- reads ----------------------------------------------------------------------------------------------------------


@query(f"WITH {DOC_SQL} SELECT trim(id) AS id, upper(lower(sequence)) AS sequence, length(sequence) AS n_quals, 40 * length(sequence) AS quality_sum FROM doc")
def reads_normalize(spark, sf_dir):
    raw = document_reads(spark, sf_dir).withColumn("id", F.concat(F.lit(" "), "id")).withColumn("sequence", F.lower("sequence"))
    out = fastx.normalize(raw)
    return out.select("id", "sequence", F.size("qualities").cast("long").alias("n_quals"), F.aggregate("qualities", F.lit(0), lambda s, q: s + q).cast("long").alias("quality_sum"))


@query(f"WITH {AMP_SQL} SELECT id, sequence, list_sum([20 + (p * 3 + shift) % 21 FOR p IN range(1, 65)])::BIGINT AS quality_sum, (20 + (64 * 3 + shift) % 21)::INT AS last_quality FROM amp")
def fastx_scan(spark, sf_dir):
    """The amplicon reads, written as FASTQ files and scanned from there."""
    path = scratch.new_path(spark, "fastq")
    sinks.write_fastq(amplicon_reads(spark, sf_dir), path)
    out = fastx.read_fastx(spark, f"{path}/part-*", qual_offset=33)
    return out.select("id", "sequence", F.aggregate("qualities", F.lit(0), lambda s, q: s + q).cast("long").alias("quality_sum"), F.element_at("qualities", -1).alias("last_quality"))


@query(f"WITH {AMP_SQL} SELECT sequence, abundance FROM amp_u")
def derep_abundance(spark, sf_dir):
    return derep.abundances(amplicon_reads(spark, sf_dir)).select("sequence", "abundance")


@query(
    f"""WITH {AMP_SQL}
    SELECT sequence, p AS pos, count(*) AS abundance, sum(20 + (p * 3 + shift) % 21) / count(*) AS average, round(sum(20 + (p * 3 + shift) % 21) / count(*))::INT AS consensus
    FROM amp CROSS JOIN range(1, 65) r(p) GROUP BY sequence, p"""
)
def derep_quality(spark, sf_dir):
    made = derep.position_means(amplicon_reads(spark, sf_dir))
    each = made.select("sequence", "abundance", F.posexplode(F.arrays_zip("average_qualities", "consensus_qualities")).alias("pos", "q"))
    return each.select("sequence", (F.col("pos") + 1).cast("long").alias("pos"), "abundance", F.col("q.average_qualities").alias("average"), F.col("q.consensus_qualities").alias("consensus"))


@query(f"WITH {AMP_SQL} SELECT sum(abundance)::BIGINT AS total_reads, count(*) AS unique_sequences FROM amp_u")
def derep_total(spark, sf_dir):
    return derep.totals(amplicon_reads(spark, sf_dir)).select("total_reads", "unique_sequences")


@query(f"WITH {AMP_SQL} SELECT raw_index::INT AS raw_index, sequence, abundance FROM amp_u")
def derep_rank(spark, sf_dir):
    return derep.dereplicate(amplicon_reads(spark, sf_dir)).select("raw_index", "sequence", "abundance")


@query(f"WITH {AMP_SQL} SELECT raw_index::INT AS raw_index, sequence, abundance FROM amp_u")
def derep_rank_large(spark, sf_dir):
    return derep.dereplicate(amplicon_reads(spark, sf_dir), large=True).select("raw_index", "sequence", "abundance")


# --- k-mers and runs ------------------------------------------------------------------------------------------------

KMER_SQL = """
km AS (SELECT raw_index, substr(sequence, i, 5) AS g FROM (SELECT raw_index, sequence, unnest(range(1, greatest(length(sequence) - 3, 1))) AS i FROM doc_u)),
kc AS (SELECT raw_index, list_reduce([(instr('ACGT', c) - 1)::INT FOR c IN string_split(g, '')], lambda a, b: 4 * a + b)::INT AS kmer_idx, count(*)::INT AS cnt
       FROM km WHERE regexp_full_match(g, '[ACGT]+') GROUP BY ALL)"""


@query(f"WITH {DOC_U}, {KMER_SQL} SELECT raw_index, kmer_idx, cnt FROM kc")
def kmer_counts(spark, sf_dir):
    return kmers.kmer_counts(_doc_uniques(spark, sf_dir)).withColumn("raw_index", F.col("raw_index").cast("long"))


@query(
    f"""WITH {DOC_U}, {KMER_SQL},
    s AS (SELECT b.raw_index, sum(least(a.cnt, b.cnt)) AS shared FROM kc a JOIN kc b ON a.kmer_idx = b.kmer_idx AND a.raw_index = 0 GROUP BY b.raw_index),
    l AS (SELECT u.raw_index, least(length(u.sequence), (SELECT length(sequence) FROM doc_u WHERE raw_index = 0)) AS m FROM doc_u u)
    SELECT l.raw_index AS b, CASE WHEN m < 5 THEN 1.0 ELSE 1.0 - coalesce(shared, 0) / (m - 4) END::DOUBLE AS distance FROM l LEFT JOIN s USING (raw_index)"""
)
def kmer_distance(spark, sf_dir):
    """Of every unique sequence from the first."""
    uniques = _doc_uniques(spark, sf_dir)
    pairs = uniques.select(F.lit(0).alias("a"), F.col("raw_index").alias("b"))
    return kmers.kmer_distances(pairs, uniques).select(F.col("b").cast("long").alias("b"), "distance")


RUN_SQL = """
ch AS (SELECT raw_index, i, sequence[i] AS c FROM (SELECT raw_index, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM doc_u)),
isl AS (SELECT raw_index, c, i, i - row_number() OVER (PARTITION BY raw_index, c ORDER BY i) AS g FROM ch),
runs AS (SELECT raw_index, c, min(i) AS a, count(*) AS n FROM isl GROUP BY raw_index, c, g)"""


@query(
    f"""WITH {DOC_U}, {RUN_SQL},
    m AS (SELECT ch.raw_index, ch.i, r.n >= 3 AS t FROM ch JOIN runs r ON ch.raw_index = r.raw_index AND ch.i BETWEEN r.a AND r.a + r.n - 1)
    SELECT u.raw_index, coalesce(string_agg(CASE WHEN t THEN 'T' ELSE 'F' END, '' ORDER BY i), '') AS mask FROM doc_u u LEFT JOIN m USING (raw_index) GROUP BY u.raw_index"""
)
def homopolymer_mask(spark, sf_dir):
    return homopolymers.masks(_doc_uniques(spark, sf_dir)).withColumn("raw_index", F.col("raw_index").cast("long"))


@query(f"WITH {DOC_U}, {RUN_SQL} SELECT raw_index, (a - 1)::INT AS start, n::INT AS length, c AS base FROM runs WHERE n >= 3")
def homopolymer_runs(spark, sf_dir):
    return homopolymers.runs(_doc_uniques(spark, sf_dir)).withColumn("raw_index", F.col("raw_index").cast("long"))


# --- alignment ------------------------------------------------------------------------------------------------------


def _align_sql(homo: bool, band: int) -> str:
    """Scores of every unique document read (s2) against the first (s1), row by row of the score matrix."""
    inside, start, cost2, cost1 = gap_sql(homo, band)
    return f"""WITH RECURSIVE {DOC_U},
    pr AS (SELECT u.raw_index, c.sequence AS s1, u.sequence AS s2, length(c.sequence) AS n, length(u.sequence) AS m FROM doc_u u CROSS JOIN (SELECT sequence FROM doc_u WHERE raw_index = 0) c),
    cells AS (SELECT raw_index, s1, s2, n, m, unnest(range(0, m + 1)) AS j FROM pr),
    g AS (SELECT *, sum(CASE WHEN j = 0 THEN 0 ELSE {cost2} END) OVER (PARTITION BY raw_index ORDER BY j) AS gs FROM cells),
    dp AS (
      SELECT raw_index, s1, s2, n, m, j, gs, 0::BIGINT AS i, ({start})::BIGINT AS d FROM g
      UNION ALL
      SELECT raw_index, s1, s2, n, m, j, gs, i, CASE WHEN {inside} THEN k + max(t - k) OVER (PARTITION BY raw_index ORDER BY j) ELSE -9999 END::BIGINT
      FROM (SELECT *, CASE WHEN {inside} THEN CASE WHEN j = 0 THEN 0 ELSE greatest(up, diag) END ELSE -9999 END AS t, CASE WHEN i = n THEN 0 ELSE gs END AS k
            FROM (SELECT r.raw_index, s1, s2, n, m, j, gs, r.i + 1 AS i,
                         r.d + CASE WHEN j = m THEN 0 ELSE {cost1} END AS up,
                         lag(r.d) OVER (PARTITION BY r.raw_index ORDER BY j) + CASE WHEN s1[r.i + 1] = s2[j] THEN 5 ELSE -4 END AS diag
                  FROM dp r WHERE r.i < r.n) w) w)
    SELECT raw_index, d::INT AS score FROM dp WHERE i = n AND j = m"""


def _aligned(spark, sf_dir, homo_gap, band) -> DataFrame:
    both = _with_center(_doc_uniques(spark, sf_dir)).select(F.col("raw_index").cast("long").alias("raw_index"), F.col("center").alias("s1"), F.col("sequence").alias("s2"))
    return align.align(both, homo_gap=homo_gap, band=band)


@query(_align_sql(False, -1))
def align_score(spark, sf_dir):
    return _aligned(spark, sf_dir, None, -1).select("raw_index", "score")


@query(_align_sql(True, -1))
def align_score_homo(spark, sf_dir):
    return _aligned(spark, sf_dir, -2, -1).select("raw_index", "score")


@query(_align_sql(True, 16))
def align_banded(spark, sf_dir):
    return _aligned(spark, sf_dir, -2, 16).select("raw_index", "score")


@query()
def align_strings(spark, sf_dir):
    """Of whole documents: every unique one against the most abundant."""
    uniques = _doc_uniques(spark, sf_dir, whole=True)
    # Long texts stand together in the order of ranks; a task takes thousands, which it aligns by length.
    parts = max(spark.sparkContext.defaultParallelism, -(-uniques.count() // 8192))
    both = _with_center(uniques.repartition(parts, "raw_index"))
    pairs = both.select(F.col("raw_index").cast("long").alias("raw_index"), F.col("center").alias("s1"), F.col("sequence").alias("s2"))
    return align.align(pairs, homo_gap=-2, band=16).select("raw_index", "score", "query_align", "ref_align")


# --- error model ----------------------------------------------------------------------------------------------------

RATE_SQL = """
er AS (SELECT t::INT AS trans_idx, q::INT AS q, CASE WHEN t // 4 = t % 4 THEN 1 - e ELSE e / 3 END AS rate
       FROM range(16) a(t) CROSS JOIN (SELECT q, least(pow(10.0, -q / 10.0), 0.75) AS e FROM range(41) b(q)))"""


@query(f"WITH {RATE_SQL} SELECT trans_idx, q, round(rate, 12) AS rate FROM er")
def error_matrix(spark, sf_dir):
    return errmodel.error_table(spark).withColumn("rate", F.round("rate", 12))


CENTER_SQL = f"""{AMP_SQL}, {RATE_SQL},
ql AS (SELECT sequence, p, round(sum(20 + (p * 3 + shift) % 21) / count(*))::INT AS q FROM amp CROSS JOIN range(1, 65) r(p) GROUP BY sequence, p),
pl AS (SELECT u.raw_index, ql.p, c.sequence[ql.p] AS t, u.sequence[ql.p] AS r, ql.q FROM amp_u u JOIN ql ON ql.sequence = u.sequence CROSS JOIN (SELECT sequence FROM amp_u WHERE raw_index = 0) c)"""


@query(
    f"""WITH {CENTER_SQL},
    f AS (SELECT raw_index, list(rate ORDER BY p) AS rates FROM pl JOIN er ON trans_idx = (instr('ACGT', t) - 1) * 4 + instr('ACGT', r) - 1 AND er.q = pl.q GROUP BY raw_index)
    SELECT raw_index::INT AS raw_index, round(log10(list_reduce(rates, lambda a, b: a * b)), 9) AS log_lambda FROM f"""
)
def lambda_ungapped(spark, sf_dir):
    rates = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in errmodel.error_rates()))
    both = _with_center(written(derep.dereplicate(amplicon_reads(spark, sf_dir)), "uniques"))
    # The model goes into the plan once, as a one-row table.
    model = spark.range(1).select(rates.alias("rates"))
    lam = compare.ungapped_lambda(F.col("center"), F.col("sequence"), F.col("consensus_qualities"), F.col("rates"))
    return both.crossJoin(F.broadcast(model)).select("raw_index", F.round(F.log10(lam), 9).alias("log_lambda"))


@query(f"WITH {AMP_SQL} SELECT raw_index::INT AS raw_index, (SELECT count(*) FROM range(1, 65) r(p) WHERE u.sequence[p] <> c.sequence[p])::INT AS hamming FROM amp_u u CROSS JOIN (SELECT sequence FROM amp_u WHERE raw_index = 0) c")
def hamming_ungapped(spark, sf_dir):
    return _with_center(_uniques(spark, sf_dir)).select("raw_index", compare.hamming(F.col("sequence"), F.col("center")).alias("hamming"))


@query(f"WITH RECURSIVE {compared_sql('raw_index = 0')} SELECT raw_index::INT AS raw_index, round(likely, 9) AS log_lambda, subs::INT AS hamming FROM compared")
def compare_center0(spark, sf_dir):
    uniques = written(derep.dereplicate(amplicon_reads(spark, sf_dir)), "uniques")
    center = uniques.where("raw_index = 0").select("sequence").first().sequence
    return compare.against_center(uniques, center).select("raw_index", F.round(F.log10("lambda"), 9).alias("log_lambda"), "hamming")


# --- p-values -------------------------------------------------------------------------------------------------------

TAIL_SQL = """
pv AS (SELECT raw_index, n, e, list_reduce([exp(i * ln(e) - e - lgamma(i + 1.0)) FOR i IN range(0, n)], lambda a, b: a + b) AS cdf FROM asked)"""
ASKED_SQL = f"{STATE_SQL}, asked AS (SELECT raw_index, abundance % 30 + 1 AS n, comp_lambda * 4096 / 8 AS e FROM records WHERE comp_lambda IS NOT NULL)"


@query(f"WITH {ASKED_SQL}, {TAIL_SQL} SELECT raw_index, round(least(greatest((1 - cdf) / (1 - exp(-e)), 0), 1), 9) AS p_value FROM pv")
def pvalue_poisson(spark, sf_dir):
    records, _, _ = state_tables(spark, sf_dir)
    asked = records.where("comp_lambda IS NOT NULL").select(
        "raw_index", (F.col("abundance") % 30 + 1).alias("abundance"), F.col("comp_lambda").alias("lambda"), F.lit(1).alias("hamming"), F.lit(512).alias("total_reads"), F.lit(False).alias("prior")
    )
    # The conditional tail of one read is 1 by either rule.
    return pvalue.pvalues(asked).select("raw_index", F.round("p_value", 9).alias("p_value"))


@query(
    f"""WITH {STATE_SQL},
    x AS (SELECT raw_index, abundance % 5 + 1 AS n, comp_lambda AS l, comp_hamming AS h, prior FROM records),
    y AS (SELECT *, l * 1024 AS e FROM x),
    z AS (SELECT *, list_reduce([exp(i * ln(e) - e - lgamma(i + 1.0)) FOR i IN range(0, n)], lambda a, b: a + b) AS cdf FROM y)
    SELECT raw_index, CASE WHEN l IS NULL OR (n = 1 AND NOT prior) OR h = 0 THEN 1.0 ELSE round(least(greatest(CASE WHEN prior THEN 1 - cdf ELSE (1 - cdf) / (1 - exp(-e)) END, 0), 1), 9) END AS p_value FROM z"""
)
def pvalue_ladder(spark, sf_dir):
    records, _, _ = state_tables(spark, sf_dir)
    asked = records.select("raw_index", (F.col("abundance") % 5 + 1).alias("abundance"), F.col("comp_lambda").alias("lambda"), F.col("comp_hamming").alias("hamming"), F.lit(1024).alias("total_reads"), "prior")
    return pvalue.pvalues(asked).select("raw_index", F.round("p_value", 9).alias("p_value"))


# --- partition steps ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {STATE_SQL},
    e AS (SELECT raw_index, cluster_index, "lambda" * total_reads AS expected FROM comparisons JOIN clusters USING (cluster_index))
    SELECT raw_index, arg_min(cluster_index, (-expected, cluster_index)) AS best_cluster, max(expected) AS expected FROM e GROUP BY raw_index"""
)
def shuffle_best(spark, sf_dir):
    _, comparisons, clusters = state_tables(spark, sf_dir)
    return assign.best_cluster(comparisons, clusters).select("raw_index", "best_cluster", "expected")


@query(
    f"""WITH {STATE_SQL},
    e AS (SELECT raw_index, cluster_index, "lambda" * total_reads AS expected FROM comparisons JOIN clusters USING (cluster_index)),
    b AS (SELECT raw_index, arg_min(cluster_index, (-expected, cluster_index)) AS best FROM e GROUP BY raw_index)
    SELECT r.raw_index, CASE WHEN b.best <> r.cluster_index AND r.raw_index <> c.center_index THEN b.best ELSE r.cluster_index END AS target
    FROM records r LEFT JOIN b USING (raw_index) JOIN clusters c ON c.cluster_index = r.cluster_index"""
)
def shuffle_moves(spark, sf_dir):
    records, comparisons, clusters = state_tables(spark, sf_dir)
    return assign.moves(records, assign.best_cluster(comparisons, clusters), clusters).select("raw_index", "target")


@query(f"WITH {STATE_SQL} SELECT c.cluster_index, sum(abundance)::BIGINT AS census_total, sum(abundance) <> any_value(c.total_reads) AS changed FROM clusters c JOIN records r USING (cluster_index) GROUP BY c.cluster_index")
def cluster_census(spark, sf_dir):
    records, _, clusters = state_tables(spark, sf_dir)
    return assign.census(records, clusters)


@query(f"WITH {STATE_SQL} SELECT cluster_index, arg_min(raw_index, (-abundance, ord)) AS center_index FROM records GROUP BY cluster_index")
def assign_center(spark, sf_dir):
    records, _, _ = state_tables(spark, sf_dir)
    return assign.centers(records)


@query(
    f"""WITH {STATE_SQL}
    SELECT r.cluster_index, raw_index, ord, p_value, comp_lambda * total_reads AS birth_e FROM records r JOIN clusters USING (cluster_index)
    WHERE ord > (SELECT min(ord) FROM records x WHERE x.cluster_index = r.cluster_index) AND comp_lambda IS NOT NULL AND comp_hamming >= 1
    ORDER BY p_value, abundance DESC, r.cluster_index, ord LIMIT 1"""
)
def bud_candidate(spark, sf_dir):
    records, _, clusters = state_tables(spark, sf_dir)
    return bud.bud_candidate(records, clusters).select("cluster_index", "raw_index", "ord", "p_value", "birth_e")


@query(
    f"""WITH {STATE_SQL},
    u AS (SELECT r.*, n."lambda" AS l, n.hamming AS h, n."lambda" * 50000 > 100 AS passed FROM records r LEFT JOIN comparisons n ON n.raw_index = r.raw_index AND n.cluster_index = 3)
    SELECT raw_index, CASE WHEN passed THEN greatest(100, l * 40) ELSE 100 END::DOUBLE AS e_minmax, CASE WHEN passed AND raw_index = 3 THEN l ELSE comp_lambda END AS comp_lambda FROM u"""
)
def compare_upsert(spark, sf_dir):
    """Comparisons of cluster 3 put into the state, with an expectation of 100 so far."""
    records, comparisons, _ = state_tables(spark, sf_dir)
    state = records.withColumn("e_minmax", F.lit(100.0)).withColumn("comp_cluster", F.when(F.col("comp_lambda").isNotNull(), F.col("cluster_index")))
    new = comparisons.where("cluster_index = 3").select("raw_index", "lambda", "hamming")
    out, _ = compare.upsert(state, comparisons, new, cluster=3, center=3, center_reads=40, total_reads=50000)
    return out.select("raw_index", "e_minmax", "comp_lambda")


# --- denoising ------------------------------------------------------------------------------------------------------


def _log(c: str):
    """Of numbers of any size, in a form that does not hang on the last bits; null for 0."""
    return F.round(F.log10(F.when(F.col(c) > 0, F.col(c))), 9)


def _log_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN round(log10({x}), 9) END"


BIRTH_SQL = f"k.self, 9) AS self_lambda, k.kind AS birth_type, k.origin AS birth_from, round(k.pval, 9) AS birth_pval, {_log_sql('k.fold')} AS log_fold, {_log_sql('k.e')} AS log_e"
STANDING_SQL = f"raw_index::INT AS raw_index, cluster::INT AS cluster_index, place::INT AS ord, round(p, 9) AS p_value, {_log_sql('own.l')} AS log_lambda, own.h::INT AS comp_hamming, {_log_sql('most')} AS log_e_minmax, locked"


def _births() -> list:
    return [F.round("self_lambda", 9).alias("self_lambda"), "birth_type", "birth_from", F.round("birth_pval", 9).alias("birth_pval"), _log("birth_fold").alias("log_fold"), _log("birth_e").alias("log_e")]


def _standing(locked: str = "locked") -> list:
    return ["raw_index", "cluster_index", "ord", F.round("p_value", 9).alias("p_value"), _log("comp_lambda").alias("log_lambda"), "comp_hamming", _log("e_minmax").alias("log_e_minmax"), F.col(locked).alias("locked")]


def _members_sql(greedy: bool) -> str:
    return f"WITH RECURSIVE {partition_sql(greedy)} SELECT 'amp' AS sample, {STANDING_SQL}, k.center::INT AS center_index, k.total AS total_reads, round({BIRTH_SQL} FROM members"


def _members(spark, sf_dir, settings: Settings | None = None) -> DataFrame:
    found = denoise.denoise(derep.dereplicate(amplicon_reads(spark, sf_dir)), settings)
    return found.select("sample", *_standing(), "center_index", "total_reads", *_births())


@query(_members_sql(False))
def denoise_members(spark, sf_dir):
    return _members(spark, sf_dir)


@query(f"WITH RECURSIVE {partition_sql()} SELECT {STANDING_SQL}, reads AS abundance, own.c AS comp_cluster FROM members")
def denoise_distributed(spark, sf_dir):
    """The amplicon sample as a large one: distributed ranks and a partition that no task holds as a whole."""
    records, _ = denoise.denoise_large(derep.dereplicate(amplicon_reads(spark, sf_dir), large=True))
    # Places are numbered with gaps there; a cluster is counted in its own window.
    place = (F.row_number().over(Window.partitionBy("cluster_index").orderBy("ord")) - 1).alias("ord")
    return records.withColumn("ord", place).select(*_standing("lock"), "abundance", "comp_cluster")


REPORT_SQL = f"""{partition_sql()},
rep AS (SELECT cluster + 1 AS id, any_value(k) AS k, count(*) AS n, sum(reads)::BIGINT AS census FROM members GROUP BY cluster),
asv AS (SELECT 'amp' AS sample, id::INT AS "ASV_ID", 'Unique_' || (k.center + 1) AS "Center_Unique", abundance AS "Center_Abund", k.total AS "Total_Reads", n AS "Unique_Seqs",
               k.kind AS "Birth_Type", census AS "Census_Total", sequence AS "Sequence" FROM rep JOIN amp_u ON raw_index = k.center)"""


@query(f"WITH RECURSIVE {REPORT_SQL} SELECT * FROM asv")
def denoise_asv_report(spark, sf_dir):
    # The report needs no qualities, so it ranks the plain abundances again.
    return report.asv_report(denoise.denoise(derep.dereplicate(amplicon_reads(spark, sf_dir))), _uniques(spark, sf_dir))


@query(f"WITH RECURSIVE {partition_sql()}, rep AS (SELECT cluster, any_value(k) AS k FROM members GROUP BY cluster) SELECT 'amp' AS sample, cluster AS cluster_index, k.center::INT AS center_index, round({BIRTH_SQL} FROM rep")
def denoise_lineage(spark, sf_dir):
    found = report.lineage(denoise.denoise(derep.dereplicate(amplicon_reads(spark, sf_dir))))
    return found.select("sample", "cluster_index", "center_index", *_births())


@query(
    f"""WITH RECURSIVE {REPORT_SQL}
    SELECT sample, "ASV_ID", concat_ws(' ', rpad("ASV_ID"::VARCHAR, 6, ' '), rpad("Center_Unique", 16, ' '), rpad("Center_Abund"::VARCHAR, 12, ' '), rpad("Total_Reads"::VARCHAR, 12, ' '),
           rpad("Unique_Seqs"::VARCHAR, 10, ' '), rpad("Birth_Type", 12, ' ')) AS line,
           'ASV ' || "ASV_ID" || ' (Abundance = ' || "Center_Abund" || '): ' || CASE WHEN length("Sequence") > 60 THEN "Sequence"[:57] || '...' ELSE "Sequence" END AS representative FROM asv"""
)
def denoise_report_lines(spark, sf_dir):
    return report.report_lines(denoise_asv_report(spark, sf_dir))


@query(_members_sql(True))
def denoise_greedy(spark, sf_dir):
    return _members(spark, sf_dir, Settings(greedy=True))


__all__ = ["QUERIES", "SQL", "table"]
