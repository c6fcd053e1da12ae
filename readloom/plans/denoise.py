"""Denoising: from ranked unique sequences to sequence variants with members, totals and lineage.

``denoise`` takes samples apart: each is partitioned in one task, samples run beside each other, and a row comes out for
every unique sequence. ``denoise_large`` is for a sample that is too large for one task: sequences stay distributed, each
step is a DataFrame plan, the driver keeps only the list of clusters and gets one candidate row and one count a step.
Both give the same partition. A task of ``denoise`` holds a sample's unique sequences and, for every cluster, two numbers a
sequence, so ``denoise_any`` sends samples of more than ``LARGE`` unique sequences through ``denoise_large``, one after another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.alignment import compare_pairs
from readloom import scratch
from readloom.operators import assign, bud, compare, pvalue
from readloom.operators.errmodel import error_rates
from readloom.plans.partition import Partition, Settings

#: Most unique sequences of a sample that one task partitions.
LARGE = 100_000
_MEMBERS = (
    "sample string, raw_index int, cluster_index int, ord int, p_value double, comp_lambda double, comp_hamming int, e_minmax double, locked boolean, "
    "center_index int, total_reads long, self_lambda double, birth_type string, birth_from int, birth_pval double, birth_fold double, birth_e double, founder int, shuffles int"
)


def partition_frame(uniques: pd.DataFrame, settings: Settings, rates: np.ndarray) -> pd.DataFrame:
    """One sample's partition: a row a sequence with its cluster's columns."""
    uniques = uniques.sort_values("raw_index")
    sequences, quals = uniques["sequence"].tolist(), uniques["consensus_qualities"].tolist()
    s = settings
    # A center is often held against the sequences again after a reassignment; the answer is the same.
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def against(center: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lam, ham = known.setdefault(center, (np.full(len(sequences), np.nan), np.zeros(len(sequences), np.int64)))
        new = wanted[np.isnan(lam[wanted])]
        if len(new):
            pairs = [(sequences[center], sequences[i]) for i in new]
            lam[new], ham[new] = compare_pairs(pairs, [quals[i] for i in new], rates, s.match, s.mismatch, s.gap, s.homo_gap, s.band, s.use_quals)
        return lam[wanted], ham[wanted]

    prior = uniques["prior"].to_numpy() if "prior" in uniques else None
    part = Partition(uniques["abundance"].to_numpy(), settings, against, prior).run()
    raw_of, rows = uniques["raw_index"].to_numpy(), []
    for c, k in enumerate(part.clusters):
        for place, i in enumerate(k.members):
            known = part.comp_cluster[i] >= 0
            rows.append(
                (uniques["sample"].iloc[0], raw_of[i], c, place, part.p[i], part.comp_lam[i] if known else None, int(part.comp_ham[i]) if known else None, part.e_minmax[i], bool(part.lock[i]),
                 raw_of[k.center], k.total, k.self_lambda, k.birth_type, k.birth_from, k.birth_pval, k.birth_fold, k.birth_e, raw_of[k.founder], k.shuffles)
            )
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in _MEMBERS.split(", ")])
    return out.astype({"comp_hamming": "Int32", "birth_from": "Int32"})


def denoise(uniques: DataFrame, settings: Settings | None = None, rates: np.ndarray | None = None) -> DataFrame:
    """A row a unique sequence: its cluster, its place there, and what is known of both."""
    s = settings or Settings()
    rates = error_rates(s.max_q) if rates is None else rates
    cols = [c for c in ("sample", "raw_index", "sequence", "abundance", "consensus_qualities", "prior") if c in uniques.columns]
    return uniques.select(*cols).groupBy("sample").applyInPandas(lambda pdf: partition_frame(pdf, s, rates), _MEMBERS)


# --- one large sample -----------------------------------------------------------------------------------------------


class _Tables:
    """Tables of a run. A table may be made from its last version, which is deleted once the one after it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch.new_path(spark, "denoise")
        self.n = 0
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if old := self.paths.get(name):
            scratch.delete(self.spark, old)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                scratch.delete(self.spark, path)


def denoise_large(uniques: DataFrame, settings: Settings | None = None, rates: np.ndarray | None = None) -> tuple[DataFrame, list[dict]]:
    """(records, clusters) of one sample; ``records`` as in ``readloom.schemas.RECORDS`` without sample and sequence."""
    spark, s = uniques.sparkSession, settings or Settings()
    store = _Tables(spark)
    prior = F.col("prior") if "prior" in uniques.columns else F.lit(False)
    raws = store.put("raws", uniques.select("raw_index", "sequence", "abundance", "consensus_qualities", prior.alias("prior")))
    n, total = raws.agg(F.count(F.lit(1)), F.sum("abundance")).first()
    if not n:
        raise ValueError("a sample without sequences cannot be partitioned")
    nothing = F.lit(None)
    records = store.put(
        "records",
        raws.select(
            "raw_index", "abundance", F.lit(1.0).alias("p_value"), F.lit(False).alias("lock"), F.lit(0.0).alias("e_minmax"), "prior", F.lit(0).alias("cluster_index"), F.col("raw_index").alias("ord"),
            nothing.cast("int").alias("comp_cluster"), nothing.cast("double").alias("comp_lambda"), nothing.cast("int").alias("comp_hamming"),
        ),
    )
    comparisons = spark.createDataFrame([], "cluster_index int, raw_index int, lambda double, hamming int")
    clusters = [{"center_index": 0, "total_reads": int(total), "self_lambda": 1.0, "birth_type": "I", "birth_from": None, "birth_pval": 1.0, "birth_fold": 1.0, "birth_e": 0.0, "founder": 0, "shuffles": 0, "update_e": True, "check_locks": True}]

    turn = {"records": 0, "comparisons": 0}

    def other(name: str) -> str:
        """Two names in turn, so that a new version is written once while the last one is still read."""
        turn[name] ^= 1
        return f"{name}{turn[name] or ''}"

    def cluster_table() -> DataFrame:
        rows = [(c, k["center_index"], k["total_reads"]) for c, k in enumerate(clusters)]
        return spark.createDataFrame(rows, "cluster_index int, center_index int, total_reads long").coalesce(1)

    def held_against(c: int) -> None:
        nonlocal records, comparisons
        center = clusters[c]["center_index"]
        row = raws.where(F.col("raw_index") == center).first()
        wanted = raws
        if s.greedy:
            open_rows = records.where(~F.col("lock") & (F.col("abundance") <= row.abundance)).select("raw_index")
            wanted = raws.join(open_rows, "raw_index", "left_semi")
        new = store.put("new", compare.against_center(wanted, row.sequence, s, rates))
        own = new.where(F.col("raw_index") == center).first()
        if own:
            clusters[c]["self_lambda"] = own["lambda"]
        after, kept = compare.upsert(records, comparisons, new, c, center, row.abundance, int(total))
        after = store.put(other("records"), after)  # both are made from both old tables
        comparisons = store.put(other("comparisons"), kept)
        records = after

    def refreshed() -> None:
        nonlocal records
        stale = [c for c, k in enumerate(clusters) if k["update_e"]]
        known = comparisons.select("cluster_index", "raw_index", "lambda", "hamming")
        met = records.join(known, ["cluster_index", "raw_index"], "left").join(cluster_table(), "cluster_index")
        asked = pvalue.pvalues(met.where(F.col("cluster_index").isin(stale)), s.detect_singletons, s.pvalue)
        every = asked.unionByName(met.where(~F.col("cluster_index").isin(stale)).select(*asked.columns))
        lock = F.col("lock")
        if s.greedy:
            checked = [c for c, k in enumerate(clusters) if k["check_locks"]]
            reads = records.select(F.col("raw_index").alias("center_index"), F.col("abundance").alias("__reads"))
            every = every.join(reads, "center_index")
            sure = F.coalesce(F.col("__reads") * F.col("lambda") > F.col("abundance"), F.lit(False)) | (F.col("raw_index") == F.col("center_index"))
            lock = lock | (F.col("cluster_index").isin(checked) & sure)
        records = store.put(other("records"), every.withColumn("lock", lock).select(*records.columns))
        for k in clusters:
            k["update_e"] = False
            k["check_locks"] = k["check_locks"] and not s.greedy

    def shuffled() -> bool:
        nonlocal records
        best = assign.best_cluster(comparisons, cluster_table())
        gone = store.put("moves", assign.moves(records, best, cluster_table()))
        if gone.where("moved").isEmpty():
            return False
        # Who stays keeps its order; arrivals follow, by the cluster that they left and there from its end.
        last = gone.groupBy("target").agg(F.max(F.when(~F.col("moved"), F.col("ord"))).alias("__last"))
        order = F.row_number().over(_window(["target"], [F.col("cluster_index"), F.col("ord").desc()]))
        arrivals = gone.where("moved").join(last, "target").withColumn("__ord", F.coalesce("__last", F.lit(-1)) + order).drop("__last")
        met = gone.where("NOT moved").withColumn("__ord", F.col("ord")).unionByName(arrivals)
        changed = {
            "cluster_index": F.col("target").cast("int"),
            "ord": F.col("__ord").cast("int"),
            "comp_cluster": F.when(F.col("moved"), F.col("target")).otherwise(F.col("comp_cluster")).cast("int"),
            "comp_lambda": F.when(F.col("moved"), F.col("best_lambda")).otherwise(F.col("comp_lambda")),
            "comp_hamming": F.when(F.col("moved"), F.col("best_hamming")).otherwise(F.col("comp_hamming")).cast("int"),
            "lock": F.lit(False),
        }
        records = store.put(other("records"), met.select(*(changed.get(c, F.col(c)).alias(c) for c in records.columns)))
        for row in assign.census(records, cluster_table()).join(assign.centers(records), "cluster_index", "left").collect():  # a row a cluster
            k = clusters[row.cluster_index]
            k["update_e"] = k["update_e"] or row.changed
            k["total_reads"], k["check_locks"] = row.census_total, True
            k["center_index"] = k["center_index"] if row.center_index is None else row.center_index
        return True

    def split() -> bool:
        nonlocal records
        limits = {"min_fold": s.min_fold, "min_hamming": s.min_hamming, "min_abundance": s.min_abundance}
        for only_prior, omega, kind in ((False, s.omega_a, "A"), (True, s.omega_p, "P")):
            row = bud.bud_candidate(records, cluster_table(), only_prior, **limits).first()
            if row is None:
                continue
            p = row.p_value * (1 if only_prior else n)
            if p < omega:
                fold = row.abundance / row.birth_e if row.birth_e else float("inf")
                clusters.append({"center_index": row.raw_index, "total_reads": row.abundance, "self_lambda": 1.0, "birth_type": kind, "birth_from": row.cluster_index, "birth_pval": p, "birth_fold": fold, "birth_e": row.birth_e, "founder": row.raw_index, "shuffles": 0, "update_e": True, "check_locks": True})
                if len(clusters) > s.max_clusters:
                    raise RuntimeError(f"more than {s.max_clusters} clusters")
                own = F.col("raw_index") == row.raw_index
                moved = records.withColumn("cluster_index", F.when(own, len(clusters) - 1).otherwise(F.col("cluster_index")).cast("int")).withColumn("ord", F.when(own, 0).otherwise(F.col("ord")).cast("int"))
                records = store.put(other("records"), moved)
                return True
        return False

    held_against(0)
    refreshed()
    while split():
        held_against(len(clusters) - 1)
        born = clusters[-1]
        while shuffled():
            for c, k in enumerate(clusters):
                if k["update_e"]:
                    held_against(c)
            born["shuffles"] += 1
            if born["shuffles"] > s.max_shuffles:
                raise RuntimeError(f"the partition did not settle in {born['shuffles']} shuffles")
        refreshed()
    store.drop("raws", "new", "moves", other("records"), other("comparisons"), other("comparisons"))
    return records, clusters


def denoise_any(uniques: DataFrame, settings: Settings | None = None, rates: np.ndarray | None = None, large: int = LARGE) -> DataFrame:
    """As ``denoise``, samples of any size side by side; ``uniques`` should be written, as every large sample reads it.

    The driver gets a row a large sample. In these, ``ord`` follows the places in a cluster with gaps.
    """
    big = [r.sample for r in uniques.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("sample").collect()]
    if not big:
        return denoise(uniques, settings, rates)
    known = sorted(x for x in big if x is not None)
    is_big = F.coalesce(F.col("sample").isin(known), F.lit(None in big))
    out = denoise(uniques.where(~is_big), settings, rates)
    names = [f.split()[0] for f in _MEMBERS.split(", ")]
    for name in [*known, *([None] if None in big else [])]:
        records, clusters = denoise_large(uniques.where(F.col("sample").eqNullSafe(F.lit(name))), settings, rates)
        of_cluster = names[names.index("center_index") :]
        kinds = ", ".join(["cluster_index int", *(f for f in _MEMBERS.split(", ") if f.split()[0] in of_cluster)])
        rows = [(c, *(k[f] for f in of_cluster)) for c, k in enumerate(clusters)]
        met = records.withColumnRenamed("lock", "locked").join(uniques.sparkSession.createDataFrame(rows, kinds), "cluster_index")
        out = out.unionByName(met.withColumn("sample", F.lit(name).cast("string")).select(*names))
    return out


def _window(keys: list[str], order: list):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


