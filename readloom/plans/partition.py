"""Divisive partitioning of one sample's unique sequences, as vectors over the sequences.

The caller supplies ``compare(center, wanted)``, which gives the likelihood and the substitutions of the wanted sequences
against a center; everything else is bookkeeping. Several things stay stale on purpose, because results depend on it: old
comparisons outlive a new one that fails the expectation test, a parent's total is not counted again when a sequence
leaves it, p-values are refreshed only where a total changed, and a sequence's own comparison is another copy than its
cluster's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from readloom.functions.poisson import pvalue_ladder

Compare = Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Settings:
    """Parameters of a run; the defaults are those of the command line."""

    omega_a: float = 1e-40
    omega_p: float = 1e-40
    use_quals: bool = True
    match: int = 5
    mismatch: int = -4
    gap: int = -8
    homo_gap: int = -2
    band: int = 16
    greedy: bool = False
    max_q: int = 40
    detect_singletons: bool = False
    pvalue: str = "one_minus_cdf"
    min_fold: float = 1.0
    min_hamming: int = 1
    min_abundance: int = 1
    #: Guards that raise; results are never cut short silently.
    max_clusters: int = 100_000
    max_shuffles: int = 10_000


@dataclass
class Cluster:
    center: int
    members: list[int]
    total: int
    n: int
    birth_type: str = "I"
    birth_from: int | None = None
    birth_pval: float = 1.0
    birth_fold: float = 1.0
    birth_e: float = 0.0
    self_lambda: float = 1.0
    #: The sequence that founded the cluster (the center may be another one later), and the rounds of moves that followed.
    founder: int = 0
    shuffles: int = 0
    update_e: bool = True
    check_locks: bool = True
    lam: np.ndarray = field(init=False)
    ham: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lam, self.ham = np.full(self.n, np.nan), np.zeros(self.n, np.int64)


class Partition:
    def __init__(self, abundance: np.ndarray, settings: Settings, compare: Compare, prior: np.ndarray | None = None):
        n = len(abundance)
        if not n:
            raise ValueError("a sample without sequences cannot be partitioned")
        self.abundance, self.settings, self._compare = np.asarray(abundance, np.int64), settings, compare
        self.total_reads = int(self.abundance.sum())
        self.p, self.lock, self.e_minmax = np.ones(n), np.zeros(n, bool), np.zeros(n)
        self.prior = np.zeros(n, bool) if prior is None else np.asarray(prior, bool)
        self.comp_cluster, self.comp_lam, self.comp_ham = np.full(n, -1), np.full(n, np.nan), np.zeros(n, np.int64)
        self.clusters = [Cluster(0, list(range(n)), self.total_reads, n)]

    def compare(self, c: int) -> None:
        """Hold all sequences against a cluster's center; keep what passes the expectation test."""
        cluster = self.clusters[c]
        reads = int(self.abundance[cluster.center])
        wanted = np.arange(len(self.abundance))
        if self.settings.greedy:
            wanted = wanted[(self.abundance <= reads) & ~self.lock]
        lam, ham = self._compare(cluster.center, wanted)
        own = wanted == cluster.center
        if own.any():
            cluster.self_lambda = float(lam[own][0])
        passed = lam * self.total_reads > self.e_minmax[wanted]
        rows, lam, ham = wanted[passed], lam[passed], ham[passed]
        self.e_minmax[rows] = np.maximum(self.e_minmax[rows], lam * reads)
        cluster.lam[rows], cluster.ham[rows] = lam, ham
        mine = np.ones(len(rows), bool) if c == 0 else rows == cluster.center
        self.comp_cluster[rows[mine]], self.comp_lam[rows[mine]], self.comp_ham[rows[mine]] = c, lam[mine], ham[mine]

    def update_pvalues(self) -> None:
        s = self.settings
        for cluster in self.clusters:
            rows = np.array(cluster.members, np.int64)
            if cluster.update_e:
                lam = cluster.lam[rows]
                self.p[rows] = pvalue_ladder(self.abundance[rows], ~np.isnan(lam), np.nan_to_num(lam), cluster.ham[rows], cluster.total, self.prior[rows], s.detect_singletons, s.pvalue)
                cluster.update_e = False
            if s.greedy and cluster.check_locks:
                sure = self.abundance[cluster.center] * np.nan_to_num(cluster.lam[rows]) > self.abundance[rows]
                self.lock[rows[sure | (rows == cluster.center)]] = True
                cluster.check_locks = False

    def shuffle(self) -> bool:
        """Move every sequence to the cluster that expects it most; of equals the first. Centers stay."""
        best_e, best = np.zeros(len(self.abundance)), np.full(len(self.abundance), -1)
        for c, cluster in enumerate(self.clusters):
            e = np.where(np.isnan(cluster.lam), -np.inf, cluster.lam * cluster.total)
            better = e > best_e
            best_e[better], best[better] = e[better], c
        moves: list[tuple[int, int]] = []
        arrivals: list[list[int]] = [[] for _ in self.clusters]
        # Clusters are walked in order and each from its end, so a sequence that arrives before its new cluster's turn
        # is met again there, where it already is at its best.
        for c, cluster in enumerate(self.clusters):
            leaving = [raw for raw in reversed(cluster.members) if best[raw] not in (-1, c) and raw != cluster.center]
            if leaving:
                gone = set(leaving)
                cluster.members = [raw for raw in cluster.members if raw not in gone]
                for raw in leaving:
                    arrivals[best[raw]].append(raw)
                    moves.append((raw, int(best[raw])))
        for cluster, new in zip(self.clusters, arrivals, strict=True):
            cluster.members += new
        for raw, c in moves:
            self.comp_cluster[raw], self.comp_lam[raw], self.comp_ham[raw] = c, self.clusters[c].lam[raw], self.clusters[c].ham[raw]
        return bool(moves)

    def census(self) -> None:
        for cluster in self.clusters:
            total = int(self.abundance[cluster.members].sum())
            cluster.update_e |= total != cluster.total
            cluster.total = total

    def assign_centers(self) -> None:
        """The most abundant member becomes the center, of equals the first; it keeps its place among the members."""
        for cluster in self.clusters:
            rows = np.array(cluster.members, np.int64)
            self.lock[rows] = False
            if len(rows):
                cluster.center = int(rows[np.argmax(self.abundance[rows])])
            cluster.check_locks = True

    def candidate(self, only_prior: bool = False) -> tuple[int, int] | None:
        """(cluster, place) of the least likely member that may found a cluster; of equals the most abundant, then the first."""
        s, best, at = self.settings, None, None
        for c, cluster in enumerate(self.clusters):
            rows = np.array(cluster.members[1:], np.int64)
            if not len(rows):
                continue
            ok = (self.abundance[rows] >= s.min_abundance) & (self.comp_cluster[rows] >= 0) & (self.comp_ham[rows] >= s.min_hamming)
            if s.min_fold > 1:
                ok &= self.abundance[rows] >= s.min_fold * np.nan_to_num(self.comp_lam[rows]) * cluster.total
            if only_prior:
                ok &= self.prior[rows]
            places = np.flatnonzero(ok)
            if len(places):
                k = places[np.lexsort((places, -self.abundance[rows[places]], self.p[rows[places]]))[0]]
                key = (self.p[rows[k]], -self.abundance[rows[k]])
                if best is None or key < best:
                    best, at = key, (c, int(k) + 1)
        return at

    def bud(self) -> int | None:
        """Split off a cluster if a sequence is too abundant to be errors; its number, or None."""
        for only_prior, kind in ((False, "A"), (True, "P")):
            at = self.candidate(only_prior)
            if at is None:
                continue
            c, place = at
            raw = self.clusters[c].members[place]
            p = float(self.p[raw]) * (1 if only_prior else len(self.abundance))
            if p < (self.settings.omega_p if only_prior else self.settings.omega_a):
                del self.clusters[c].members[place]
                expected = float(self.comp_lam[raw]) * self.clusters[c].total
                reads = int(self.abundance[raw])
                fold = reads / expected if expected else float("inf")
                self.clusters.append(Cluster(raw, [raw], reads, len(self.abundance), kind, c, p, fold, expected, founder=raw))
                if len(self.clusters) > self.settings.max_clusters:
                    raise RuntimeError(f"more than {self.settings.max_clusters} clusters")
                return len(self.clusters) - 1
        return None

    def run(self) -> Partition:
        self.compare(0)
        self.update_pvalues()
        while (new := self.bud()) is not None:
            self.compare(new)
            born = self.clusters[new]
            while self.shuffle():
                self.census()
                self.assign_centers()
                for c, cluster in enumerate(self.clusters):
                    if cluster.update_e:
                        self.compare(c)
                born.shuffles += 1
                if born.shuffles > self.settings.max_shuffles:
                    raise RuntimeError(f"the partition did not settle in {born.shuffles} shuffles")
            self.update_pvalues()
        return self
