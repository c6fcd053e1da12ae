"""DuckDB SQL for gapped comparisons of amplicon reads and for the whole partition of the sample, to hold the queries against.

It shares no code with the operators: alignments go cell by cell, and the partition is one recursive query whose rows are
the unique sequences. Each turn of it does one thing: hold all sequences against one center (phase C), move sequences to the
cluster that expects them most or else refresh p-values (S), or found a cluster (B), until none is founded (E).
"""

from __future__ import annotations

from readloom.fixtures import AMP_SQL


def gap_sql(homo: bool, band: int) -> tuple[str, str, str, str]:
    """Of a cell of row w and column j: whether it is in the band; the first row's score; what a base of s2 costs, and of s1 (row r.i + 1)."""
    inside = f"abs(w.j - w.i) <= {band} + (CASE WHEN w.j - w.i > 0 THEN greatest(w.m - w.n, 0) ELSE greatest(w.n - w.m, 0) END)" if band >= 0 else "TRUE"
    start = f"CASE WHEN j > {band} + greatest(m - n, 0) THEN -9999 ELSE 0 END" if band >= 0 else "0"

    def triple(s: str, at: str, n: str) -> str:
        return "(" + " OR ".join(f"({at} - {k} >= 1 AND {at} - {k} + 2 <= {n} AND {s}[{at} - {k}] = {s}[{at} - {k} + 1] AND {s}[{at} - {k}] = {s}[{at} - {k} + 2])" for k in range(3)) + ")"

    cost2 = f"CASE WHEN {triple('s2', 'j', 'm')} THEN -2 ELSE -8 END" if homo else "-8"
    cost1 = f"CASE WHEN {triple('s1', '(r.i + 1)', 'r.n')} THEN -2 ELSE -8 END" if homo else "-8"
    return inside, start, cost2, cost1


def compared_sql(centers: str) -> str:
    """CTEs up to ``compared`` (center, raw_index, likely, subs): log likelihood and substitutions of every unique amplicon
    read (s2) against those (s1) for which ``centers`` holds, along the best alignment.

    Besides its score each cell of the matrix carries the log likelihood and the substitutions of the best way to it. In a
    row, ways go left from the last cell that was reached from above; of equal ways up comes first, then left.
    """
    inside, start, cost2, cost1 = gap_sql(True, 16)
    w = "OVER (PARTITION BY center, raw_index ORDER BY j)"
    own = "center, raw_index, s1, s2, n, m, j, gs, e, inserted"
    return f"""{AMP_SQL},
    ql AS (SELECT sequence, p, round(sum(20 + (p * 3 + shift) % 21) / count(*))::INT AS q FROM amp CROSS JOIN range(1, 65) r(p) GROUP BY sequence, p),
    pr AS (SELECT c.raw_index AS center, u.raw_index, c.sequence AS s1, u.sequence AS s2, length(c.sequence) AS n, length(u.sequence) AS m
           FROM amp_u u CROSS JOIN (SELECT raw_index, sequence FROM amp_u WHERE {centers}) c),
    cells AS (SELECT center, raw_index, s1, s2, n, m, unnest(range(0, m + 1)) AS j FROM pr),
    wrong AS (SELECT c.*, least(pow(10.0, -least(q, 40) / 10.0), 0.75) AS e FROM cells c LEFT JOIN ql ON ql.sequence = s2 AND p = j),
    g AS (SELECT *, sum(CASE WHEN j = 0 THEN 0 ELSE {cost2} END) {w} AS gs, sum(CASE WHEN j = 0 THEN 0.0 ELSE log10(1 - e) END) {w} AS inserted FROM wrong),
    dp AS (
      SELECT {own}, 0::BIGINT AS i, ({start})::BIGINT AS d, inserted::DOUBLE AS likely, 0::BIGINT AS subs FROM g
      UNION ALL
      SELECT {own}, i, d,
             (inserted + last_value(CASE step WHEN 'u' THEN up_likely - inserted WHEN 'd' THEN diag_likely - inserted END IGNORE NULLS) {w})::DOUBLE,
             (last_value(CASE step WHEN 'u' THEN up_subs WHEN 'd' THEN diag_subs END IGNORE NULLS) {w})::BIGINT
      FROM (SELECT *, CASE WHEN j = 0 OR up = d THEN 'u' WHEN lag(d) {w} + k - lag(k) {w} = d THEN 'l' ELSE 'd' END AS step
      FROM (SELECT *, CASE WHEN {inside} THEN k + max(t - k) {w} ELSE -9999 END::BIGINT AS d
      FROM (SELECT *, CASE WHEN {inside} THEN CASE WHEN j = 0 THEN 0 ELSE greatest(up, diag) END ELSE -9999 END AS t, CASE WHEN i = n THEN 0 ELSE gs END AS k
            FROM (SELECT {own}, r.i + 1 AS i,
                         r.d + CASE WHEN j = m THEN 0 ELSE {cost1} END AS up, likely AS up_likely, subs AS up_subs,
                         lag(r.d) {w} + CASE WHEN s1[r.i + 1] = s2[j] THEN 5 ELSE -4 END AS diag,
                         lag(likely) {w} + log10(CASE WHEN s1[r.i + 1] = s2[j] THEN 1 - e ELSE e / 3 END) AS diag_likely,
                         lag(subs) {w} + (s1[r.i + 1] <> s2[j])::INT AS diag_subs
                  FROM dp r WHERE r.i < r.n) w) w) w) w),
    compared AS MATERIALIZED (SELECT center, raw_index, likely, subs FROM dp WHERE i = n AND j = m)"""


_CLUSTER = "STRUCT(center BIGINT, total BIGINT, stale BOOLEAN, unlocked BOOLEAN, self DOUBLE, kind VARCHAR, origin INT, pval DOUBLE, fold DOUBLE, e DOUBLE)"
_KNOWN = "STRUCT(c INT, l DOUBLE, h BIGINT)"
_P = """list_reduce([exp(i * ln(mean) - mean - lgamma(i + 1.0)) FOR i IN range(0, reads)], lambda a, b: a + b)"""
_MEAN = "(known[cluster + 1].l * cl[cluster + 1].total)"

def partition_sql(greedy: bool = False) -> str:
    """CTEs up to ``members``: a row a sequence of the amplicon sample, with its cluster as ``k``.

    A center has at least two reads, as a single read has p-value 1 (no sequence is a prior). Tails under 1e-14 are 0, as one
    minus a distribution function near one is.
    """
    wanted = "(b.center_reads >= r.reads AND NOT r.locked)" if greedy else "TRUE"
    return f"""{compared_sql("abundance > 1")},
    held AS MATERIALIZED (SELECT center, c.raw_index, pow(10.0, likely) AS l, subs AS h, u.abundance AS center_reads FROM compared c JOIN amp_u u ON u.raw_index = center),
    run AS (
      SELECT raw_index, abundance AS reads, (sum(abundance) OVER ())::BIGINT AS n_reads, count(*) OVER () AS n, 0::INT AS cluster, raw_index::BIGINT AS ord,
             []::{_KNOWN}[] AS known, 0.0::DOUBLE AS most, FALSE AS locked, NULL::{_KNOWN} AS own, 1.0::DOUBLE AS p, 'C' AS phase, 0::INT AS pos, 0::BIGINT AS turn,
             [{{'center': 0, 'total': sum(abundance) OVER (), 'stale': TRUE, 'unlocked': TRUE, 'self': 1.0, 'kind': 'I', 'origin': NULL, 'pval': 1.0, 'fold': 1.0, 'e': 0.0}}]::{_CLUSTER}[] AS cl
      FROM amp_u
      UNION ALL
      SELECT raw_index, reads, n_reads, n, new_cluster, new_ord,
             CASE WHEN phase = 'C' THEN [CASE WHEN k <> pos THEN known[k + 1] WHEN passed THEN met ELSE known[k + 1] END FOR k IN range(0, len(cl))]::{_KNOWN}[] ELSE known END,
             CASE WHEN passed THEN greatest(most, met.l * center_reads) ELSE most END,
             CASE WHEN any_moved THEN FALSE
                  WHEN {greedy} AND refresh AND cl[cluster + 1].unlocked AND (raw_index = cl[cluster + 1].center OR coalesce(own_center_reads * known[cluster + 1].l > reads, FALSE)) THEN TRUE
                  ELSE locked END,
             CASE WHEN moved THEN known[target + 1] WHEN passed AND (pos = 0 OR raw_index = cl[pos + 1].center) THEN met ELSE own END,
             CASE WHEN NOT refresh OR NOT cl[cluster + 1].stale THEN p
                  WHEN reads = 1 OR coalesce(known[cluster + 1].h, 0) = 0 THEN 1.0
                  WHEN tail < 1e-14 THEN 0.0
                  ELSE least(1.0, tail / CASE WHEN 1 - exp(-mean) >= 1e-7 THEN 1 - exp(-mean) ELSE mean - mean * mean / 2 END) END,
             CASE WHEN birth OR any_moved THEN 'C' WHEN refresh THEN 'B' WHEN phase = 'B' THEN 'E' WHEN pos + 1 < len(cl) THEN 'C' ELSE 'S' END,
             CASE WHEN birth THEN len(cl) WHEN any_moved THEN 0 ELSE pos + 1 END::INT,
             turn + 1,
             CASE WHEN birth THEN list_append(cl, {{'center': first_raw, 'total': first_reads, 'stale': TRUE, 'unlocked': TRUE, 'self': 1.0, 'kind': 'A', 'origin': first_cluster, 'pval': first_p * n,
                                                    'fold': first_reads / (first_l * cl[first_cluster + 1].total), 'e': first_l * cl[first_cluster + 1].total}}::{_CLUSTER})
                  WHEN any_moved THEN [struct_update(cl[k + 1], center := list_sort([{{'a': -x.r, 'o': x.o, 'i': x.i}} FOR x IN everyone IF x.c = k])[1].i,
                                       total := list_sum([x.r FOR x IN everyone IF x.c = k])::BIGINT,
                                       unlocked := TRUE, stale := cl[k + 1].stale OR list_sum([x.r FOR x IN everyone IF x.c = k]) <> cl[k + 1].total) FOR k IN range(0, len(cl))]::{_CLUSTER}[]
                  WHEN refresh THEN [struct_update(x, stale := FALSE, unlocked := FALSE) FOR x IN cl]::{_CLUSTER}[]
                  WHEN phase = 'C' AND self IS NOT NULL THEN [CASE WHEN k = pos THEN struct_update(cl[k + 1], self := self) ELSE cl[k + 1] END FOR k IN range(0, len(cl))]::{_CLUSTER}[]
                  ELSE cl END
      FROM (SELECT *, CASE WHEN any_moved THEN list({{'c': new_cluster, 'r': reads, 'o': new_ord, 'i': raw_index}}) OVER () END AS everyone,
                   max(CASE WHEN raw_index = cl[pos + 1].center AND wanted THEN met.l END) OVER () AS self,
                   max(CASE WHEN raw_index = cl[cluster + 1].center THEN reads END) OVER (PARTITION BY cluster) AS own_center_reads,
                   CASE WHEN refresh AND cl[cluster + 1].stale AND reads > 1 AND known[cluster + 1].h > 0 THEN 1 - {_P} END AS tail
      FROM (SELECT *, CASE WHEN moved THEN target WHEN birth AND raw_index = first_raw THEN len(cl) ELSE cluster END::INT AS new_cluster,
                   CASE WHEN moved THEN turn * 1000000000 + row_number() OVER (PARTITION BY moved ORDER BY cluster, ord DESC) WHEN birth AND raw_index = first_raw THEN 0 ELSE ord END::BIGINT AS new_ord,
                   phase = 'S' AND NOT any_moved AS refresh
      FROM (SELECT *, coalesce(bool_or(moved) OVER (), FALSE) AS any_moved, phase = 'B' AND first_may AND first_p * n < 1e-40 AS birth
      FROM (SELECT *, coalesce(phase = 'S' AND target <> cluster AND raw_index <> cl[cluster + 1].center, FALSE) AS moved,
                   first_value(may) OVER f AS first_may, first_value(p) OVER f AS first_p, first_value(raw_index) OVER f AS first_raw,
                   first_value(reads) OVER f AS first_reads, first_value(cluster) OVER f AS first_cluster, first_value(own.l) OVER f AS first_l
      FROM (SELECT *, place > 0 AND coalesce(own.h >= 1, FALSE) AS may, {_MEAN} AS mean,
                   CASE WHEN list_max(expected) > 0 THEN list_position(expected, list_max(expected)) - 1 END AS target
      FROM (SELECT r.*, row_number() OVER (PARTITION BY cluster ORDER BY ord) - 1 AS place,
                   [coalesce(known[k + 1].l * cl[k + 1].total, -1.0) FOR k IN range(0, len(cl))] AS expected,
                   {{'c': r.pos, 'l': b.l, 'h': b.h}}::{_KNOWN} AS met, b.center_reads, {wanted} AS wanted, coalesce({wanted} AND b.l * r.n_reads > r.most, FALSE) AS passed
            FROM run r LEFT JOIN held b ON r.phase = 'C' AND r.cl[r.pos + 1].stale AND b.center = r.cl[r.pos + 1].center AND b.raw_index = r.raw_index
            WHERE r.phase <> 'E')) WINDOW f AS (ORDER BY may DESC, p, reads DESC, cluster, place)))))),
    members AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ord) - 1 AS place, cl[cluster + 1] AS k FROM run WHERE phase = 'E')"""
