"""Cell-by-cell alignment and term-by-term Poisson, to hold the kernels against."""

from __future__ import annotations

import math


def runs(s: str) -> list[bool]:
    return [any(0 <= k and k + 2 < len(s) and s[k] == s[k + 1] == s[k + 2] for k in (i - 2, i - 1, i)) for i in range(len(s))]


def align(s1: str, s2: str, match: int, mismatch: int, gap: int, homo_gap: int | None, band: int) -> tuple[int, str, str]:
    n, m = len(s1), len(s2)
    homo = gap if homo_gap is None else homo_gap
    h1, h2 = runs(s1), runs(s2)
    low, high = (band + max(0, n - m), band + max(0, m - n)) if band >= 0 else (n + m, n + m)
    score, step = {}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            if not i - low <= j <= i + high:
                score[i, j] = -9999
            elif not i or not j:
                score[i, j] = 0
            else:
                up = score[i - 1, j] + (0 if j == m else homo if h1[i - 1] else gap)
                left = score[i, j - 1] + (0 if i == n else homo if h2[j - 1] else gap)
                diagonal = score[i - 1, j - 1] + (match if s1[i - 1] == s2[j - 1] else mismatch)
                score[i, j] = max(up, left, diagonal)
                step[i, j] = "u" if up == score[i, j] else "l" if left == score[i, j] else "d"
    i, j, x, y = n, m, "", ""
    while i or j:
        move = "l" if not i else "u" if not j else step[i, j]
        x = ("-" if move == "l" else s1[i - 1]) + x
        y = ("-" if move == "u" else s2[j - 1]) + y
        i, j = i - (move != "l"), j - (move != "u")
    return score[n, m], x, y


def poisson_cdf(k: int, mean: float) -> float:
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return total


def likelihood(center: str, raw: str, quals: list[int], s) -> tuple[float, int]:
    """Product of substitution rates along the alignment of a center (true) with a raw (read), and its substitutions."""
    _, x, y = align(center, raw, s.match, s.mismatch, s.gap, s.homo_gap, s.band)
    value, differ, at = 1.0, 0, 0
    for t, r in zip(x, y, strict=True):
        if r == "-":
            continue
        wrong = min(10 ** (-min(quals[at], 40) / 10), 0.75)
        value *= 1 - wrong if t in ("-", r) else wrong / 3
        differ += t not in ("-", r)
        at += 1
    return value, differ


def denoise(seqs: list[str], reads: list[int], quals: list[list[int]], prior: list[bool], s) -> tuple[list[dict], list[dict], bool]:
    """(rows, clusters, whether rounding may have chosen a birth) of one sample: every rule for one row after the other."""
    total, n = sum(reads), len(seqs)
    rows = [{"p": 1.0, "lock": False, "most": 0.0, "comp": None} for _ in seqs]
    clusters = [{"center": 0, "members": list(range(n)), "total": total, "known": {}, "stale": True, "check": True, "type": "I", "from": None, "pval": 1.0, "fold": 1.0, "e": 0.0}]
    against: dict = {}
    close = False

    def hold(c):
        k = clusters[c]
        for i in range(n):
            if s.greedy and (reads[i] > reads[k["center"]] or rows[i]["lock"]):
                continue
            if (k["center"], i) not in against:
                against[k["center"], i] = likelihood(seqs[k["center"]], seqs[i], quals[i], s)
            lam, ham = against[k["center"], i]
            if lam * total > rows[i]["most"]:
                rows[i]["most"] = max(rows[i]["most"], lam * reads[k["center"]])
                k["known"][i] = (lam, ham)
                if c == 0 or i == k["center"]:
                    rows[i]["comp"] = (c, lam, ham)

    def pvalue(i, k):
        known = k["known"].get(i)
        if known is None or (reads[i] == 1 and not prior[i] and not s.detect_singletons) or known[1] == 0:
            return 1.0
        if known[0] == 0:
            return 0.0
        e = known[0] * k["total"]
        p = 1 - poisson_cdf(reads[i] - 1, e)
        if not (prior[i] or s.detect_singletons):
            norm = 1 - math.exp(-e)
            p /= norm if norm >= 1e-7 else e - e * e / 2
        return min(1.0, max(0.0, p))

    def refresh():
        for k in clusters:
            for i in k["members"]:
                if k["stale"]:
                    rows[i]["p"] = pvalue(i, k)
                if s.greedy and k["check"] and (i == k["center"] or (i in k["known"] and reads[k["center"]] * k["known"][i][0] > reads[i])):
                    rows[i]["lock"] = True
            k["stale"] = False
            k["check"] = k["check"] and not s.greedy

    def shuffle():
        best = {}
        for i in range(n):
            for c, k in enumerate(clusters):
                if i in k["known"] and k["known"][i][0] * k["total"] > best.get(i, (0.0, None))[0]:
                    best[i] = (k["known"][i][0] * k["total"], c)
        going = [(i, best[i][1]) for c, k in enumerate(clusters) for i in reversed(k["members"]) if i != k["center"] and i in best and best[i][1] != c]
        for i, c in going:
            for k in clusters:
                k["members"] = [x for x in k["members"] if x != i]
            clusters[c]["members"].append(i)
            rows[i]["comp"] = (c, *clusters[c]["known"][i])
        return bool(going)

    def bud():
        nonlocal close
        for only_prior, omega in ((False, s.omega_a), (True, s.omega_p)):
            found = [
                (rows[i]["p"], -reads[i], c, at)
                for c, k in enumerate(clusters)
                for at, i in enumerate(k["members"])
                if at and rows[i]["comp"] and rows[i]["comp"][2] >= s.min_hamming and (prior[i] or not only_prior)
            ]
            first = min(found, default=None)
            close |= any(f[0] - first[0] < 1e-6 and (f[1], rows[clusters[f[2]]["members"][f[3]]]["comp"][1]) != (first[1], rows[clusters[first[2]]["members"][first[3]]]["comp"][1]) for f in found)
            if found and min(found)[0] * (1 if only_prior else n) < omega:
                p, _, c, at = min(found)
                i = clusters[c]["members"].pop(at)
                e = rows[i]["comp"][1] * clusters[c]["total"]
                clusters.append({"center": i, "members": [i], "total": reads[i], "known": {}, "stale": True, "check": True, "type": "P" if only_prior else "A", "from": c, "pval": p * (1 if only_prior else n), "fold": reads[i] / e if e else math.inf, "e": e})
                return True
        return False

    hold(0)
    refresh()
    while bud():
        hold(len(clusters) - 1)
        while shuffle():
            for k in clusters:
                now = sum(reads[i] for i in k["members"])
                k["stale"], k["total"], k["check"] = k["stale"] or now != k["total"], now, True
                for i in k["members"]:
                    rows[i]["lock"] = False
                if k["members"]:
                    k["center"] = max(k["members"], key=lambda i, k=k: (reads[i], -k["members"].index(i)))
            for c, k in enumerate(clusters):
                if k["stale"]:
                    hold(c)
        refresh()
    return rows, clusters, close
