"""Line, substring and near dedup, and decontamination, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_conftest import LOWER, made_docs, shingles, thue_morse, words

from readloom.llm import components, decontaminate, line_dedup, near_dedup, recompress, substring_dedup

STRIP = " \t\n\x0b\x0c\r"


# --- lines ----------------------------------------------------------------------------------------------------------


def lines_by_hand(rows):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    found = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                found[key(line)].add(d)
    gone = {k: max(v) for k, v in found.items() if len(v) >= 3}
    out = {}
    for d, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not (key(x) in gone and gone[key(x)] != d)]
        out[d] = ("\n".join(stay), len(own), len(own) - len(stay))
    return out


def test_lines(docs):
    rows, df = docs
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == lines_by_hand(rows)
    assert sum(x[2] for x in got.values()) > 5


def test_line_edges(spark, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    long = "x" * 19 + "é"
    rows = [(1, long, 7), (1, long, 8), (2, f"a\n{long} \n\n", 9), (None, long, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    # Two documents hold the line: the repeated row and the one without a doc_id are no more.
    assert got == [(-1, "", 1, 0), (-1, long, 1, 0), (1, long, 1, 0), (1, long, 1, 0), (2, f"a\n{long} \n\n", 4, 0)]
    rows += [(3, long, 0)]
    got = sorted((r.doc_id or -1, r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, df.schema)).collect())
    assert got == [(-1, "", 0), (-1, long, 0), (1, "", 1), (1, "", 1), (2, "a\n\n", 1), (3, long, 0)]


def test_lines_of_repeated_documents_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in made_docs(11, 60)]
    rows += [(d, t) for d, t in rows if d % 4 == 0]
    got = {}
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        n, dropped = got.get(r.doc_id, (0, 0))
        got[r.doc_id] = (n + r.n_lines, dropped + r.n_dropped)
    documents = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})  # noqa: F841
    wanted = {d: (n, dropped) for d, n, dropped, _ in duckdb.sql(line_dedup.SQL).fetchall()}
    assert got == wanted
    assert sum(x[1] for x in wanted.values()) > 5


# --- substrings -----------------------------------------------------------------------------------------------------


def substrings_by_hand(rows, size=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone))
    return out


def test_substrings(docs):
    rows, df = docs
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == substrings_by_hand(rows)
    assert sum(0 < x[2] < x[1] for x in got.values()) > 3


def test_substrings_in_small_alphabets(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab") for _ in range(140)) for _ in range(3)] + ["a" * 120, "ab" * 60, "aab" * 40]
    rows = []
    for d in range(40):
        a, b = rng.choice(pool), rng.choice(pool)
        i, j = rng.randrange(60), rng.randrange(60)
        rows.append((d, " ".join(a[i:] + b[j : j + 70])))
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == substrings_by_hand(rows)


@pytest.mark.parametrize("length", [1024, 2048])
def test_words_that_polynomial_hashes_confuse(spark, length):
    """As words, and as sequences of short words: neither removed nor linked for being the other one."""
    one, two = thue_morse(length)
    rows = [(1, " ".join([one, *(f"w{i}" for i in range(63))])), (2, " ".join([two, *(f"w{i}" for i in range(63))])), (3, " ".join(one)), (4, " ".join(two)), (5, " ".join([one] * 70)), (6, " ".join([two] * 70)), (7, one), (8, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == substrings_by_hand(rows)
    assert got[2][2] == 63
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 3, 85, 32, 5).collect()}
    assert got == near_by_hand(rows, 3, 85)
    assert got[6][2] and got[8][2]


def test_substring_edges(spark, empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t, "x"), (5, t, "y"), (None, t, "z"), (6, "  " + t.replace(" ", "\n"), "u"), (7, "v " + t, "v"), (5, t + " q", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = sorted((r.doc_id or -1, r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(-1, t, 60, 0), (5, t, 60, 0), (5, t, 60, 0), (5, t + " q", 61, 0), (6, "", 60, 60), (7, "v", 61, 60)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=30, max_size=120), st.integers(0, 40), st.integers(0, 40), st.lists(st.integers(0, 2), max_size=40))
def test_equal_windows_have_equal_inner_symbols(core, a, b, other):
    """Symbols with their cones inside a passage are the same wherever it stands."""
    names = near_dedup.mix(np.arange(1, 4, dtype=np.uint64))
    texts = [other[:a] + core + other[:b], core, other[::-1] + core]
    first = np.cumsum([0, *map(len, texts)])
    s = recompress.recompress(names[np.concatenate([np.array(t, int) for t in texts])], first)
    seen = []
    for k, t in enumerate(texts):
        at = first[k] + (0 if k == 1 else len(other[:a]) if k == 0 else len(other))
        own = (s.owner == k) & (s.lo >= at) & (s.hi <= at + len(core))
        seen.append(sorted(zip((s.lo[own] - at).tolist(), (s.hi[own] - at).tolist(), s.name[own].tolist(), strict=True)))
    # A text's own edge counts as outside, so the bare passage may show fewer, never others.
    assert seen[0] == seen[2] == seen[1]


# --- near duplicates --------------------------------------------------------------------------------------------------


def near_by_hand(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize(("size", "percent", "bands"), [(3, 85, 32), (5, 80, 40)])
def test_near(spark, size, percent, bands):
    rows = made_docs(2, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, size, percent, bands, 5).collect()}
    assert got == near_by_hand(rows, size, percent)
    assert sum(not x[2] for x in got.values()) > 20


def test_variants_without_their_original(spark):
    """Variants that are linked through some of each other only: stars fail, blocks decide."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(60):
        w = list(base)
        for at in rng.sample(range(80), rng.choice([1, 2, 3])):
            w[at] = f"x{rng.randrange(6)}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 32, 5).collect()}
    assert got == near_by_hand(rows, 3, 85)


def test_near_edges(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(3, "a b c d e f", 1), (3, "q r s t u v", 2), (2, "A B C D E F", 3), (9, "q r s t u v", 4), (None, "a b c d e f", 5), (7, None, 6), (8, " ", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, 2, None, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 2, False)]
    assert sorted(r.doc_id or -1 for r in near_dedup.keep_one(df).collect()) == [-1, 2, 7, 8]


def test_sketches_estimate_and_bound():
    rng = np.random.default_rng(1)
    pool = near_dedup.mix(rng.integers(1, 1 << 62, 3000).astype(np.uint64))
    sets = [np.sort(pool[:400]), np.sort(pool[20:420]), np.sort(pool[200:600]), np.sort(pool[1000:1400])]
    names, offsets = np.concatenate(sets), np.arange(5) * 400
    samples = near_dedup.signatures(names, offsets, 160)
    odd, parity = near_dedup.odd_sketches(samples), near_dedup.parities(names, offsets)
    true = [len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets]
    got = near_dedup.estimate(odd[:1], odd, 160)
    assert got[0] == 1
    assert abs(got[1] - true[1]) < near_dedup.slack(true[1], 160)
    assert abs(got[2] - true[2]) < 0.25
    n = np.full(4, 400)
    assert near_dedup.allowed(parity[:1], parity, n[:1], n, 0.85).tolist() == [True, True, False, False]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# --- decontamination --------------------------------------------------------------------------------------------------


def leaks_by_hand(rows, items, size=5, threshold=0.8):
    out = {}
    for d, t in rows:
        w = words(t, True)
        for i, x in items:
            v = words(x, True)
            if not v:
                continue
            k = min(size, len(v))
            asked = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            shared = len(asked & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
            if shared >= threshold * len(asked) - 1e-9:
                out[d, i] = (len(asked), shared)
    return out


def test_leaks(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(prose(rng.choice([1, 3, 5, 6, 12, 30, 60])))) for k in range(25)] + [(25, None), (26, ""), (27, "w1 w2 w3 w4 w5 w6"), (28, "W1 w2 w3 w4 w5 w6")]
    rows = [(0, None), (1, "")]
    for d in range(2, 80):
        item = (rng.choice(items)[1] or "").upper().split()
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            if item:
                item[rng.randrange(len(item))] = "other"
        rows.append((d, " ".join(prose(rng.choice([0, 20, 900])) + item + prose(10))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = leaks_by_hand(rows, items)
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in got} == wanted
    assert len(got) == len(wanted) > 30
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in wanted}
    duckdb = pytest.importorskip("duckdb")
    documents = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})  # noqa: F841
    benchmark = pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]})  # noqa: F841
    assert {(d, i): (n, k) for d, i, n, k, _ in duckdb.sql(decontaminate.SQL).fetchall()} == wanted
    assert any(n < 5 and len(words(dict(items)[i])) < 5 for (_, i), (n, _) in wanted.items())


def test_leak_edges(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(empty, bench).count() == 0
    rows = [(None, "x A b c\td e f g"), (4, "a b c d e f g"), (4, "nothing"), (5, "a b")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, item_id string")
    assert decontaminate.find_leaks(docs, none).count() == 0
    assert decontaminate.clean(docs, none).count() == 4
    got = sorted((r.doc_id or -1, r.item_id, r.n_shared) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(-1, 1, 3), (-1, 1, 3), (4, 1, 3), (4, 1, 3)]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [5]
