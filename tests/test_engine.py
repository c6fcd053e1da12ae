from __future__ import annotations

import gzip
import random

import naive
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readloom.functions import nucleotides
from readloom.operators import align, derep, errmodel, homopolymers, kmers
from readloom.plans.denoise import denoise, denoise_any, denoise_large, partition_frame
from readloom.plans.partition import Partition, Settings
from readloom.plans.report import asv_report, lineage, report_lines
from readloom.schemas import READS
from readloom.sources import fastx, sinks

THREE = [
    ("AAAAACCCCCGGGGGAAAAACCCCCGGGGGAAAAACCCCCGGGGGAAAAA", 500),
    ("AAAAACCCCCGGGGGAAAAACACACGGGGGAAAAACCCCCGGGGGAAAAA", 200),
    ("AAAAACCCCCGGGGGTATATCCCCCGGGGGAAAAACCCCCGGGGGAAAAA", 10),
]


def uniques_frame(rows, sample="s"):
    return pd.DataFrame({"sample": sample, "raw_index": np.arange(len(rows), dtype=np.int32), "sequence": [r[0] for r in rows], "abundance": [r[1] for r in rows], "consensus_qualities": [[40] * len(r[0]) for r in rows]})


UNIQUES = "sample string, raw_index int, sequence string, abundance long, consensus_qualities array<int>"


# --- dereplication --------------------------------------------------------------------------------------------------


def test_dereplicate(spark):
    reads = spark.createDataFrame([("s", "read1", "ACTG", [30, 40, 20, 10]), ("s", "read2", "ACTG", [10, 20, 30, 40]), ("s", "read3", "AAAA", [40] * 4), ("t", "e", "", [])], READS)
    got = derep.dereplicate(reads).orderBy("sample", "raw_index").collect()
    assert [(r.sample, r.raw_index, r.sequence, r.abundance) for r in got] == [("s", 0, "ACTG", 2), ("s", 1, "AAAA", 1), ("t", 0, "", 1)]
    assert got[0].average_qualities == [20, 30, 25, 25]
    assert got[0].consensus_qualities == [20, 30, 25, 25]
    assert got[2].average_qualities == []


def test_large_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"{k:03d}", rng.choice([1, 1, 2, 3, 50])) for k in range(300)] + [("c", "x", 1)]
    df = spark.createDataFrame(rows, "sample string, sequence string, abundance long").repartition(5)
    shown = lambda x: sorted(tuple(map(str, r)) for r in x.select("sample", "sequence", "abundance", "raw_index").collect())
    assert shown(derep.rank_large(df)) == shown(derep.rank(df))
    assert derep.rank_large(df.limit(0)).count() == 0


def test_dereplicate_nothing(spark):
    reads = spark.createDataFrame([], READS)
    assert derep.dereplicate(reads).count() == 0
    assert derep.totals(reads).count() == 0


def test_halves_round_up_and_lengths_must_agree(spark):
    reads = spark.createDataFrame([("s", "a", "AC", [2, 24]), ("s", "b", "AC", [3, 25])], READS)
    assert derep.dereplicate(reads).first().consensus_qualities == [3, 25]
    with pytest.raises(Exception, match="read x: 2 bases but 1 qualities"):
        derep.dereplicate(spark.createDataFrame([("s", "x", "AC", [1])], READS)).collect()


# --- k-mers and runs ------------------------------------------------------------------------------------------------


def test_kmers(spark):
    rows = [(0, "AAAAA"), (1, "AAAAC"), (2, "AAAAAA"), (3, "AAAAAC"), (4, "ACG"), (5, "AANAAAAA"), (6, "")]
    df = spark.createDataFrame(rows, "raw_index int, sequence string")
    got = {(r.raw_index, r.kmer_idx): r.cnt for r in kmers.kmer_counts(df).collect()}
    assert got == {(0, 0): 1, (1, 1): 1, (2, 0): 2, (3, 0): 1, (3, 1): 1, (5, 0): 1}
    pairs = spark.createDataFrame([(0, 0), (0, 1), (2, 3), (0, 4), (5, 5), (6, 6)], "a int, b int")
    dist = {(r.a, r.b): r.distance for r in kmers.kmer_distances(pairs, df).collect()}
    assert dist == {(0, 0): 0.0, (0, 1): 1.0, (2, 3): 0.5, (0, 4): 1.0, (5, 5): 0.75, (6, 6): 1.0}
    dense = df.where("raw_index IN (2, 3)").select(kmers.kmer_vector(F.col("sequence")).alias("v"), F.length("sequence").alias("n")).collect()
    assert len(dense[0].v) == 1024
    both = spark.createDataFrame([(dense[0].v, 6, dense[1].v, 6)], "a array<int>, la int, b array<int>, lb int")
    assert both.select(kmers.vector_distance(F.col("a"), F.col("la"), F.col("b"), F.col("lb"))).first()[0] == 0.5


def test_bases_and_runs(spark):
    df = spark.createDataFrame([(0, "AAACCCGGT"), (1, "AA"), (2, ""), (3, "NNNa")], "raw_index int, sequence string")
    assert {r.raw_index: r["mask"] for r in homopolymers.masks(df).collect()} == {0: "TTTTTTFFF", 1: "FF", 2: "", 3: "TTTF"}
    got = sorted((r.raw_index, r.start, r.length, r.base) for r in homopolymers.runs(df).collect())
    assert got == [(0, 0, 3, "A"), (0, 3, 3, "C"), (3, 0, 3, "N")]
    codes = spark.createDataFrame([(x,) for x in ("A", "c", "G", "t", "N", "-", "")], "b string").select(nucleotides.nucleotide_index(F.col("b"))).collect()
    assert [r[0] for r in codes] == [0, 1, 2, 3, None, None, None]


def test_tables_and_alignment_columns(spark):
    rates = {(r.trans_idx, r.q): r.rate for r in errmodel.error_table(spark).collect()}
    known = errmodel.error_rates()
    assert len(rates) == 16 * 41
    assert all(rates[t, q] == pytest.approx(known[t, q]) for t, q in rates)
    df = spark.createDataFrame([("ACTG", "AAACTG", 1), (None, "A", 2)], "s1 string, s2 string, score int")
    assert [(r.score, r.query_align, r.ref_align) for r in align.align(df).collect()] == [(20, "--ACTG", "AAACTG"), (0, "-", "A")]


# --- partition ------------------------------------------------------------------------------------------------------


def run_three(omega):
    return partition_frame(uniques_frame(THREE), Settings(omega_a=omega, omega_p=omega), errmodel.error_rates())


def test_three_sequences():
    assert run_three(0).cluster_index.tolist() == [0, 0, 0]
    for omega in (0.1, 1e-40):
        got = run_three(omega).sort_values("cluster_index")
        assert got.raw_index.tolist() == [0, 1, 2]
        assert got.total_reads.tolist() == [710, 200, 10]  # the first total is not counted again
        assert got.birth_type.tolist() == ["I", "A", "A"]
        assert got.birth_from.tolist()[1:] == [0, 0]
        assert got.birth_pval.tolist()[1:] == [0, 0]
        assert got.birth_e.tolist()[1:] == [pytest.approx(7.851e-7, rel=1e-3), pytest.approx(2.617e-11, rel=1e-3)]


def test_guards_and_empty():
    with pytest.raises(ValueError):
        Partition(np.zeros(0, int), Settings(), lambda c, w: (w, w))
    with pytest.raises(RuntimeError):
        partition_frame(uniques_frame(THREE), Settings(omega_a=0.1, max_clusters=1), errmodel.error_rates())


def test_prior_births():
    frame = uniques_frame([THREE[0], (THREE[1][0], 1)])
    frame["prior"] = [False, True]
    assert partition_frame(frame, Settings(omega_a=0, omega_p=0.9), errmodel.error_rates()).birth_type.tolist() == ["I", "P"]
    assert partition_frame(frame, Settings(omega_a=0, omega_p=0), errmodel.error_rates()).birth_type.tolist() == ["I", "I"]


def made_sample(seed=3, n=40, length=60, variants=4):
    rng = random.Random(seed)
    truth = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(variants)]
    truth.append(truth[0][:20] + truth[0][20:22].translate(str.maketrans("ACGT", "CGTA")) + truth[0][22:])
    rows = {t: 600 - 110 * k for k, t in enumerate(truth)}
    while len(rows) < n:
        t = rng.choice(truth)
        i = rng.randrange(length)
        rows.setdefault(t[:i] + rng.choice("ACGT") + t[i + 1 :], rng.choice([1, 1, 2, 3, 30]))
    return sorted(rows.items(), key=lambda r: (-r[1], r[0]))


def random_sample(seed):
    """Some short templates with their errors at poor qualities, so that p-values are neither all 0 nor all 1."""
    rng = random.Random(seed)
    length = rng.choice([10, 14, 18])
    truth = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(rng.choice([1, 2, 3]))]
    rows = {t: rng.randint(20, 90) for t in truth}
    for _ in range(rng.randint(3, 11)):
        t = list(rng.choice(truth))
        for _ in range(rng.choice([1, 1, 2])):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(["A", "C", "G", "T", "", "AA"])
        rows.setdefault("".join(t), rng.choice([1, 2, 4, 9, 25]))
    ranked = sorted(rows.items(), key=lambda r: (-r[1], r[0]))
    quals = [[rng.choice([8, 12, 17, 25]) for _ in t] for t, _ in ranked]
    frame = uniques_frame(ranked)
    frame["consensus_qualities"] = quals
    frame["prior"] = [rng.random() < 0.2 for _ in ranked]
    settings = Settings(omega_a=rng.choice([1e-2, 1e-4]), omega_p=rng.choice([1e-2, 1e-8]), greedy=rng.random() < 0.4, detect_singletons=rng.random() < 0.2)
    return frame, settings


def as_by_hand(own, frame, settings):
    """Whether a partition is that of the scalar run; None where p-values are too close to be told apart by rounding."""
    rows, clusters, close = naive.denoise(frame["sequence"].tolist(), frame["abundance"].tolist(), frame["consensus_qualities"].tolist(), frame["prior"].tolist(), settings)
    if close:
        return None
    assert [own[own.cluster_index == c].sort_values("ord").raw_index.tolist() for c in range(len(clusters))] == [k["members"] for k in clusters]
    for r in own.itertuples():
        row, k = rows[r.raw_index], clusters[r.cluster_index]
        assert r.p_value == pytest.approx(row["p"], abs=1e-6)  # one minus the distribution function, over a small norm
        assert r.e_minmax == pytest.approx(row["most"], rel=1e-9)
        assert r.locked == row["lock"]
        if row["comp"]:
            assert (r.comp_lambda, r.comp_hamming) == (pytest.approx(row["comp"][1], rel=1e-9), row["comp"][2])
        else:
            assert pd.isna(r.comp_lambda)
        assert (r.center_index, r.total_reads, r.birth_type) == (k["center"], k["total"], k["type"])
        assert (None if pd.isna(r.birth_from) else r.birth_from) == k["from"]
        assert (r.birth_pval, r.birth_e) == (pytest.approx(k["pval"], abs=1e-5), pytest.approx(k["e"], rel=1e-9))
    return len(clusters)


def test_partition_is_that_of_the_scalar_run():
    found = [as_by_hand(partition_frame(frame, s, errmodel.error_rates()), frame, s) for frame, s in map(random_sample, range(600))]
    assert sum(f is not None for f in found) >= 100
    assert sum((f or 0) > 1 for f in found) >= 40
    assert max(f or 0 for f in found) >= 3


def test_large_mode_is_that_of_the_scalar_run(spark):
    frame, s = next(x for x in map(random_sample, range(600)) if len(x[0]) > 5 and x[1].greedy and (as_by_hand(partition_frame(*x, errmodel.error_rates()), *x) or 0) > 1)
    records, clusters = denoise_large(spark.createDataFrame(frame, f"{UNIQUES}, prior boolean"), s)
    got = records.toPandas().rename(columns={"lock": "locked"})
    got = got.merge(pd.DataFrame(clusters).reset_index(names="cluster_index"), on="cluster_index")
    assert as_by_hand(got, frame, s) == len(clusters) > 1


def test_both_modes_agree(spark):
    frame = uniques_frame(made_sample(n=24, variants=2))
    s = Settings()
    own = partition_frame(frame, s, errmodel.error_rates()).sort_values("raw_index")
    records, clusters = denoise_large(spark.createDataFrame(frame, UNIQUES), s)
    got = records.toPandas().sort_values("raw_index")
    assert got.cluster_index.tolist() == own.cluster_index.tolist()
    assert got.p_value.tolist() == pytest.approx(own.p_value.tolist())
    assert got["lock"].tolist() == own.locked.tolist()
    order = lambda df: df.sort_values(["cluster_index", "ord"]).raw_index.tolist()
    assert order(got) == order(own)
    by = own.drop_duplicates("cluster_index").sort_values("cluster_index")
    assert [c["total_reads"] for c in clusters] == by.total_reads.tolist()
    assert [c["birth_type"] for c in clusters] == by.birth_type.tolist()
    assert len(clusters) >= 3


def test_large_samples_beside_small_ones(spark):
    frame = pd.concat([uniques_frame(THREE, "a"), uniques_frame(THREE, "b").iloc[:2], uniques_frame(THREE[:1], "c")])
    frame.loc[frame["sample"] == "c", "sample"] = None
    uniques = spark.createDataFrame(frame, UNIQUES)
    s = Settings(omega_a=0.1)
    order = ["sample", "cluster_index", "ord"]
    wanted = denoise(uniques, s).toPandas().sort_values(order)
    for large in (100, 2, 1):
        got = denoise_any(uniques, s, large=large).toPandas().sort_values(order)
        pd.testing.assert_frame_equal(got.reset_index(drop=True), wanted.reset_index(drop=True), check_dtype=False)


def test_samples_apart_and_reports(spark):
    frame = pd.concat([uniques_frame(THREE, "a"), uniques_frame(made_sample(), "b")])
    uniques = spark.createDataFrame(frame, UNIQUES)
    members = denoise(uniques, Settings(omega_a=0.1)).cache()
    assert members.count() == len(frame)
    report = asv_report(members, uniques)
    a = report.where("sample = 'a'").orderBy("ASV_ID").collect()
    assert [(r.ASV_ID, r.Center_Unique, r.Center_Abund, r.Total_Reads, r.Unique_Seqs, r.Birth_Type, r.Census_Total) for r in a] == [
        (1, "Unique_1", 500, 710, 1, "I", 500),
        (2, "Unique_2", 200, 200, 1, "A", 200),
        (3, "Unique_3", 10, 10, 1, "A", 10),
    ]
    assert report.groupBy("sample").agg(F.sum("Census_Total")).count() == 2
    assert lineage(members).where("sample = 'a' AND birth_from = 0").count() == 2
    lines = report_lines(report).where("sample = 'a'").orderBy("ASV_ID").collect()
    assert lines[0].line.startswith("1      Unique_1 ")
    assert lines[0].representative.endswith(THREE[0][0])
    assert sinks.fasta_lines(report.where("sample = 'a' AND ASV_ID = 1")).first().value == f">ASV1;size=710\n{THREE[0][0]}"


# --- sources --------------------------------------------------------------------------------------------------------

FASTQ = b"@r1 first read\nacgt\n+\n@III\n\n@r2\nNNA\n+r2\n!!~\n"
FASTA = b">x one\nAC\ngt\n>y\n\n>z\nA\n"


@pytest.mark.parametrize("way", ["files", "source"])
def test_fastx(spark, tmp_path, way):
    (tmp_path / "a.fastq").write_bytes(FASTQ)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(FASTQ))
    (tmp_path / "c.fasta").write_bytes(FASTA)
    if way == "files":
        got = fastx.read_fastx(spark, f"{tmp_path}/*")
    else:
        fastx.register(spark)
        got = spark.read.format("fastx").load(str(tmp_path))
    rows = {(r.sample, r.id): (r.sequence, r.qualities) for r in got.collect()}
    assert rows["a.fastq", "r1 first read"] == ("ACGT", [64, 73, 73, 73])
    assert rows["b.fastq.gz", "r2"] == ("NNA", [33, 33, 126])
    assert rows["c.fasta", "x one"] == ("ACGT", [40] * 4)
    assert rows["c.fasta", "y"] == ("", [])
    assert len(rows) == 7


def test_compressed_files_come_line_by_line(spark, tmp_path):
    records = [(f"r{k}", "ACGT"[k % 4] * (k % 7), "I@+~"[k % 4] * (k % 7)) for k in range(23_000)]
    for name, part in (("a.fastq.gz", records[:21_000]), ("b 1%.gz", records[21_000:]), ("c.fq.gz", [])):
        (tmp_path / name).write_bytes(gzip.compress("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in part).encode()))
    (tmp_path / "nogz").write_bytes(FASTA)
    got = fastx.read_fastx(spark, str(tmp_path), 33).collect()
    wanted = sorted(("a.fastq.gz" if k < 21_000 else "b 1%.gz", i, s, [ord(x) - 33 for x in q]) for k, (i, s, q) in enumerate(records))
    assert sorted(tuple(r) for r in got if r.sample != "nogz") == wanted
    assert sum(r.sample == "nogz" for r in got) == 3
    (tmp_path / "d.gz").write_bytes(gzip.compress(b"@r\nACG\n+\nII\n"))
    with pytest.raises(Exception, match="read r: 3 bases but 2 qualities"):
        fastx.read_fastx(spark, str(tmp_path / "d.gz")).collect()


def test_plain_files_come_line_by_line(spark, tmp_path):
    """A file is one partition, however small Spark's own parts are; gzip is known by its bytes also without the name."""
    records = [(f"r{k}", "ACGT"[k % 4] * (k % 90 + 1), "I@+~"[k % 4] * (k % 90 + 1)) for k in range(12_000)]
    text = "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in records).encode()
    (tmp_path / "plain").write_bytes(text)
    (tmp_path / "windows").write_bytes(text.replace(b"\n", b"\r\n"))
    members = gzip.compress(text[: len(text) // 3]) + gzip.compress(text[len(text) // 3 :])
    (tmp_path / "members").write_bytes(members)
    (tmp_path / "padded").write_bytes(members + b"\0" * 700)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "packed empty").write_bytes(gzip.compress(b""))
    (tmp_path / "latin").write_bytes(b"@caf\xe9\nAC\n+\nII")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        got = fastx.read_fastx(spark, str(tmp_path), 33)
        rows = got.collect()
        assert got.sparkSession is spark and spark.conf.get("spark.sql.files.maxPartitionBytes") == "1000"
        assert got.rdd.getNumPartitions() == 6  # files that hold any byte
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [(i, s, [ord(x) - 33 for x in q]) for i, s, q in records]
    for name in ("plain", "windows", "members", "padded"):
        assert [(r.id, r.sequence, r.qualities) for r in rows if r.sample == name] == wanted
    assert [(r.id, r.qualities) for r in rows if r.sample not in ("plain", "windows", "members", "padded")] == [("caf\ufffd", [40, 40])]
    (tmp_path / "cut").write_bytes(members[:-9])
    with pytest.raises(Exception, match="cut short"):
        fastx.read_fastx(spark, str(tmp_path / "cut")).collect()


def test_fastx_offset_and_faults(spark, tmp_path):
    (tmp_path / "a.fastq").write_bytes(FASTQ)
    assert fastx.read_fastx(spark, str(tmp_path / "a.fastq"), 33).where("id = 'r2'").first().qualities == [0, 0, 93]
    for data in (b"@r\nACG\n+\nII\n", b"ACGT\n", b"@r\nACG\n"):
        with pytest.raises(fastx.FastxError):
            list(fastx.parse(fastx._open(data)))
    assert list(fastx.parse(fastx._open(b""))) == []


def test_stream(spark, tmp_path):
    from readloom.streaming.ingest import running_abundances, stream_fastx

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.fastq").write_bytes(FASTQ)
    stream = running_abundances(stream_fastx(spark, str(source))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    stream.processAllAvailable()
    (source / "b.fastq").write_bytes(FASTQ)
    stream.processAllAvailable()
    stream.stop()
    assert {(r.sample, r.sequence): r.abundance for r in spark.table("counts").collect()} == {(s, q): 1 for s in ("a.fastq", "b.fastq") for q in ("ACGT", "NNA")}


def test_cli(spark, tmp_path, capsys):
    from readloom.cli import main

    path = tmp_path / "reads.fasta"
    path.write_text("".join(f">r{k}_{i}\n{s}\n" for k, (s, n) in enumerate(THREE) for i in range(n)))
    assert main([str(path), "-a", "0.1", "-v", "--output", str(tmp_path / "out")], spark) == 0
    shown = capsys.readouterr().out
    assert "710 reads, 3 unique sequences, 3 variants" in shown
    # Births as worked out by hand: both from the first, p 0, and nothing moves afterwards.
    steps = ["Step 1: Unique_2 leaves ASV 1 (A), p 0.00e+00, 0 rounds of moves", "Step 2: Unique_3 leaves ASV 1 (A), p 0.00e+00, 0 rounds of moves", "Step 3: nothing to split off, 3 variants"]
    assert [line for line in shown.splitlines() if line.startswith("Step")] == steps
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "none.fasta").write_text("")
    assert main([str(tmp_path / "none.fasta")], spark) == 0
    assert "No sequences found." in capsys.readouterr().out
