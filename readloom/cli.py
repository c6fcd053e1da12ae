"""``python -m readloom.cli FILE``: denoise a FASTA or FASTQ file and print its variants."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from readloom import __version__
from readloom.operators.derep import dereplicate
from readloom.plans.denoise import denoise_any
from readloom.plans.partition import Settings
from readloom.plans.report import asv_report, report_lines, trace
from readloom.sources.fastx import read_fastx


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="readloom", description="Infer sequence variants from amplicon reads.")
    parser.add_argument("file", help="FASTA or FASTQ, plain or gzipped; a folder of such files gives a sample a file")
    parser.add_argument("-a", "--omega-a", type=float, default=1e-40, help="largest corrected p-value that founds a variant")
    parser.add_argument("-v", "--verbose", action="store_true", help="also print what each step did, and representative sequences")
    parser.add_argument("--qual-offset", type=int, default=0, help="subtracted from quality bytes (33 for Phred scores)")
    parser.add_argument("--output", help="write variants as Parquet here")
    parser.add_argument("--version", action="version", version=__version__)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    if args.verbose:
        print(f"Reading {args.file}")
    uniques = dereplicate(read_fastx(spark, args.file, args.qual_offset), large=True).cache()
    sizes = uniques.groupBy("sample").agg({"abundance": "sum", "*": "count"}).collect()
    if not sizes:
        print("No sequences found.")
        return 0
    members = denoise_any(uniques, Settings(omega_a=args.omega_a)).cache()
    report = asv_report(members, uniques).cache()
    lines = report_lines(report).orderBy("sample", "ASV_ID").collect()
    steps = trace(members).orderBy("sample", "step").collect() if args.verbose else []
    for row in sorted(sizes):
        own = [x for x in lines if x.sample == row.sample]
        print(f"\n{row.sample}: {row['sum(abundance)']} reads, {row['count(1)']} unique sequences, {len(own)} variants")
        for x in (t for t in steps if t.sample == row.sample):
            print(x.line)
        print("ASV_ID Center_Unique    Center_Abund Total_Reads  Unique_Seqs Birth_Type")
        for x in own:
            print(x.line)
        if args.verbose:
            for x in own:
                print(x.representative)
    if args.output:
        report.write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
