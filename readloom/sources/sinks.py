"""Writers: tables as Parquet, sequences as FASTA, reads as FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by_sample: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy("sample") if by_sample else writer).parquet(path)


def fasta_lines(report: DataFrame) -> DataFrame:
    """(value): a FASTA record a variant, its abundance in the header."""
    return report.select(F.format_string(">ASV%d;size=%d\n%s", "ASV_ID", "Total_Reads", "Sequence").alias("value"))


def write_fasta(report: DataFrame, path: str) -> None:
    fasta_lines(report).write.mode("overwrite").text(path)


def write_fastq(reads: DataFrame, path: str, qual_offset: int = 33) -> None:
    """A FASTQ file a task; qualities as bytes above ``qual_offset``."""
    marks = F.array_join(F.transform("qualities", lambda q: F.char(q + qual_offset)), "")
    reads.select(F.concat(F.lit("@"), "id", F.lit("\n"), "sequence", F.lit("\n+\n"), marks).alias("value")).write.text(path)
