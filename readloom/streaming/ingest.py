"""Reads that arrive as files: a stream of records, and running abundances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.schemas import READS
from readloom.sources.fastx import _rows


def stream_fastx(spark: SparkSession, path: str, qual_offset: int = 0, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the reads of every file that appears at ``path``; each comes as a whole and must be under 2 GB."""
    files = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(files).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return source.select("path", "content").mapInArrow(_rows(qual_offset), READS)


def running_abundances(reads: DataFrame) -> DataFrame:
    """(sample, sequence, abundance) so far; for output modes ``update`` and ``complete``."""
    return reads.groupBy("sample", "sequence").agg(F.count(F.lit(1)).alias("abundance"))
