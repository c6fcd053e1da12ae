"""FASTA and FASTQ, plain or gzipped.

``read_fastx`` goes through Spark's own file sources, so any store that Spark reads will do. Files come line by line, in order,
one task a file (as ``@`` may begin a quality line, a file's parts cannot be read apart), and may have any size; gzip is told by
the name ``.gz`` or by the first bytes. The ``fastx`` data source reads local or mounted paths line by
line and also serves streams' directories. Headers are kept whole and trimmed, sequences are upper-cased, FASTA bases get
quality 40, and FASTQ qualities are the file's bytes minus ``qual_offset`` (0 by default, 33 for Phred scores).
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import zlib
from collections.abc import Iterator
from itertools import chain, groupby, islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.schemas import READS

FASTA_QUALITY = 40
GZIP = b"\x1f\x8b"
#: Files up to this size are one partition each.
ONE_TASK = 1 << 44


class FastxError(ValueError):
    """A file that is neither FASTA nor FASTQ, or a broken record."""


def parse(stream: io.BufferedIOBase, qual_offset: int = 0) -> Iterator[tuple[str, str, list[int]]]:
    """(id, sequence, qualities) of each record."""
    if stream.peek(2)[:2] == GZIP:
        stream = gzip.open(stream)
    yield from parse_lines((line.rstrip(b"\r\n") for line in stream), qual_offset)


def parse_lines(lines: Iterator[bytes], qual_offset: int = 0) -> Iterator[tuple[str, str, list[int]]]:
    """(id, sequence, qualities) of each record of lines without their ends."""
    head = next((line for line in lines if line), None)
    while head is not None:
        name = head[1:].decode(errors="replace").strip()
        if head[:1] == b">":
            parts: list[bytes] = []
            head = None
            for line in lines:
                if line[:1] == b">":
                    head = line
                    break
                parts.append(line.strip())
            sequence = b"".join(parts).upper().decode("ascii", "replace")
            yield name, sequence, [FASTA_QUALITY] * len(sequence)
        elif head[:1] == b"@":
            parts, plus = [], False
            for line in lines:
                if line[:1] == b"+":
                    plus = True
                    break
                parts.append(line.strip())
            sequence = b"".join(parts).upper().decode("ascii", "replace")
            quality = b""
            while plus and len(quality) < len(sequence):
                line = next(lines, None)
                if line is None:
                    break
                quality += line
            if not sequence:
                next(lines, None)
            if not plus or len(quality) != len(sequence):
                raise FastxError(f"read {name}: {len(sequence)} bases but {len(quality)} qualities")
            yield name, sequence, [q - qual_offset for q in quality]
            head = next((line for line in lines if line), None)
        else:
            raise FastxError(f"a record must begin with '>' or '@', not {head[:20]!r}")


def _open(data: bytes) -> io.BufferedReader:
    return io.BufferedReader(io.BytesIO(data))


def _rows(qual_offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from _batches(path, parse(_open(content), qual_offset))

    return run


def _inflated(lines: Iterator[bytes]) -> Iterator[bytes]:
    """The lines inside gzip members that came cut at their line feeds."""
    member, rest = zlib.decompressobj(31), b""
    for line in lines:
        data = line + b"\n"
        # The last line feed may not be the file's own; nothing but that and padding may stand behind a member.
        while data.strip(b"\n\0") if member.eof else data:
            member = zlib.decompressobj(31) if member.eof else member
            *whole, rest = (rest + member.decompress(data)).split(b"\n")
            yield from whole
            data = member.unused_data
    if not member.eof:
        raise FastxError("the compressed file is cut short")
    if rest:
        yield rest


def _line_rows(qual_offset: int):
    """Records of files whose lines come in order, one file after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True))
        for path, own in groupby(rows, key=lambda row: row[0]):
            lines = (value for _, value in own)
            first = next(lines)
            lines = chain([first], lines)
            if first.startswith(GZIP):
                lines = _inflated(lines)
            yield from _batches(unquote(path), parse_lines((line.rstrip(b"\r\n") for line in lines), qual_offset))

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of all files at ``path`` as bytes; a file is one partition, its lines in order.

    How a scan is split is a setting of the session that makes it, so a session beside the caller's makes this one.
    """
    beside = spark.newSession()
    beside.conf.set("spark.sql.files.maxPartitionBytes", ONE_TASK)
    beside.conf.set("spark.sql.files.openCostInBytes", ONE_TASK)
    lines = beside.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    # The union with nothing gives the plan to the caller's session.
    return spark.sql("SELECT '' AS path, X'' AS value WHERE false").unionByName(lines)


def _batches(path: str, records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(records, 10_000)):
        yield _batch(path, held)


def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    sample = pa.array([os.path.basename(path)] * len(rows), pa.string())
    return pa.RecordBatch.from_arrays([sample, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.list_(pa.int32()))))], ["sample", "id", "sequence", "qualities"])


def read_fastx(spark: SparkSession, path: str, qual_offset: int = 0) -> DataFrame:
    """Reads of all files at ``path``; the sample is the file's name."""
    return _lines(spark, path).mapInArrow(_line_rows(qual_offset), READS)


def normalize(reads: DataFrame) -> DataFrame:
    """Reads of any origin as this library wants them: trimmed ids, upper-case sequences, qualities 40 where there are none."""
    sequence = F.upper("sequence")
    quals = F.array_repeat(F.lit(FASTA_QUALITY), F.length("sequence"))
    if "qualities" in reads.columns:
        quals = F.coalesce("qualities", quals)
    return reads.select("sample", F.trim("id").alias("id"), sequence.alias("sequence"), quals.alias("qualities"))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FastxDataSource(DataSource):
    """``spark.read.format("fastx").option("qual_offset", 33).load(path)`` after ``register``; one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return _FastxReader(self.options)


class _FastxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.qual_offset = options["path"], int(options.get("qual_offset", 0))

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        found = sorted(os.path.join(path, n) for n in os.listdir(path) if n[0] not in "._") if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for name, sequence, quals in parse(f, self.qual_offset):
                yield os.path.basename(partition.path), name, sequence, quals


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxDataSource)
