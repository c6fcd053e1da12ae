"""Reads derived from the star-schema tables, for queries, tests and the bench; each with the same rules as SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import scratch

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
READ_LENGTH = 64


#: Paths of fixtures that were written before, by (sf_dir, name).
WRITTEN: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_reads(spark: SparkSession, sf_dir: str) -> None:
    """Write both kinds of reads, so that what reads them is timed without making them."""
    for name, make in (("amplicon", amplicon_reads), ("document", document_reads)):
        path = scratch.new_path(spark, name)
        make(spark, sf_dir).write.parquet(path)
        WRITTEN[sf_dir, name] = path


def _known(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    path = WRITTEN.get((sf_dir, name))
    return spark.read.parquet(path) if path else None


def templates(spark: SparkSession) -> DataFrame:
    """(tid, template): five random 64-mers, and a variant of the first at two places."""
    tid = spark.range(6).select(F.col("id").cast("int").alias("tid"))
    src = F.when(F.col("tid") == 5, 0).otherwise(F.col("tid")).cast("string")
    base = F.translate(F.concat(F.md5(F.concat(F.lit("t"), src)), F.md5(F.concat(F.lit("u"), src))), HEX, BASES)
    named = tid.select("tid", base.alias("b"))
    other = F.concat(F.substring("b", 1, 9), _swapped("b", 10), F.substring("b", 11, 29), _swapped("b", 40), F.substring("b", 41, 24))
    return named.select("tid", F.when(F.col("tid") == 5, other).otherwise(F.col("b")).alias("template"))


def _swapped(column: str, at: int):
    return F.translate(F.substring(column, at, 1), "ACGT", "CGTA")


def amplicon_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, id, sequence, qualities): six templates with rare single substitutions, a read a lineitem row."""
    if (known := _known(spark, sf_dir, "amplicon")) is not None:
        return known
    h = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey") * 3
    tid = F.when(h % 10 < 6, 0).when(h % 10 < 8, 1).otherwise(F.col("l_partkey") % 6).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", h.alias("h"), tid.alias("tid"))
    met = rows.join(F.broadcast(templates(spark)), "tid")  # six rows
    pos = (F.col("h") % READ_LENGTH + 1).cast("int")
    with_error = F.concat(
        F.substring(F.col("template"), F.lit(1), pos - 1),
        F.translate(F.substring(F.col("template"), pos, F.lit(1)), "ACGT", "CGTA"),
        F.substring(F.col("template"), pos + 1, F.lit(READ_LENGTH)),
    )
    quals = F.transform(F.sequence(F.lit(1), F.lit(READ_LENGTH)), lambda i: (F.lit(20) + (i * 3 + F.col("l_orderkey") + F.col("l_linenumber")) % 21).cast("int"))
    return met.select(
        F.lit("amp").alias("sample"),
        F.concat(F.lit("r"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("id"),
        F.when(F.col("h") % 197 == 0, with_error).otherwise(F.col("template")).alias("sequence"),
        quals.alias("qualities"),
    )


AMP_SQL = f"""
amp_t AS (
  SELECT tid, CASE WHEN tid = 5 THEN b[1:9] || translate(b[10], 'ACGT', 'CGTA') || b[11:39] || translate(b[40], 'ACGT', 'CGTA') || b[41:64] ELSE b END AS template
  FROM (SELECT tid, translate(md5('t' || src) || md5('u' || src), '{HEX}', '{BASES}') AS b
        FROM (SELECT i AS tid, CASE WHEN i = 5 THEN 0 ELSE i END AS src FROM range(6) r(i)))),
amp_l AS (
  SELECT l_orderkey, l_linenumber, h, CASE WHEN h % 10 < 6 THEN 0 WHEN h % 10 < 8 THEN 1 ELSE l_partkey % 6 END AS tid
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3 AS h FROM lineitem)),
amp AS (
  SELECT 'amp' AS sample, 'r' || l_orderkey || '_' || l_linenumber AS id, l_orderkey + l_linenumber AS shift,
         CASE WHEN h % 197 = 0 THEN substr(template, 1, h % 64) || translate(substr(template, h % 64 + 1, 1), 'ACGT', 'CGTA') || substr(template, h % 64 + 2)
              ELSE template END AS sequence
  FROM amp_l JOIN amp_t USING (tid)),
amp_u AS (SELECT sequence, count(*) AS abundance, row_number() OVER (ORDER BY count(*) DESC, sequence) - 1 AS raw_index FROM amp GROUP BY sequence)"""


def _whole_reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = bytes(range(97, 123))
    table, other = bytes.maketrans(letters, (b"ACGT" * 7)[:26]), bytes(set(range(256)) - set(letters))
    for batch in batches:
        bases = [t if t is None else t.lower().encode().translate(table, other).decode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("sample"), batch.column("id"), pa.array(bases, pa.string())], ["sample", "id", "sequence"])


def document_reads(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(sample, id, sequence): bases from all letters of each document, one read a document if ``whole``, else cut into
    reads of ``READ_LENGTH`` bases (the last one shorter; one empty read of a document without letters)."""
    if not whole and (known := _known(spark, sf_dir, "document")) is not None:
        return known
    if whole:
        return table(spark, sf_dir, "documents").select(F.lit("doc").alias("sample"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text").mapInArrow(_whole_reads, "sample string, id string, sequence string")
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    bases = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), bases.alias("sequence"))
    # Cut by one pass over the letters.
    reads = F.when(F.length("sequence") > 0, F.regexp_extract_all("sequence", F.lit(f".{{1,{READ_LENGTH}}}"), F.lit(0))).otherwise(F.array("sequence"))
    docs = docs.select("id", F.posexplode(reads).alias("k", "sequence")).select(F.concat_ws("_", "id", "k").alias("id"), "sequence")
    return docs.select(F.lit("doc").alias("sample"), "id", "sequence")


DOC_SQL = f"""
doc AS (SELECT 'd' || doc_id || '_' || k AS id, bases[k * {READ_LENGTH} + 1 : k * {READ_LENGTH} + {READ_LENGTH}] AS sequence
        FROM (SELECT doc_id, bases, unnest(range(0, greatest((length(bases) + {READ_LENGTH} - 1) // {READ_LENGTH}, 1))) AS k
              FROM (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS bases FROM documents)))"""


def state_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, comparisons, clusters) of a made-up partition of the customers, for operators that need some state.

    A customer is a sequence; clusters are seven; numbers are whole or exact binary fractions, so any engine agrees.
    """
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey")).cast("int").alias("raw_index"), (F.col("c_custkey") * 37 % 101 + 1).cast("long").alias("abundance"))
    cluster = (F.col("raw_index") % 7).cast("int")
    records = c.select(
        "raw_index",
        "abundance",
        cluster.alias("cluster_index"),
        F.floor(F.col("raw_index") / 7).cast("int").alias("ord"),
        ((F.col("raw_index") * 13 % 1024) / 1024.0).alias("p_value"),
        F.when(F.col("raw_index") % 11 != 0, (F.col("raw_index") * 29 % 64 + 1) / 4096.0).alias("comp_lambda"),
        F.when(F.col("raw_index") % 11 != 0, (F.col("raw_index") % 5).cast("int")).alias("comp_hamming"),
        (F.col("raw_index") % 17 == 0).alias("prior"),
    )
    seven = spark.range(7).select(F.col("id").cast("int").alias("cluster_index"))
    k = (F.col("raw_index") * 29 + F.col("cluster_index") * 31) % 64
    comparisons = (
        c.select("raw_index")
        .crossJoin(F.broadcast(seven))  # seven rows
        .where((F.col("raw_index") + F.col("cluster_index")) % 3 != 0)
        .select("cluster_index", "raw_index", ((k + 1) / 4096.0).alias("lambda"), ((F.col("raw_index") + F.col("cluster_index")) % 5).cast("int").alias("hamming"))
    )
    clusters = seven.select("cluster_index", F.col("cluster_index").alias("center_index"), ((F.col("cluster_index") + 1) * 1024).cast("long").alias("total_reads"))
    return records, comparisons, clusters


STATE_SQL = """
st_c AS (SELECT c_custkey::INT AS raw_index, c_custkey * 37 % 101 + 1 AS abundance FROM customer),
records AS (
  SELECT raw_index, abundance, raw_index % 7 AS cluster_index, raw_index // 7 AS ord, (raw_index * 13 % 1024) / 1024.0::DOUBLE AS p_value,
         CASE WHEN raw_index % 11 <> 0 THEN (raw_index * 29 % 64 + 1) / 4096.0::DOUBLE END AS comp_lambda,
         CASE WHEN raw_index % 11 <> 0 THEN raw_index % 5 END AS comp_hamming, raw_index % 17 = 0 AS prior FROM st_c),
clusters AS (SELECT i::INT AS cluster_index, i::INT AS center_index, (i + 1) * 1024 AS total_reads FROM range(7) r(i)),
comparisons AS (
  SELECT cluster_index, raw_index, ((raw_index * 29 + cluster_index * 31) % 64 + 1) / 4096.0::DOUBLE AS "lambda", (raw_index + cluster_index) % 5 AS hamming
  FROM st_c CROSS JOIN clusters WHERE (raw_index + cluster_index) % 3 <> 0)"""
