"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, except in the largest doc_id
that holds the key. Other lines stay in place, joined by a line feed.

Edge cases: a null or empty text is one empty line; rows that share a doc_id are one document, counted once a key, and keep or
lose a key together; a row with a null doc_id is no document: its lines do not count, and all stay;
an empty table gives an empty result; other columns pass through untouched, and clashing names are replaced.

Scale: only (doc_id, 128-bit key) rows are exploded and shuffled, once per document and key. They are made distinct by both columns, so
a line found in a third of all documents is spread over all tasks, and then counted with sums combined on the map side. The keys over the
threshold are written and come back by a join that Spark may split where a key is hot; texts move once, to meet their own list of keys to drop
(by a merge join at every size, so that the plan does not change with the input).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, materialize, table

MIN_CHARS, MIN_DOCS = 20, 3
_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their 16-byte keys, None for a line whose key is too short to count."""
    lines = (text or "").encode().split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(_STRIP).lower()  # bytes.lower() touches A-Z alone
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        keys.append(blake2b(key, digest_size=16).digest() if long else None)
    return lines, keys


def _exploded(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {k for k in line_keys(text, min_chars)[1] if k}
                ids += [doc_id] * len(keys)
                out += keys
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key"])

    return run


def _reassembled(min_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("__drop").to_pylist(), strict=True):
                lines, keys = line_keys(text, min_chars) if drop else ((text or "").encode().split(b"\n"), [])
                gone = set(drop or ())
                stay = [line for line, key in zip(lines, keys, strict=True) if key not in gone] if drop else lines
                kept.append(b"\n".join(stay).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            new = {"text": pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, None) if c in new else batch.column(c) for c in names], names)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, and ``n_lines`` and ``n_dropped``."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped", "__drop", "__of")
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(_exploded(min_chars), "doc_id long, key binary")
    # Distinct by (doc_id, key) first: rows that share a doc_id are one document.
    often = lines.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    often = materialize(often, "often")
    gone = lines.join(often.hint("merge"), "key").where(F.col("doc_id") != F.col("keep"))
    drops = materialize(gone.groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set("key").alias("__drop")), "lines")
    met = docs.join(drops.hint("merge"), F.col("doc_id").cast("long") == F.col("__of"), "left").drop("__of")
    names = [*docs.columns, "n_lines", "n_dropped"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    return met.mapInArrow(_reassembled(min_chars, names), kinds)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, p, ls[p] AS line,
         translate(trim(ls[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
h AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, coalesce(h.k IS NOT NULL AND l.doc_id <> h.keep, false) AS gone FROM l LEFT JOIN h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
