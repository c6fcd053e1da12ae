"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A benchmark item leaks into a document if at least ``threshold`` of the item's distinct word shingles occur in it.
Items are partitioned by size (powers of two of their shingle count). Within a partition an item's signature is its
``floor((1 - threshold) * upper size) + 1`` smallest shingle hashes, a bottom-k MinHash: a document that holds the
asked share of the item's shingles must hold one of them, as it lacks fewer than the signature has. So the search for
short items inside documents of any length loses nothing, which a signature of the documents could not promise: an
item's share of a long document's minima vanishes with the document's length. Documents probe the signatures with all
their shingle hashes, each made from the hashes of its words; candidates are then verified on the shingles themselves, as strings.

Main path: DataFrame expressions only.

Edge cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; an item of fewer than ``size`` words is one shingle
of all its words, looked for among the word runs of that length; a null or empty item or text has no shingles and leaks
nowhere. Rows that share a doc_id are one document in the result (the largest containment counts); a null doc_id is
reported as null, and its documents too count as one. Repeated items and items with one text are each reported. Extra
columns are ignored here and kept by ``clean``; an empty benchmark or an empty table gives no rows.

Scale: shingle hashes are made and probed inside each task; only hits leave it. The signatures (a fifth of the
benchmark's shingles) are joined under Spark's own size threshold, so a benchmark that outgrows a broadcast is shuffled
against hashes instead. Only candidate documents move to be verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, table

SIZE, THRESHOLD = 5, 0.8
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, _SPACE), lambda w: w != "")


def _runs(ws: Column, width: Column | int) -> Column:
    """Every run of ``width`` words, as arrays; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(ws) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(ws, i, width))).otherwise(F.array().cast("array<array<string>>"))


def _run_hashes(hashes: Column, width: int) -> Column:
    """A hash of every run of ``width`` words, from the hashes of the words."""
    last = F.size(hashes) - width + 1
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.lit("item"), *(F.element_at(hashes, i + k) for k in range(width))))
    return F.when(last >= 1, each).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def items_table(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, row, width, shingles, hashes): each item's distinct shingles as strings and by hash; items without words are left out."""
    ws = benchmark.select("item_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    width = F.least(F.size("ws"), F.lit(size))
    runs = F.transform(_runs(F.col("ws"), width), lambda r: F.array_join(r, " "))

    def hashed(w: int) -> Column:
        return _bound(_word_hashes(F.col("ws")), lambda h: F.array_distinct(_run_hashes(h, w)))

    hashes = F.coalesce(*(F.when(width == w, hashed(w)) for w in range(1, size + 1)))
    return ws.select("item_id", "row", width.alias("width"), F.array_distinct(runs).alias("shingles"), hashes.alias("hashes"))


def signatures(items: DataFrame, threshold: float) -> DataFrame:
    """(row, hash): the bottom-k MinHash of each item, k by its size partition."""
    hashes = F.array_sort("hashes")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles").cast("double"))))
    k = (F.floor(upper * (1 - threshold) + 1e-9) + 1).cast("int")
    return items.select("row", F.explode(F.slice(hashes, F.lit(1), k)).alias("hash"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every leak."""
    items = materialize(items_table(benchmark, size), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most ``size`` numbers
    index = signatures(items, threshold)
    if not widths:
        widths = [size]

    def probes(hashes: Column) -> Column:
        each = [_run_hashes(hashes, w) for w in widths]
        return F.array_distinct(F.concat(*each) if len(each) > 1 else each[0])

    texts = docs.select("doc_id", "text")
    hits = texts.select("doc_id", F.explode(_bound(_word_hashes(words(F.col("text"))), probes)).alias("hash")).join(index, "hash")
    pairs = materialize(hits.select("doc_id", "row").distinct(), "candidates")
    found = pairs.select(F.col("doc_id").alias("of"), "row").groupBy("of").agg(F.collect_set("row").alias("rows"))
    held = texts.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", words(F.col("text")).alias("ws"), F.explode("rows").alias("row"))
    both = held.join(items.drop("hashes"), "row")
    own = F.transform(_runs(F.col("ws"), F.col("width")), lambda r: F.array_join(r, " "))
    n_item, shared = F.size("shingles").cast("long"), F.size(F.array_intersect("shingles", own)).cast("long")
    exact = both.select("doc_id", "item_id", "row", n_item.alias("n_item"), shared.alias("n_shared"))
    best = exact.groupBy("doc_id", "row").agg(F.first("item_id").alias("item_id"), F.first("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    leaks = best.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - F.lit(1e-9))
    return leaks.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents into which an item leaks."""
    leaked = materialize(find_leaks(docs, benchmark, size, threshold).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    return docs.join(leaked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__leaked")), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
iw AS (
  SELECT item_id, ws, least(len(ws), 5) AS k
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM iw)),
d AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p : p + k - 1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS p FROM dw CROSS JOIN (SELECT DISTINCT k FROM iw))),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i ON d.g = i.g AND d.k = i.k GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM c JOIN n USING (item_id)
WHERE n_shared >= 0.8 * n_item - 1e-9
"""
