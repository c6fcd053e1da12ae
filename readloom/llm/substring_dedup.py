"""Substring dedup by recompression.

Words are ``[^\\x20\\x09-\\x0D]+``. A window is ``size`` consecutive words of one document. Every word is removed that a
window covers whose word sequence also starts in a document with a smaller doc_id; all windows are judged on the input.

1. Documents with equal word sequences are one class, stood for by its smallest doc_id. All words of the others go (if
   they have a window at all), and they say nothing about other documents that the smallest does not say.
2. Rounds of run and pair naming (``recompress``) turn each class into symbols of about six words. Names depend on content
   alone, and a symbol whose cone lies in a window occurs wherever the window does. One grouped minimum and maximum over
   all symbols shows the names that two documents share.
3. A window can only repeat if every symbol with its cone inside it is shared. Such windows, and the few that hold no
   symbol's cone, are told apart by 128 bits of blake2b of the words themselves, as are whole texts in step 1; the smallest
   doc_id of each window decides.

Edge cases: a null or empty text has no words; a text shorter than a window stays; rows with a null doc_id neither lose
words nor take them from others; rows that share a doc_id never take words from each other; repeated rows are treated
alike; an empty table gives an empty result; the kept words are joined by one space, also where nothing is removed. Other
columns pass through, clashing names are replaced.

Scale: what is shuffled is a sixth of the words as 16-byte symbol rows, the windows in question, and each text twice.
Grouped minima are combined on the map side, written, and read back by joins that Spark may split, so a passage that a third of all
documents share is no single task's work. No sequence is gathered beyond its own document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, bounded_batches, digests, discard, materialize, pieces, table
from .recompress import inside, per_window, recompress

SIZE = 50
ROUNDS = ("run", "pair", "pair", "pair", "run", "pair", "pair", "pair")


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values))


def _valid(words: Words, size: int) -> np.ndarray:
    """Words from which a window starts."""
    n = len(words.names)
    return np.arange(n) + size <= words.first[words.owner() + 1] if n else np.zeros(0, bool)


def _window_prints(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """128 bits of blake2b of the windows that begin at some words: of their words, joined by one space."""
    joined = np.frombuffer(b" ".join(words.texts()), np.uint8)
    lengths = words.ends - words.starts
    # Each word and one space after it, and one more space after a text without words.
    gaps = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(gaps, words.first[:-1][words.counts == 0], 1)
    starts = np.concatenate(([0], np.cumsum(lengths + 1))) + np.cumsum(gaps)
    raw = memoryview(joined)
    last = at + size - 1
    return digests(raw[a:b] for a, b in zip(starts[at].tolist(), (starts[last] + lengths[last]).tolist(), strict=True))


def _symbols(size: int, rounds: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=False)
            s = recompress(words.names, words.first, rounds)
            good = inside(s, size)
            bare = _valid(words, size) & (per_window(s, good, size, len(words.names)) == 0)
            has_bare = np.bincount(words.owner()[bare], minlength=batch.num_rows) > 0
            order = np.lexsort((s.name[good], s.owner[good]))
            name, owner = s.name[good][order], s.owner[good][order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
            prints = words.fingerprints()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.counts), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(has_bare), _lists(name[new].view(np.int64), owner[new], batch.num_rows)],
                ["doc_id", "n_words", "f1", "f2", "bare", "names"],
            )

    return run


def _windows(size: int, rounds: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=False)
            # A doc_id may come with several texts: the class's own text has its fingerprint.
            tags = words.fingerprints()[:, 0]
            mine = tags == batch.column("f1").to_numpy()
            s = recompress(words.names, words.first, rounds)
            good = inside(s, size)
            n = len(words.names)
            common = np.unique(batch.column("common").flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            shared = good & np.isin(s.name, common)
            owner = words.owner()
            ask = np.flatnonzero(_valid(words, size) & mine[owner] & (per_window(s, good, size, n) == per_window(s, shared, size, n)))
            of = owner[ask]
            ids = batch.column("doc_id").to_numpy()
            prints = _window_prints(words, ask, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(ids[of]), pa.array(tags[of]), pa.array((ask - words.first[of]).astype(np.int32))],
                ["w1", "w2", "doc_id", "tag", "pos"],
            )

    return run


def _trimmed(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column("text"), lower=False)
            tags = words.fingerprints()[:, 0].tolist()
            kept, n_words, n_removed = [], [], []
            for text, tag, cuts in zip(batch.column("text").to_pylist(), tags, batch.column("__cuts").to_pylist(), strict=True):
                own = (text or "").encode().split()
                stay = own
                cut = next((c for c in cuts or () if c["tag"] == tag), None)
                if cut and cut["pos"] is None:
                    stay = []
                elif cut:
                    steps = np.zeros(len(own) + 1, np.int64)
                    at = np.array(cut["pos"])
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + size, -1)
                    stay = [w for w, c in zip(own, np.cumsum(steps)[:-1].tolist(), strict=True) if not c]
                kept.append(b" ".join(stay).decode())
                n_words.append(len(own))
                n_removed.append(len(own) - len(stay))
            new = {"text": pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return run


def removals(docs: DataFrame, size: int = SIZE, rounds: tuple[str, ...] = ROUNDS) -> DataFrame:
    """(doc_id, tag, pos): starts of the windows to remove in the text with that tag; null for a text that goes whole."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = materialize(texts.mapInArrow(_symbols(size, rounds), "doc_id long, n_words long, f1 long, f2 long, bare boolean, names array<long>").where(f"n_words >= {size}"), "symbols")
    one = F.min(F.struct("doc_id", "bare", "names")).alias("one")
    classes = materialize(known.groupBy("f1", "f2", "n_words").agg(one).select("f1", "f2", "n_words", "one.*"), "classes")
    keys = ["f1", "f2", "n_words"]
    copies = known.select("doc_id", *keys).join(classes.select(*keys, F.col("doc_id").alias("rep")).hint("merge"), keys)
    copies = materialize(copies.where("doc_id > rep").select("doc_id", F.col("f1").alias("tag")).distinct(), "copies")
    discard(known)

    named = classes.select("doc_id", "f1", F.explode("names").alias("name"))
    shared = named.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("name")
    shared = materialize(shared, "shared")
    common = named.join(shared.hint("merge"), "name").groupBy("doc_id", "f1").agg(F.collect_list("name").alias("common"))
    bare = classes.where("bare").select("doc_id", "f1", F.array().cast("array<long>").alias("common"))
    asked = common.unionByName(bare).groupBy("doc_id", "f1").agg(F.flatten(F.collect_list("common")).alias("common"))
    asked = materialize(asked, "asked")
    discard(classes)

    windows = texts.join(asked.hint("merge"), "doc_id").mapInArrow(_windows(size, rounds), "w1 long, w2 long, doc_id long, tag long, pos int")
    windows = materialize(windows, "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    first = materialize(first, "first")
    again = windows.join(first.hint("merge"), ["w1", "w2"]).where("doc_id > lo").groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("pos"))
    return again.unionByName(copies.withColumn("pos", F.lit(None).cast("array<int>")))


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept words, and ``n_words`` and ``n_removed``."""
    docs = docs.drop("n_words", "n_removed", "__cuts", "__of")
    cuts = removals(docs, size).groupBy(F.col("doc_id").alias("__of")).agg(F.collect_list(F.struct("tag", "pos")).alias("__cuts"))
    cuts = materialize(cuts, "cuts")
    names = [*docs.columns, "n_words", "n_removed"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long"
    return docs.join(cuts.hint("merge"), F.col("doc_id").cast("long") == F.col("__of"), "left").drop("__of").mapInArrow(_trimmed(size, names), kinds)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, p, sha256(array_to_string(ws[p : p + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS p FROM w)),
m AS (SELECT g, min(doc_id) AS lo FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM s JOIN m ON s.g = m.g AND s.doc_id > m.lo),
t AS (SELECT doc_id, i, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT t.doc_id, count(*) FILTER (WHERE c.i IS NOT NULL) AS gone, string_agg(x, ' ' ORDER BY t.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
