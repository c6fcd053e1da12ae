"""What the operators share: scratch tables, bounded Arrow pieces and vectorised words.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` of the UTF-8 text. A word is known by 128 bits: its
bytes themselves up to 16 of them, blake2b of longer ones. Names of 64 bits are mixed from these; they propose, and what they
propose is decided on the words: by blake2b of whole texts and passages, or by ids that tell all words of a piece apart.
All are functions of content alone, so every task on every machine gives equal words, shingles and windows equal names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readloom.scratch import delete
from readloom.scratch import root as scratch_root

#: Bytes of text that one vectorised step works on (a longer single text is a step of its own).
PIECE_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Seconds between two requests that Spark drop the shuffle files of finished plans.
RELEASE_SECONDS = 10.0


# --- scratch tables -------------------------------------------------------------------------------------------------


def materialize(df: DataFrame, what: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The reread table has true size statistics, so Spark's own threshold decides whether a join may broadcast it.
    ``by``: an integer column whose values become folders, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/readloom/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    release_shuffles(spark)
    return out


_released = 0.0


def release_shuffles(spark: SparkSession) -> None:
    """Now and then let Spark's cleaner drop shuffle files that no live plan needs: it acts on what the driver's JVM collects."""
    global _released
    if time.monotonic() - _released > RELEASE_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    delete(df.sparkSession, df.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that operators have written; call it when no result that still reads them is needed."""
    delete(spark, f"{scratch_root(spark)}/readloom")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the row sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- texts as flat bytes --------------------------------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


# --- words ----------------------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E6C63D0876A9A35)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xB5C3A1F94D7E2D6B)
    x ^= x >> np.uint64(32)
    return x


_KEYS = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: The bytes from the k-th on, as ones: UTF-8 has no such byte, so padding with it keeps shorter spans apart from longer ones.
_PADDING = np.array([(0xFFFFFFFFFFFFFFFF << 8 * k) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span of UTF-8: its padded bytes where these are 16 at most, else blake2b of them."""
    length = ends - starts
    padded = np.concatenate([data, np.full(16, 255, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    lo = eight[starts] | _PADDING[np.minimum(length, 8)]
    hi = eight[starts + 8] | _PADDING[np.clip(length - 8, 0, 8)]
    long = np.flatnonzero(length > 16)
    if len(long):
        view = memoryview(padded)
        lo[long], hi[long] = digests(view[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)).view(np.uint64).T
    return lo, hi


def named(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit name of each 128-bit identity; of spans of eight bytes at most no two share one."""
    return mix(hi ^ mix(lo ^ mix(hi + _KEYS[0])) + _KEYS[1])


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return named(*identities(data, starts, ends))


def numbered(names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence of each distinct span, number of each span's distinct one), told apart by identities, not by names."""
    _, first, back = np.unique(names, return_index=True, return_inverse=True)
    if (lo == lo[first][back]).all() and (hi == hi[first][back]).all():
        return first, back
    order = np.lexsort((hi, lo))
    new = np.ones(len(order), bool)
    new[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of two passages put together, in this order."""
    return mix(mix(a) * np.uint64(0x9A3298AFB5AC7175) + b)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Words:
    """All words of some texts: byte spans, each text's first word, and identities and a 64-bit name of each word."""

    def __init__(self, column: pa.Array, lower: bool):
        data, offsets = flat(column)
        self.data, self.offsets = _FOLD[data] if lower else data, offsets
        inside = ~SPACE[data]
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        some = offsets[:-1][offsets[:-1] < offsets[1:]]
        head[some] = inside[some]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        tail[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.lo, self.hi = identities(self.data, self.starts, self.ends)
        self.names = named(self.lo, self.hi)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """A 64-bit name of the ``size`` words from each word on (right only where they stay inside one text)."""
        n = len(self.names)
        if n < size:
            return np.zeros(0, np.uint64)
        out, have, power, width = None, 0, self.names, 1
        while True:
            if size & width:
                out = power if out is None else joined(out[: n - have - width + 1], power[have:])
                have += width
            if have == size:
                return out
            power = joined(power[:-width], power[width:])
            width *= 2

    def texts(self) -> list[bytes]:
        """Each text's words, joined by one space."""
        raw = self.data.tobytes()
        return [b" ".join(raw[a:b].split()) for a, b in pairwise(self.offsets.tolist())]

    def fingerprints(self) -> np.ndarray:
        """128 bits of blake2b of each text's word sequence, as two columns."""
        return digests(self.texts())


def digests(parts) -> np.ndarray:
    """128 bits of blake2b of each byte string, as two columns of 64-bit numbers."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)


def _sets(name: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    name, owner = name[new], owner[new]
    return name, np.searchsorted(owner, np.arange(n + 1))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of each text, flat, with offsets; a text of fewer words is one shingle, of none no set."""
    owner, n = words.owner(), len(words.names)
    names, owners = [], []
    if n >= size:
        fits = owner[: n - size + 1] == owner[size - 1 :]
        names.append(words.windows(size)[fits])
        owners.append(owner[: n - size + 1][fits])
    for k in range(1, size):
        own = np.flatnonzero(words.counts == k)
        if len(own):
            whole = words.names[words.first[own]]
            for i in range(1, k):
                whole = joined(whole, words.names[words.first[own] + i])
            names.append(mix(whole + _KEYS[2] * np.uint64(k)))
            owners.append(own)
    if not names:
        return np.zeros(0, np.uint64), np.zeros(len(words.counts) + 1, np.int64)
    return _sets(np.concatenate(names), np.concatenate(owners), len(words.counts))


def exact_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with numbers that tell all shingles of these texts apart instead of names."""
    _, word = numbered(words.names, words.lo, words.hi)
    owner, n = words.owner(), len(word)
    base = int(word.max(initial=-1)) + 2
    # A text's end counts as word 0, so shorter shingles stand beside longer ones.
    follow = np.concatenate([word + 1, np.zeros(size, word.dtype)])
    stays = np.concatenate([owner, np.full(size, -1)])
    run = follow[:n].copy()
    for k in range(1, size):
        after = np.where(stays[k : n + k] == owner, follow[k : n + k], 0)
        run = np.unique(run * base + after, return_inverse=True)[1]
    whole = stays[size - 1 : n + size - 1] == owner
    keep = whole | ((np.arange(n) == words.first[owner]) & (words.counts[owner] < size))
    return _sets(run[keep], owner[keep], len(words.counts))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
