"""Alignment of columns of sequence pairs, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.functions.alignment import align_pairs

#: Bytes of pairs that a task aligns together: the more, the closer are the lengths in a block.
HELD_BYTES = 32 << 20
#: Rows of a batch that is passed on.
OUT_ROWS = 1024


def align(pairs: DataFrame, match: int = 5, mismatch: int = -4, gap: int = -8, homo_gap: int | None = None, band: int = -1) -> DataFrame:
    """``pairs`` (s1, s2, ...) with ``score``, ``query_align`` (of s1) and ``ref_align`` (of s2).

    End gaps are free. ``homo_gap`` replaces ``gap`` where the base that a gap skips stands in a run of three or more; None
    takes ``gap`` everywhere. A negative ``band`` means none. A null side counts as empty.
    """
    names = [c for c in pairs.columns if c not in ("score", "query_align", "ref_align")]
    pairs = pairs.select(*names)

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [pair for batch in held for pair in zip(*([s or "" for s in batch.column(c).to_pylist()] for c in ("s1", "s2")), strict=True)]
        found = align_pairs(both, match, mismatch, gap, homo_gap, band)
        at = 0
        for batch in held:
            for start in range(0, batch.num_rows, OUT_ROWS):
                own = batch.slice(start, OUT_ROWS)
                rows = found[at : at + own.num_rows]
                found[at : at + own.num_rows] = [None] * own.num_rows
                at += own.num_rows
                new = [pa.array([f[k] for f in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *new], [*names, "score", "query_align", "ref_align"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from told(held)
                held, size = [], 0
        if held:
            yield from told(held)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{kinds}, score int, query_align string, ref_align string")
