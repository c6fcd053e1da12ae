"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here, field by field; from it come the normaliser (its character map, dummy prefix, space
handling), the metaspace marker, the pieces with their scores, and byte fallback. A unigram model becomes a Unigram with
those scores; a BPE model becomes a BPE whose merges are all splits of a piece into two pieces, in order of the piece's
score. Batches are encoded by several threads. Every row is checked: the ids against the sentencepiece library (``parity``),
and the decoded text against the normalised text (``round_trip``).

Where no piece of the model goes from another character into a marker, ids cannot reach over the begin of a word: a text's
ids are those of its cuts (a run of spaces and what follows), put together. Then each distinct cut of a batch is encoded
once by either library and compared, and many are remembered, instead of every occurrence; cuts are told apart by their bytes
(of more than 16, by 128 bits of blake2b). Other models, and texts with the marker itself, are encoded and compared as whole texts.

Edge cases: a null or empty text has no ids, decodes to the empty text and counts as in parity; control pieces such as
``<s>`` or ``<0x0A>`` written in a text are ordinary characters; the marker U+2581 written in a text reads as a space.
Repeated rows get equal ids; other columns pass through, clashing names are replaced.

Scale: a row-wise map with no shuffle; a worker holds one model and one piece of text at a time.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, digests, flat, identities, named, numbered, pieces, table

MARK = "▁"
#: Bytes of text encoded in one call, and threads that a worker's calls use.
CALL_BYTES, THREADS = 1 << 21, 2
#: Cuts whose ids a worker remembers: the first that it meets, so nearly all frequent ones.
CACHED = 400_000
#: A text's cuts: markers and what follows them.
CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
COLUMNS = ("ids", "ids_sha256", "decoded", "parity", "round_trip")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- the model file -------------------------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width and length-delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} is not used by sentencepiece models")
            size = varint()
        if at + size > len(data):
            raise ValueError("the model file ends inside a field")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unk_id(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 24:
                    model.suffix_mark = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.collapse_spaces = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
    return model


def separable(model: Model) -> bool:
    """Whether no piece goes from another character into a marker: then a text may be cut there without changing its ids."""
    return not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces)


def build_tokenizer(model: Model):
    """A tokenizers.Tokenizer that gives the model's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_mark or not model.escape_spaces:
        raise ValueError("models with a suffix marker or plain spaces are not supported")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.collapse_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.model_type == UNIGRAM:
        body = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    elif model.model_type == BPE:
        merged = []
        plain = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        for p in plain:
            for cut in range(1, len(p)):
                if p[:cut] in plain and p[cut:] in plain:
                    merged.append((-model.pieces[plain[p]][1], plain[p], cut, p[:cut], p[cut:]))
        merged.sort()
        body = models.BPE(ids, [m[3:] for m in merged], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is not supported")
    out = Tokenizer(body)
    out.normalizer = normalizers.Sequence(steps)
    if separable(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(CUT.pattern), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


def decode_ids(ids: list[int], table: list[bytes], dummy_prefix: bool) -> str:
    """The text of some ids: piece bytes put together, which also joins the bytes that byte fallback split."""
    text = b"".join([table[i] for i in ids]).decode(errors="replace")
    return text[1:] if dummy_prefix and text.startswith(" ") else text


def piece_bytes(model: Model) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]


# --- in the workers -------------------------------------------------------------------------------------------------


class Codec:
    """Encodes and decodes batches. Distinct cuts of a batch are encoded once, by several threads, and many remembered."""

    def __init__(self, data: bytes):
        import sentencepiece
        from tokenizers import normalizers

        self.model = model = parse_model(data)
        self.whole = build_tokenizer(model)
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.table = piece_bytes(model)
        self.flat_table = np.frombuffer(b"".join(self.table), np.uint8)
        self.sizes = np.array([len(p) for p in self.table])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.cut = build_tokenizer(model)
        self.cut.normalizer = self.cut.pre_tokenizer = None
        self.charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None
        self.plain = not model.charsmap and not model.collapse_spaces
        #: Whether texts can be cut as bytes: then a cut begins at each run of spaces.
        self.by_bytes = self.plain and separable(model)
        #: Remembered cuts, by name: their identities, how many ids, where they stand in the pool, and whether sentencepiece agrees.
        self.names, self.lo, self.hi = (np.zeros(0, np.uint64) for _ in range(3))
        self.counts, self.at, self.agrees = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, np.int32)

    def normalise(self, text: str) -> str:
        """What the tokenizer's normaliser gives, without its record of where each character came from."""
        model = self.model
        if model.charsmap:
            text = self.charsmap.normalize_str(text)
        if model.collapse_spaces:
            text = re.sub(" {2,}", " ", text).strip(" ")
        text = text.replace(" ", MARK)
        return MARK + text if model.dummy_prefix and text else text

    def encode(self, texts: list[str]) -> list[list[int]]:
        if separable(self.model):
            cuts = [CUT.findall(self.normalise(t)) for t in texts]
            own = list({c for x in cuts for c in x})
            ids = dict(zip(own, (e.ids for e in self.cut.encode_batch_fast(own, add_special_tokens=False)), strict=True))
            return [list(chain.from_iterable(map(ids.__getitem__, x))) for x in cuts]
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end, whether sentencepiece agrees); a null text has no ids.

        Where texts can be cut, agreement on every cut is agreement on the text; else whole texts are compared.
        """
        data, offsets = flat(column)
        if not self.by_bytes or MARK.encode() in data.tobytes():
            texts = [t or "" for t in column.to_pylist()]
            ids = self.encode(texts)
            ends = np.cumsum([0, *map(len, ids)])
            agrees = np.array([a == b for a, b in zip(ids, self.theirs.encode(texts, num_threads=1), strict=True)], bool)
            return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), ends, agrees
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.ones(len(offsets) - 1, bool)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        texts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[texts] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        leads = np.zeros(len(data), bool)
        leads[texts] = True
        leads = leads[starts]
        lo, hi = identities(data, starts, ends)
        # A text's first cut gets the dummy prefix, so it is another one; no text holds a byte 255.
        raw = data.tobytes()
        first = digests(b"\xff" + raw[a:b] for a, b in zip(starts[leads].tolist(), ends[leads].tolist(), strict=True)).view(np.uint64)
        lo[leads], hi[leads] = first.T
        names = named(lo, hi)
        at, back = numbered(names, lo, hi)
        names, lo, hi = names[at], lo[at], hi[at]
        place = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        hit = (self.names[place] == names) & (self.lo[place] == lo) & (self.hi[place] == hi) if len(self.names) else np.zeros(len(names), bool)
        prefix = MARK if self.model.dummy_prefix else ""
        cuts = [(prefix if leads[i] else "") + raw[starts[i] : ends[i]].decode().replace(" ", MARK) for i in at[~hit].tolist()]
        new = [e.ids for e in self.cut.encode_batch_fast(cuts, add_special_tokens=False)]
        theirs = self.theirs.encode([c[len(prefix) :].replace(MARK, " ") for c in cuts], num_threads=1)
        if prefix and MARK in cuts:  # a last space: alone it would be the empty text
            theirs[cuts.index(MARK)] = self.theirs.encode("a ")[len(self.theirs.encode("a")) :]
        new_counts = np.fromiter(map(len, new), np.int64, len(new))
        counts, where, agrees = np.empty(len(names), np.int64), np.empty(len(names), np.int64), np.empty(len(names), bool)
        if len(self.names):
            counts[hit], where[hit], agrees[hit] = self.counts[place[hit]], self.at[place[hit]], self.agrees[place[hit]]
        counts[~hit], where[~hit] = new_counts, len(self.pool) + np.cumsum(new_counts) - new_counts
        agrees[~hit] = [a == b for a, b in zip(new, theirs, strict=True)]
        pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(new), np.int32, int(new_counts.sum()))])
        per_cut = counts[back]
        stops = np.concatenate(([0], np.cumsum(per_cut)))
        ids = pool[np.repeat(where[back] - stops[:-1], per_cut) + np.arange(stops[-1])]
        if len(self.names) < CACHED:
            order = np.argsort(np.concatenate([self.names, names[~hit]]))
            both = ((self.names, names), (self.lo, lo), (self.hi, hi), (self.counts, counts), (self.at, where), (self.agrees, agrees))
            self.names, self.lo, self.hi, self.counts, self.at, self.agrees = (np.concatenate([x, y[~hit]])[order] for x, y in both)
            self.pool = pool
        good = np.ones(len(offsets) - 1, bool)
        good[np.searchsorted(offsets, starts[~agrees[back]], "right") - 1] = False
        return ids, stops[np.searchsorted(starts, offsets)], good

    def decode(self, ids: list[int]) -> str:
        return decode_ids(ids, self.table, self.model.dummy_prefix)

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of all ids: piece bytes put together, the dummy prefix taken off."""
        sizes = self.sizes[ids]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        out = self.flat_table[np.repeat(self.places[ids] - stops[:-1], sizes) + np.arange(stops[-1])]
        cuts = stops[ends]
        if self.model.dummy_prefix:
            first = cuts[:-1][cuts[:-1] < cuts[1:]]
            first = first[out[first] == 32]
            out = np.delete(out, first)
            cuts = cuts - np.searchsorted(first, cuts)
        try:
            column = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])
            column.validate(full=True)
            return column
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8 together
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in pairwise(ends)], pa.string())


@lru_cache(2)
def _loaded(path: str, threads: int) -> Codec:
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    if not os.path.isabs(path):
        path = SparkFiles.get(path)
    with open(path, "rb") as f:
        return Codec(f.read())


def coded(column: pa.Array, path: str, threads: int = THREADS) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(ids, their ends, decoded texts, whether the sentencepiece library agrees, whether decoding gives the text)."""
    codec = _loaded(path, threads)
    ids, ends, parity = codec.encode_column(column)
    decoded = codec.decode_column(ids, ends)
    texts = [t or "" for t in column.to_pylist()]
    wanted = [t.replace(MARK, " ") for t in texts] if codec.plain else [codec.theirs.decode(ids[a:b].tolist()) for a, b in pairwise(ends)]
    return ids, ends, decoded, parity, np.array([a == b for a, b in zip(decoded.to_pylist(), wanted, strict=True)], bool)


def _coded(path: str, threads: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=CALL_BYTES):
            ids, ends, decoded, parity, same = coded(batch.column("text"), path, threads)
            digests = [sha256(ids[a:b].tobytes()).hexdigest() for a, b in pairwise(ends)]
            new = [pa.ListArray.from_arrays(ends.astype(np.int32), ids), pa.array(digests, pa.string()), decoded, pa.array(parity), pa.array(same)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *COLUMNS])

    return run


def encode(docs: DataFrame, model_path: str | None = None, threads: int = THREADS) -> DataFrame:
    """``docs`` with ``ids``, ``ids_sha256`` (of the ids as 32-bit little-endian), ``decoded``, ``parity`` and ``round_trip``.

    ``model_path`` must exist on every machine, or be the name of a file shipped with ``SparkContext.addFile``.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*COLUMNS)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_coded(model_path or default_model(), threads, docs.columns), f"{kinds}, ids array<int>, ids_sha256 string, decoded string, parity boolean, round_trip boolean")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's token count, a digest of its ids, of the decoded text, and the two checks."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "parity",
        "round_trip",
    )
