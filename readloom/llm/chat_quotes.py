"""Chat formatting by quotation linking.

Lines that begin with ``>`` are quotations; the number of marks is the level. A message's own text is what is left
without them, without the line that announces a quotation ("... wrote:"), and with runs of empty lines closed up. Units
of text are paragraphs (their lines put together, so that wrapping does not matter), single lines and the sentences of
both, with white space collapsed and A-Z lower-cased, known by 128 bits of a hash. A quoted unit is linked to the earliest
message of its conversation, before the quoting one, whose own text has the unit; one that no message of the conversation
has is linked to the earliest message of all others (``source_conv``, ``source_turn``). Quoted lines and paragraphs under
``MIN_CHARS`` ("Yes.") link inside their conversation only. The message that most level-1 paragraphs and lines link to is
the parent (of several, the one with most sentences, then most short units, then the earliest); following parents leads to
the thread's first message. A quotation that holds no whole sentence, line or paragraph of its source links nothing.

The result has a row a message: its own text, links, parent, depth, thread and ``formatted`` chat text. Conversations in
reply order are the rows in the order of (conv_id, thread, turn): a reply's turn is always after its parent's.

Edge cases: a null or empty text has no units; messages with a null conv_id or turn are their own thread and link to
nothing; of rows that share (conv_id, turn) each is returned, with the links of all of them; an empty table gives an
empty result; other columns pass through, clashing names are replaced.

Scale: only hashes move before the links; originals are reduced to one row a unit, on the map side first, so a first turn
that a third of all conversations share is one row; grouped sides of joins are written first, so a join on a unit that very many
messages have ("Thank you very much.") may be split. Threads are found by pointer doubling
over linked messages alone. No conversation is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, discard, materialize, table

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SAYS = re.compile(r".*\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
_EMPTY = re.compile(r"\n{3,}")
_SENTENCE = re.compile(r"\S.*?(?:[.!?\u2026]++[\"')\]\u201d\u2019\u00bb]*(?=\s|$)|[\u3002\uff01\uff1f]+[\u300d\u300f\u201d]*|$)")
#: Shorter units (in bytes, normalised) link only inside their conversation.
MIN_CHARS = 8
#: Bytes of a unit's hash; those of short units differ, so that they are told apart.
LONG_BYTES, SHORT_BYTES = 16, 15
#: What a unit is: a paragraph or line, a sentence in one, or a short paragraph, line or sentence.
WHOLE, PART, SHORT, SHORT_PART = range(4)
ADDED = ("n_quotes", "n_linked", "parent_turn", "source_conv", "source_turn", "thread", "depth", "formatted")


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own text, and its quoted passages as (level, lines)."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in (text or "").split("\n"):
        found = _QUOTE.match(line)
        level = found[1].count(">") if found else 0
        if level:
            if not level_before:
                at = next((i for i in range(len(own) - 1, -1, -1) if own[i].strip()), None)
                if at is not None and _SAYS.match(own[at]):
                    del own[at:]
            if level != level_before:
                quotes.append((level, []))
            quotes[-1][1].append(line[found.end() :])
        else:
            own.append(line)
        level_before = level
    kept = "\n".join(own)
    return (_EMPTY.sub("\n\n", kept).strip("\n") if quotes else kept), quotes


def units(lines: list[str]) -> list[bytes]:
    """Hashes of the paragraphs, lines and sentences of a passage, each once."""
    return [u for u, kind in kinds_of(lines).items() if kind < SHORT]


def kinds_of(lines: list[str]) -> dict[bytes, int]:
    """The units of a passage, short ones too, and what they are; of several, the first."""
    texts: dict[str, None] = {}
    paragraph: list[str] = []
    for line in [*lines, ""]:
        words = line.split()
        if words:
            paragraph += words
        elif paragraph:
            texts[" ".join(paragraph)] = None
            paragraph = []
        if words:
            texts[" ".join(words)] = None
    out: dict[bytes, int] = {}
    for text in texts:
        _unit(text, WHOLE, out)
    for sentence in dict.fromkeys(x for text in texts for x in _SENTENCE.findall(text) if x not in texts):
        _unit(sentence.strip(), PART, out)
    return out


def _unit(text: str, kind: int, out: dict[bytes, int]) -> None:
    plain = text.encode().lower()
    short = len(plain) < MIN_CHARS
    out.setdefault(blake2b(plain, digest_size=SHORT_BYTES if short else LONG_BYTES).digest(), kind + SHORT if short else kind)


_UNITS = pa.list_(pa.struct([("level", pa.int32()), ("kind", pa.int32()), ("unit", pa.binary())]))


def _parsed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own_units, quoted, n = [], [], [], []
            for text in batch.column("text").to_pylist():
                own, quotes = parse(text)
                texts.append(own)
                own_units.append(list(kinds_of(own.split("\n"))))
                # Short sentences of longer quotations say nothing.
                quoted.append([{"level": level, "kind": kind, "unit": u} for level, lines in quotes for u, kind in kinds_of(lines).items() if kind != SHORT_PART])
                n.append(len(quotes))
            new = {"text": pa.array(texts, pa.string()), "n_quotes": pa.array(n, pa.int64()), "__own": pa.array(own_units, pa.list_(pa.binary())), "__quoted": pa.array(quoted, _UNITS)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return run


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of linked messages, from (conv_id, turn, up) by pointer doubling."""
    now = materialize(links.select("conv_id", "turn", "up", F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up_up"), F.col("depth").alias("more"))
        met = now.join(above.hint("merge"), ["conv_id", "up"], "left")
        step = met.select("conv_id", "turn", F.coalesce("up_up", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up_up").isNotNull().alias("moved"))
        step = materialize(step, "threads")
        moved = not step.where("moved").isEmpty()
        discard(now)
        now = step.drop("moved")
        now.scratch_path = step.scratch_path
        if not moved:
            return now.select("conv_id", "turn", F.col("up").alias("thread"), "depth")


def link_quotations(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text, ...) without quotations, with links, parents and threads."""
    bounded_batches(messages.sparkSession)
    messages = messages.drop(*ADDED, "__own", "__quoted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    names = [*messages.columns, "n_quotes", "__own", "__quoted"]
    parsed = materialize(messages.mapInArrow(_parsed(names), f"{kinds}, n_quotes long, __own array<binary>, __quoted array<struct<level:int,kind:int,unit:binary>>"), "messages")
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = known.where("size(__quoted) > 0").select("conv_id", "turn", F.explode("__quoted").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), F.col("q.kind").alias("kind"), F.col("q.unit").alias("unit"))
    quoted = quoted.groupBy("conv_id", "turn", "level", "unit").agg(F.min("kind").alias("kind"))
    quoted = materialize(quoted, "quoted")
    asked = materialize(quoted.select("unit").distinct(), "units")  # written, so that a join on a unit that many messages have may be split
    own = known.select("conv_id", "turn", F.explode("__own").alias("unit")).join(asked.hint("merge"), "unit", "left_semi")
    first = own.groupBy("conv_id", "unit").agg(F.min("turn").alias("original"))
    first = materialize(first, "first")
    near = quoted.join(first.hint("merge"), ["conv_id", "unit"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    near = materialize(near, "near")
    # Longer units that no earlier message of the conversation has: the earliest message of the others. Two smallest conversations
    # a unit are enough, one of them is not the quoting one.
    by_conv = first.where(F.octet_length("unit") == LONG_BYTES).select("unit", "conv_id", "original")
    lowest = by_conv.groupBy("unit").agg(F.min(F.struct("conv_id", "original")).alias("one"))
    lowest = materialize(lowest, "lowest")
    second = by_conv.join(lowest.hint("merge"), "unit").where(F.col("conv_id") > F.col("one.conv_id")).groupBy("unit").agg(F.min(F.struct("conv_id", "original")).alias("two"))
    others = materialize(lowest.join(second.hint("merge"), "unit", "left"), "others")
    far = near.where("original IS NULL").join(others.hint("merge"), "unit")
    source = F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))
    far = far.withColumn("source", source).where("source IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("level", "kind", "source.conv_id", "source.original")).alias("s"), F.count(F.lit(1)).alias("n_far"))
    found = near.where("original IS NOT NULL")
    counts = [F.count_if(F.col("kind") == kind).alias(f"n{kind}") for kind in (WHOLE, PART, SHORT)]
    votes = found.where("level = 1").groupBy("conv_id", "turn", "original").agg(*counts)
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(*(f"n{kind}" for kind in (WHOLE, PART, SHORT)), (-F.col("original")).alias("back"))).alias("best"))
    parents = materialize(parents.select("conv_id", "turn", (-F.col("best.back")).alias("up")), "parents")
    linked = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_near"))
    threads = _threads(parents)
    side = linked.join(parents.hint("merge"), ["conv_id", "turn"], "full").join(threads.hint("merge"), ["conv_id", "turn"], "full").join(far.hint("merge"), ["conv_id", "turn"], "full")
    side = materialize(side, "links")
    out = parsed.drop("__own", "__quoted").join(side.hint("merge"), ["conv_id", "turn"], "left")
    return out.select(
        *messages.columns,
        "n_quotes",
        (F.coalesce("n_near", F.lit(0)) + F.coalesce("n_far", F.lit(0))).alias("n_linked"),
        F.col("up").alias("parent_turn"),
        F.col("s.conv_id").alias("source_conv"),
        F.col("s.original").alias("source_turn"),
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n")).alias("formatted"),
    )


def reply_ordered(linked: DataFrame) -> DataFrame:
    """The rows in reply order: sorted ranges of (conv_id, thread, turn), one after the other."""
    return linked.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")


def op5_chat_quotes(spark, sf_dir: str) -> DataFrame:
    return reply_ordered(link_quotations(table(spark, sf_dir, "conversations")))
