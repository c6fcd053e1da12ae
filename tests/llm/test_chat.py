from __future__ import annotations

import random

from readloom.llm.chat_quotes import link_quotations, parse, reply_ordered, units

KINDS = "conv_id long, turn long, role string, text string, depth string"


def test_parse():
    own, quotes = parse("Hi.\n\nOn Monday, X wrote:\n> > deep\n> shallow one\n>\n> two\n\nMy answer.\n>last")
    assert own == "Hi.\n\nMy answer."
    assert quotes == [(2, ["deep"]), (1, ["shallow one", "", "two"]), (1, ["last"])]
    assert parse("a > b\nno quotes  ") == ("a > b\nno quotes  ", [])
    assert parse(None) == ("", [])
    assert parse(">>> x") == ("", [(3, ["x"])])


def test_units():
    whole = units(["Some long  line", "wrapped here", "", "other paragraph"])
    assert set(units(["some LONG line wrapped", "here"])) & set(whole)
    assert len(whole) == 4
    assert units(["", " ", "short"]) == []


SAYS = ("wrote", "writes", "said")


def plain_parse(text):
    """Own lines and quoted passages, a character at a time."""
    own, quotes, before = [], [], 0
    for line in (text or "").split("\n"):
        at, level = len(line) - len(line.lstrip(" \t")), 0
        while at < len(line) and line[at] == ">":
            level, at = level + 1, at + 1
            if at < len(line) and line[at] in " \t":
                at += 1
        if not level:
            own.append(line)
        else:
            if not before:
                k = len(own)
                while k and not own[k - 1].strip():
                    k -= 1
                said = own[k - 1].rstrip().lower() if k else ""
                if said.endswith(":") and said[:-1].rstrip().split(" ")[-1] in SAYS:
                    own = own[: k - 1]
            if level != before:
                quotes.append((level, []))
            quotes[-1][1].append(line[at:])
        before = level
    return own, quotes


def plain_units(lines):
    """{text of a unit: what it is}: 0 for a paragraph or line, 1 for a sentence in one, 2 more for short ones."""
    wholes, paragraph = [], []
    for line in [*lines, ""]:
        ws = line.split()
        if not ws and paragraph:
            wholes.append(" ".join(paragraph))
            paragraph = []
        paragraph += ws
        if ws:
            wholes.append(" ".join(ws))
    out = {}
    add = lambda text, kind: out.setdefault(text.lower(), kind + 2 * (len(text.lower().encode()) < 8))
    for whole in wholes:
        add(whole, 0)
    for whole in wholes:
        begin, i = 0, 0
        while i < len(whole):
            if whole[i] in ".!?":
                while i < len(whole) and whole[i] in ".!?":
                    i += 1
                while i < len(whole) and whole[i] in "\"')":
                    i += 1
                if i == len(whole) or whole[i] == " ":
                    if (sentence := whole[begin:i].strip()) not in wholes:
                        add(sentence, 1)
                    begin = i
            else:
                i += 1
        if (rest := whole[begin:].strip()) and rest not in wholes:
            add(rest, 1)
    return out


def brute(rows):
    """Links, parents and threads by looking every quoted unit up in every message; nothing of the module is used."""
    parsed = [(r[0], r[1], *plain_parse(r[3])) for r in rows]
    held = [(c, t, set(plain_units(own))) for c, t, own, _ in parsed]
    out = {}
    for c, t, _, quotes in parsed:
        asked = {}
        for level, lines in quotes:
            for u, kind in plain_units(lines).items():
                if kind != 3:
                    asked[level, u] = min(kind, asked.get((level, u), 9))
        votes, n, source = {}, 0, []
        for (level, u), kind in asked.items():
            here = [t2 for c2, t2, us in held if c2 == c and u in us]
            if here and min(here) < t:
                n += 1
                if level == 1:
                    votes.setdefault(min(here), [0, 0, 0])[kind] += 1
            elif kind < 2:
                far = min(((c2, t2) for c2, t2, us in held if c2 != c and u in us), default=None)
                if far:
                    n += 1
                    source.append((level, kind, *far))
        parent = min(votes, key=lambda k: ([-x for x in votes[k]], k)) if votes else None
        out[c, t] = (n, parent, min(source)[2:] if source else (None, None))
    threads = {}
    for c, t in sorted(out):
        parent = out[c, t][1]
        thread, depth = (t, 0) if parent is None else threads[c, parent]
        threads[c, t] = (thread, depth + (parent is not None))
    return {k: (*out[k], *threads[k]) for k in out}


def test_made_conversations(spark):
    rng = random.Random(21)
    says = ["I like it a lot.", "Do you?", "Yes.", "No!", "Thank you very much.", "That is (so they say) fine.", "A longer sentence that says more than the others", "one two three", "OK", "Well... perhaps."]
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 7)):
            lines = [" ".join(rng.choice(says) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.7 and rows:
                other = rng.choice(rows[-6:])[3].split("\n")
                k = rng.randrange(len(other))
                taken = other[k : k + rng.randint(1, 3)]
                if rng.random() < 0.3:
                    taken = taken[0].split(". ")[:1]
                quote = [rng.choice(["> ", ">", " > "]) + (x.upper() if rng.random() < 0.2 else x) for x in taken]
                lines = [*(["Someone wrote:"] if rng.random() < 0.3 else []), *quote, *([""] if rng.random() < 0.5 else []), *lines]
            if rng.random() < 0.2:
                lines.insert(rng.randrange(len(lines) + 1), "")
            rows.append((c, t, "user", "\n".join(lines), None))
    got = {(r.conv_id, r.turn): (r.n_linked, r.parent_turn, (r.source_conv, r.source_turn), r.thread, r.depth) for r in link_quotations(spark.createDataFrame(rows, KINDS).repartition(4)).collect()}
    wanted = brute(rows)
    assert {k: (v, wanted[k]) for k, v in got.items() if v != wanted[k]} == {}
    assert sum(w[1] is not None for w in wanted.values()) > 15
    assert sum(w[2][0] is not None for w in wanted.values()) > 5
    assert max(w[4] for w in wanted.values()) > 1


def test_links(spark):
    first, second, third = "The very first message here.\nIt has two lines.", "An answer to that, quite long.", "Third thing said now."
    rows = [
        (1, 0, "user", first, "x"),
        (1, 1, "assistant", f"A wrote:\n> {first.splitlines()[0]}\n\n{second}", "x"),
        (1, 2, "user", f"> {second}\n>> The very first message here. It has\n>> two lines.\n{third}", "x"),
        (1, 3, "user", "> the VERY first message  here.\nBack to the start.", "x"),
        (1, 4, "user", f"> {third}\n> {second}\n> An unknown line of text\nMixed.", "x"),
        (2, 0, "user", f"> {first.splitlines()[0]}\nFrom elsewhere, an answer.", "x"),
        (2, 1, "user", "> From elsewhere, an answer.\nYes, indeed it is.", "x"),
        (3, 0, "user", first, "x"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, KINDS).repartition(3)).collect()}
    wanted = brute(rows)
    assert {k: (r.n_linked, r.parent_turn, (r.source_conv, r.source_turn), r.thread, r.depth) for k, r in got.items()} == wanted
    assert got[1, 2].text == third
    assert got[1, 1].text == second
    assert [(got[1, t].thread, got[1, t].depth) for t in range(5)] == [(0, 0), (0, 1), (0, 2), (0, 1), (0, 2)]
    assert got[2, 0].source_conv == 1
    assert got[1, 3].formatted == "<|user|>\nBack to the start.<|end|>\n"


def test_long_thread(spark):
    rows = [(7, t, "user", (f"> message number {t - 1} of many\n" if t else "") + f"message number {t} of many", None) for t in range(70)]
    out = link_quotations(spark.createDataFrame(rows, KINDS))
    got = sorted((r.turn, r.thread, r.depth, r.parent_turn) for r in out.collect())
    assert got == [(t, 0, t, t - 1 if t else None) for t in range(70)]
    assert [r.turn for r in reply_ordered(out).collect()] == list(range(70))


def test_edges(spark):
    rows = [(1, 0, None, None, "d"), (1, 0, "user", "> x", "d"), (None, 1, "user", "> some quoted text\nown", None), (2, None, "user", "some quoted text", None), (3, 3, "user", "", None)]
    df = spark.createDataFrame(rows, KINDS)
    got = link_quotations(df).collect()
    assert len(got) == 5
    assert all(not r.n_linked and r.thread == r.turn for r in got)
    assert next(r for r in got if r.role is None).formatted == "<|user|>\n<|end|>\n"
    assert link_quotations(df.limit(0)).count() == 0
