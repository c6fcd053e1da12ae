from __future__ import annotations

import random
import re


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    found = WORD.findall(text or "")
    return [w.translate(LOWER) for w in found] if lower else found


def shingles(text, size):
    ws = words(text, True)
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def made_docs(seed=1, n=60):
    """(doc_id, text): near and exact copies, shared passages and lines, odd white space, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgÉßñ,.A") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(vocab) for _ in range(k))

    passage, line = prose(70), "A line that very many documents hold, " + prose(5)
    texts: list[str | None] = [None, "", " \t\r\n\x0b\x0c ", "one", "One", "two words", "the " * 130, "ab cd " * 90, prose(4000)]
    base = [prose(rng.randint(20, 200)) for _ in range(8)]
    while len(texts) < n:
        kind = rng.randrange(6)
        t = rng.choice(base)
        ws = t.split()
        if kind == 0:
            texts.append(t)
        elif kind == 1:
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
            texts.append(" ".join(ws))
        elif kind == 2:
            texts.append(prose(30) + "\n" + passage + "\n\n" + prose(10))
        elif kind == 3:
            texts.append(prose(12) + "\n  " + line.upper() + "\t\n" + prose(3) + "\n" + line)
        elif kind == 4:
            texts.append("\n".join(ws[i : i + 9] and " ".join(ws[i : i + 9]) for i in range(0, len(ws), 9)))
        else:
            texts.append(prose(rng.randint(1, 60)).replace(" ", "  ", 3))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def thue_morse(length):
    """A word over two letters and its complement: polynomial hashes modulo a power of two confuse them."""
    bits = [bin(k).count("1") & 1 for k in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
