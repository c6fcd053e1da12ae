from __future__ import annotations

import html
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm.html_extract import chosen, extract, extract_text, spans

LONG = "This is a sentence of the article, which has a fair number of words. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_marked_article():
    body = "<nav><ul><li><a href=x>Menu</a></ul></nav><!-- c --><div class='ad'>Buy</div><article><h1>Head&amp;line</h1><p><b>a<br><p>b&nbsp;c &lt;d&gt; &copy;</p><aside>s</aside><form>f</form><p>Z</p></article><section id=comments><p>" + LONG * 9 + "</p></section><footer>F</footer>"
    assert extract_text(page(body)) == "Head&line a b c <d> © Z"
    assert extract_text(page("<main><p>x</p></main>")) == "x"
    assert extract_text(page("<article><p>x</p></article><article><p>y</p></article>")) == "x y"


def test_unmarked_page():
    body = "<ul>" + "<li><a href=x>entry</a></li>" * 9 + "</ul><div><h1>A title</h1><p>" + LONG * 2 + "</p><p>Short.</p><p>" + LONG * 2 + "</p><p>The end.</p></div><ul>" + "<li><a>more</a></li>" * 5 + "</ul><div>c 2020</div>"
    assert extract_text(page(body)) == " ".join(["A title", (LONG * 2).strip(), "Short.", (LONG * 2).strip(), "The end."])
    assert extract_text(page("<div class=sidebar><p>" + LONG * 20 + "</p></div><div><p>" + LONG + "</p></div>")) == LONG.strip()
    assert extract_text(page("<div hidden>" + LONG + "</div><p>" + LONG + "</p>")) == LONG.strip()


def test_broken_pages():
    assert extract_text(None) == extract_text("") == extract_text("<p><div>") == ""
    assert extract_text("plain text") == "plain text"
    assert extract_text("<article><p>open &am &amp &#x41;") == "open &am & A"
    assert extract_text("<nav><p>" + LONG) == LONG.strip()  # a menu that never ends is not believed
    assert extract_text("<script>" + LONG) == ""
    assert extract_text("<p>a<!-- " + LONG) == "a"
    assert extract_text("<p title=\"a > b\">x</p>") == "x"
    assert extract_text("<p a='unclosed>x</p>" + "<p>y</p>") in ("x y", "y", "x")


def test_distribution():
    assert spans(np.zeros(4, np.int64), [False] * 4, 1) == []
    assert spans(np.zeros(0, np.int64), [], 1) == []
    assert spans(np.array([0, 0, 90, 5, 80, 0, 0, 0, 4]), [False] * 9, 35) == [(2, 5)]
    assert spans(np.array([90, 0, 0, 0, 0, 70]), [False] * 6, 18) == [(0, 1), (5, 6)]


def chosen_by_hand(lines):
    """The same choice, a line at a time."""
    marked = [m >= 0 for _, _, m in lines]
    weight = [len(t) - k + (80 if m else 0) for (t, k, _), m in zip(lines, marked, strict=True)]

    def ahead(i):
        total = 0
        for j in range(i, min(i + 3, len(lines))):
            if marked[j] != marked[i]:
                break
            total += weight[j]
        return total

    limit = min(80, 0.2 * max(map(ahead, range(len(lines))), default=0))
    if not limit:
        return []
    found, i = [], 0
    while i < len(lines):
        if ahead(i) < limit or not weight[i]:
            i += 1
            continue
        end = i
        while end < len(lines) and marked[end] == marked[i] and ahead(end) >= limit:
            end += 1
        while not weight[end - 1]:
            end -= 1
        while end < len(lines) and marked[end] == marked[i] and weight[end] and lines[end][0][-1] in ".!?":
            end += 1
        if found and marked[found[-1][0]] == marked[i] and all(marked[j] == marked[i] for j in range(found[-1][1], i)):
            between = lines[found[-1][1] : i]
            if 2 * sum(k for _, k, _ in between) <= sum(len(t) for t, _, _ in between):
                found[-1] = (found[-1][0], end)
                i = end
                continue
        found.append((i, end))
        i = end
    total = lambda s: sum(weight[s[0] : s[1]])
    inside, outside = [s for s in found if marked[s[0]]], [s for s in found if not marked[s[0]]]
    outside.sort(key=lambda s: (-total(s), s[0]))
    several = len({m for _, _, m in lines if m >= 0}) > 1
    if inside and not (several and outside and total(outside[0]) > 4 * sum(map(total, inside))):
        return inside
    return outside[:1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 200), st.booleans(), st.booleans(), st.sampled_from([-1, -1, -1, 3, 9])), max_size=30))
def test_chosen_by_hand(made):
    lines = [("x" * (n - 1) + (".y"[full]), n if linked else 0, m) for n, linked, full, m in made]
    assert chosen(lines) == chosen_by_hand(lines)


def test_the_distribution_finds_the_article_without_its_marks():
    rng = random.Random(8)
    for _ in range(60):
        blocks = [LONG * rng.randint(2, 6) + "The end." for _ in range(rng.randint(1, 9))]
        body = "<ul>" + "<li><a href=x>entry</a></li>" * 6 + "</ul><div>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div><ul>" + "<li><a href=x>more</a></li>" * 6 + "</ul><div>c 2020</div>"
        assert extract_text(page(body)) == " ".join(blocks)


def test_text_outside_teasers():
    teasers = "".join(f"<article><a href=x>Teaser {k}</a></article>" for k in range(3))
    assert extract_text(page("<div><p>" + LONG * 40 + "</p></div><hr>" + teasers)) == (LONG * 40).strip()
    # One marked element is believed, however short.
    assert extract_text(page("<div><p>" + LONG * 40 + "</p></div><article>Short</article>")) == "Short"


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a<a", "<!--", "<!", "</", "<title>", "</title ", "<a \">\" ", "<textarea><x ", "<div class=ad>", "<div class='", "&#", "&am", "<p", "<a x='>", "<script>", "<noscript></noscript", "<b>", "<article>", "</article>"])
def test_broken_pages_take_linear_time(unit):
    def took(size):
        text = unit * (size // len(unit))
        began = time.process_time()
        extract_text(text)
        extract_text("<p>x</p>" + text + "<p>y</p>")
        return time.process_time() - began

    took(1 << 12)
    assert took(1 << 20) < 4  # two pages of 1 MB


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/apdivnscrt=\"'&; !-\n"), max_size=120))
def test_any_bytes(text):
    got = extract_text(text)
    assert got == " ".join(got.split())


def test_generated_pages_and_columns(spark):
    rng = random.Random(2)
    rows, wanted = [], {}
    for k in range(40):
        blocks = [" ".join(rng.choice(["ab", "c&d", "é", "<x>", "word"]) for _ in range(rng.choice([1, 3, 40]))) for _ in range(rng.randint(1, 8))]
        body = "<nav><a>m</a></nav><article>" + "".join(f"<p>{html.escape(b)}</p>\n" for b in blocks) + "</article><footer>f</footer>"
        rows.append((k, f"u{k}", page(body), 3))
        wanted[k] = " ".join(blocks)
    rows += [(99, None, None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extract(df).collect()}
    assert {k: r.text for k, r in got.items()} == {**wanted, 99: ""}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract(df.limit(0)).count() == 0
