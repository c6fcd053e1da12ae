"""HTML extraction by line-block distribution.

Markup is stripped to lines of text, one a block; menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments go with their elements, but no layout container that holds the main text. A line's weight is its
text outside links. Sums of weights over ``WINDOW`` lines then form a distribution along the page: it surges where the main text begins and dives where it ends (a short last sentence is added).
The text between a surge and its dive is a stretch; stretches are joined with the lines between them (lists, verse, short
rows) unless these are mostly links, and the heaviest joined text is kept whole, with its short lines.

Elements that mark an article (``article``, ``main``) come in as a prior. Windows do not reach over their edges, and each of
their lines, linked or not, weighs ``SURGE_CHARS`` more, which is enough to surge: so a short article stays whole, and one
element is kept from its first line to its last. All marked stretches are kept, unless the page has several articles (as
lists of teasers have) and a stretch outside weighs more than ``PRIOR`` times all of them: then that is the text.

Edge cases: a null or empty page, or one of markup alone, gives the empty text; unclosed elements end with the page (an
unclosed boilerplate element is not believed, unless it is a script or style); a tag that does not end is text; once a tag's
quotes do not close, quotes in the rest of the page do not hide a ``>``; broken references stay as they are; other
columns pass through, clashing names are replaced.

Scale: a row-wise map with no shuffle; one page is held at a time. Time is linear in the page's length, also for broken pages:
what is once sought in vain up to the page's end is not sought again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import bounded_batches, pieces, table

#: Lines of a window, and the share of the largest window sum (at most so many characters) at which text surges.
WINDOW, SURGE_SHARE, SURGE_CHARS = 3, 0.2, 80
#: How much heavier than all of several marked articles a stretch outside must be to be the text.
PRIOR = 4

# Fixed values of HTML: elements whose text is never prose, boilerplate elements, blocks, and elements without an end.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "canvas", "xmp"}
_BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "input", "head"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_MAIN = {"article", "main"}
#: Words that name boilerplate, as whole tokens of class, id or role; and words of place that may stand beside them in a token.
_NAMES = re.compile(
    r"ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|sidebar|side-bar|rail|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|cookies?|consent|gdpr|notice|alert|warning|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|copyright|legal|disclaimer|complementary|contentinfo|search|pagination|pager|tags?|toolbar",
    re.IGNORECASE,
)
_PLACES = re.compile(r"site|page|main|global|top|bottom|left|right|primary|secondary|upper|lower|list|links?|item|box|bar|block|area|section|container|wrap|wrapper|inner|unit|slot|posts?|article|entry|story|users?|readers?|visitors?|icons?|buttons?|form|widgets|\d+", re.IGNORECASE)
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/<>]*)|!--|[!?/])")
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Elements whose inside is no markup, with what begins their end tags.
_OPAQUE = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noscript")}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_WHITE = re.compile(r"\s+")


def _boilerplate(name: str, attrs: str) -> str:
    """How sure an element is boilerplate: "never" text, by "tag", by "name", by "part" of a name, or "" for not."""
    if name in _RAW:
        return "never"
    if name in _BOILER:
        return "part" if name in ("form", "fieldset") else "tag"
    if not attrs or name in _MAIN or name in ("body", "html"):
        return ""
    if _HIDDEN.search(attrs):
        return "never"
    found = ""
    for token in (t for m in _NAMED.findall(attrs) for t in m.strip("\"'").split()):
        parts = [p for p in re.split("[-_]+", token) if p]
        rest = [p for p in parts if not _NAMES.fullmatch(p)]
        if _NAMES.fullmatch(token) or (parts and not rest):
            return "name"
        if len(rest) < len(parts) and all(_PLACES.fullmatch(p) for p in rest):
            found = "part"
    return found


def _skipped(page: str, tags: list[tuple[int, int, str, bool, str]], ends: dict[int, int]) -> set[int]:
    """The elements (numbers of their start tags) that are left out.

    None that holds ``main``, or the page's only articles with most of its unlinked text; none known by a part of its name
    (or a form) that holds most of the text outside boilerplate; and none known by its name that holds most of a page that has
    no other text.
    """
    kinds = {i: kind for i in ends if (kind := _boilerplate(tags[i][2], tags[i][4]))}
    if not kinds:
        return set()
    text = np.zeros(len(tags), np.int64)
    linked = False
    for i, (_, end, name, closing, _) in enumerate(tags):
        if name == "a":
            linked = not closing
        elif name and (name not in _INLINE or name in _MAIN) and name != "br":
            linked = False
        if not linked:
            text[i] = len(page[end : tags[i + 1][0] if i + 1 < len(tags) else len(page)].strip())

    def covered(some) -> np.ndarray:
        edges = np.zeros(len(tags) + 1, np.int64)
        for i in some:
            edges[i] += 1
            edges[ends[i]] -= 1
        return np.cumsum(edges)[:-1] > 0

    def held(values: np.ndarray, by) -> dict[int, int]:
        """Sums of the values inside each element."""
        sums = np.append(0, np.cumsum(values))
        return {i: int(sums[ends[i]] - sums[i]) for i in by}

    never = {i for i, kind in kinds.items() if kind == "never"}
    skip = set(kinds)
    shown = ~covered(never)
    mains = np.array([t[2] == "main" and not t[3] for t in tags]) & shown
    marks = np.array([t[2] in _MAIN and not t[3] for t in tags]) & shown
    skip -= {i for i, n in held(mains, skip - never).items() if n}
    if marks.any() and not (marks & ~covered(skip)).any():
        left = text * shown
        own, total = held(left, skip - never), left.sum()
        skip -= {i for i, n in held(marks, skip - never).items() if n and 2 * own[i] > total}
    left = text * ~covered(i for i in skip if kinds[i] != "part")
    total = left.sum()
    skip -= {i for i, n in held(left, [i for i in skip if kinds[i] == "part"]).items() if 2 * n > total}
    if not (text * ~covered(skip)).any():
        left = text * ~covered(i for i in skip if kinds[i] in ("never", "tag"))
        total = left.sum()
        skip -= {i for i, n in held(left, [i for i in skip if kinds[i] in ("name", "part")]).items() if 2 * n > total}
    return skip


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes); comments and declarations have no name. Raw elements end at their end tag."""
    at, quotes_close, endless = 0, True, set()
    while found := _TAG.search(page, at):
        start, at = found.span()
        if page.startswith("<!--", start):
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        end = page.find(">", at)
        if end < 0:
            return  # no tag ends any more
        name, closing = (found[2] or "").lower(), bool(found[1])
        attrs = page[at:end] if name else ""
        if quotes_close and ('"' in attrs or "'" in attrs):
            whole = _ATTRS.match(page, at)
            quotes_close = whole is not None
            if whole:
                end = whole.end() - 1
                attrs = page[at:end]
        at = end + 1
        yield start, at, name, closing, attrs
        if name in _OPAQUE and not closing and not attrs.endswith("/"):
            last = None if name in endless else _OPAQUE[name].search(page, at)
            end = page.find(">", last.end()) if last else -1
            if end < 0 and name not in ("script", "style"):
                endless.add(name)
                continue
            start, at = (last.start(), end + 1) if end >= 0 else (len(page), len(page))
            yield start, at, name, True, ""


def _lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters in links, number of the main element or -1) of each block, boilerplate left out."""
    tags = list(_tags(page))
    # The end tag of each boilerplate element, by counting elements of its name.
    ends: dict[int, int] = {}
    open_by: dict[str, list[int]] = {}
    for i, (_, _, name, closing, attrs) in enumerate(tags):
        if not name or name in _VOID or attrs.endswith("/"):
            continue
        stack = open_by.setdefault(name, [])
        if not closing:
            stack.append(i)
        elif stack:
            ends[stack.pop()] = i
    skip = _skipped(page, tags, ends)
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked, in_link, mains, main, at, i = 0, 0, [], -1, 0, 0

    def flush() -> None:
        nonlocal text, linked
        line = _WHITE.sub(" ", unescape("".join(text))).strip()
        if line:
            out.append((line, min(linked, len(line)), main))
        text, linked = [], 0

    def take(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if in_link:
                linked += len(_WHITE.sub(" ", unescape(part)))

    while i < len(tags):
        start, end, name, closing, attrs = tags[i]
        take(page[at:start])
        at = end
        if i in skip:
            flush()
            i = ends[i]
            at = tags[i][1]
        elif name == "a":
            in_link = max(0, in_link + (-1 if closing else 1)) if closing else 1
        elif name in _MAIN:
            flush()
            if closing:
                if mains:
                    mains.pop()
            else:
                mains.append(i)
            main = mains[0] if mains else -1
            in_link = 0
        elif name and name not in _INLINE:
            flush()
            in_link = in_link if name == "br" else 0
        i += 1
    take(page[at:])
    flush()
    return out


def window_sums(weights: np.ndarray) -> np.ndarray:
    """For each line, the weights of the window of ``WINDOW`` lines (fewer at the end) that begins at it."""
    sums = np.append(0, np.cumsum(weights))
    at = np.arange(len(weights))
    return sums[np.minimum(at + WINDOW, len(weights))] - sums[at]


def spans(weights: np.ndarray, closes: list[bool], limit: float) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of the distribution of window sums; a dive is one past the last line kept."""
    sums = window_sums(weights)
    n, out, i = len(weights), [], 0
    while i < n:
        if sums[i] < limit or not weights[i]:
            i += 1
            continue
        end = i
        while end < n and sums[end] >= limit:
            end += 1
        while not weights[end - 1]:
            end -= 1
        # A short last sentence still belongs to the text.
        while end < n and weights[end] and closes[end]:
            end += 1
        out.append((i, end))
        i = end
    return out


def _joined(found: list[tuple[int, int]], lines: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Stretches put together unless more than half of the text between them is links."""
    out = found[:1]
    for a, b in found[1:]:
        between = lines[out[-1][1] : a]
        if 2 * sum(k for _, k, _ in between) <= sum(len(t) for t, _, _ in between):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def chosen(lines: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The stretches of lines that are the main text: of (text, characters in links, number of the main element or -1)."""
    if not lines:
        return []
    marked = np.array([m >= 0 for _, _, m in lines])
    weights = np.array([len(t) - k for t, k, _ in lines], np.int64) + SURGE_CHARS * marked
    closes = [t.rstrip("\"')\u201d\u2019\u00bb").endswith((".", "!", "?", "\u2026", "\u3002")) for t, _, _ in lines]
    edges = [0, *(np.flatnonzero(marked[1:] != marked[:-1]) + 1).tolist(), len(lines)]
    parts = list(pairwise(edges))
    limit = min(SURGE_CHARS, SURGE_SHARE * max(window_sums(weights[a:b]).max() for a, b in parts))
    if not limit:
        return []
    inside, outside = [], []
    for a, b in parts:
        found = _joined([(a + x, a + y) for x, y in spans(weights[a:b], closes[a:b], limit)], lines)
        (inside if marked[a] else outside).extend(found)
    weight = lambda s: int(weights[s[0] : s[1]].sum())
    best = max(outside, key=lambda s: (weight(s), -s[0]), default=None)
    several = len({m for _, _, m in lines if m >= 0}) > 1
    if inside and not (several and best and weight(best) > PRIOR * sum(map(weight, inside))):
        return inside
    return [best] if best else []


def extract_text(page: str | None) -> str:
    """The main text of a page."""
    lines = _lines(page or "")
    return " ".join(t for a, b in chosen(lines) for t, _, _ in lines[a:b])


def _rows(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [extract_text(p) for p in batch.column("html").to_pylist()]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html`` and with ``text`` and ``n_chars``."""
    bounded_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    kept = [c for c in pages.columns if c != "html"]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"), "text string", "n_chars long"])
    return pages.mapInArrow(_rows(kept), kinds)


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
