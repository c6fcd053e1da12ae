from __future__ import annotations

from readloom.llm.html_extract import extract_text

FIRST, SECOND = ("A sentence of the first part. " * 7).strip(), ("Words of the second part. " * 6).strip()


def test_list_inside_an_unmarked_article():
    items = ["flour", "two eggs", "some salt", "milk", "a pan"]
    body = f"<p>{FIRST}</p><ul>" + "".join(f"<li>{i}</li>" for i in items) + f"</ul><p>{SECOND}</p>"
    assert extract_text(body) == " ".join([FIRST, *items, SECOND])
    menu = "".join(f"<li><a href=x>{i}</a></li>" for i in items)
    assert extract_text(f"<p>{FIRST}</p><ul>{menu}</ul><p>{SECOND}</p>") == FIRST


def test_layout_containers_are_no_boilerplate():
    for name in ("content has-sidebar", "layout-no-sidebar", "post comments-open", "site-content with-header", "page-header", "sidebar-right", "- _"):
        assert extract_text(f"<div class='{name}'><article><p>{FIRST}</p></article></div>") == FIRST, name
        assert extract_text(f"<div class='{name}'><p>{FIRST}</p></div><footer>{SECOND}</footer>") == FIRST, name
    assert extract_text(f"<div class=sidebar><main><p>{FIRST}</p></main></div>") == FIRST
    assert extract_text(f"<form id=f><p>{FIRST}</p><label>Search</label></form>") == FIRST


def test_boilerplate_still_goes():
    for name in ("sidebar", "cookie-notice", "site-footer", "main-nav", "left_sidebar", "related-posts", "ad"):
        assert extract_text(f"<div class='{name}'><p>{SECOND}</p></div><div><p>{FIRST}</p><p>{FIRST}</p></div>") == f"{FIRST} {FIRST}", name
    assert extract_text(f"<ol class=comment-list><li><article><p>{SECOND}</p></article></ol><article>{FIRST}</article>") == FIRST


def test_links_inside_a_marked_article():
    assert extract_text("<article><h1><a href=x>Title</a></h1><p>Some text.</p><p><a href=y>A reference</a></p></article><ul><li><a>more</a></ul>") == "Title Some text. A reference"
    assert extract_text("<nav><a>m</a></nav><main><ul><li><a>One</a><li><a>Two</a></ul></main>") == "One Two"
    assert extract_text("<article><p>x</p></article><p>between</p><article><p><a>y</a></p></article>") == "x y"
