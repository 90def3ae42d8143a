"""What a page costs to parse: searches that do not grow with the ways an ancestor can be chosen, and nothing done unasked."""

import time
from dataclasses import replace

import pyarrow as pa

from vitrina.operators import extract, html


def test_a_chain_of_ancestors_takes_one_walk():
    # 150 open divs allow 20 million choices of four; no choice has the p outside.
    page = html.Document("<p>x</p><ul><li>" + "<div>" * 150 + "<span>y</span>")
    started = time.perf_counter()
    block = page.first(0, "li")
    assert page.select(block, "p div div div div span") == [] == page.select(block, "ul div span")
    assert page.select(0, "li > div div div div div span") == page.select(block, "div div div div div span") == page.select(0, "span") != []
    assert time.perf_counter() - started < 2


def test_a_chain_stays_in_its_block():
    page = html.Document("<div><div><ul><li><b>1</b></li><li><div><i>2</i><b>3</b></div></li></ul></div></div>")
    first, second = page.select(0, "li")
    assert page.select(first, "div b") == [] and page.select(second, "div b") == [page.select(0, "b")[1]]
    assert page.select(0, "div b") == page.select(0, "b") and page.select(second, "div > i + b, ul b") == page.select(second, "b")
    assert page.select(0, "div div div > b") == page.select(second, "b")


def test_only_attributes_that_a_selector_asks_for_are_parsed(monkeypatch):
    asked = []
    parse = html._attributes
    monkeypatch.setattr(html, "_attributes", lambda text: asked.append(text) or parse(text))
    page = html.Document('<a href="/1">x</a><b CLASS="k">y</b><i id=z>t</i>' * 50)
    assert len(page.select(0, ".k")) == 50 and set(asked) == {' CLASS="k"'}
    assert len(page.select(0, "a[href]")) == 50 and set(asked) == {' CLASS="k"', ' href="/1"'}


def test_blocks_without_their_text():
    card = '<li class="ui-search-layout__item"><h2><a href="/p">Mesa</a></h2>$ ' + "relleno " * 20
    pages = pa.array([card * 2, None, "<body>poco</body>"])
    spec = replace(extract.LISTING_CARD, page_text=True)
    with_text, page_texts = extract._parse_pages(pages, spec)
    without, same_texts = extract._parse_pages(pages, replace(spec, content=False))
    assert [len(blocks) for blocks in with_text.to_pylist()] == [2, 0, 0] and page_texts.to_pylist() == same_texts.to_pylist() == [None, "", "poco"]
    assert without.to_pylist() == [[block | {"content": None} for block in blocks] for blocks in with_text.to_pylist()]
    assert {block["content"] for block in without.to_pylist()[0]} == {None} and "Mesa" in with_text.to_pylist()[0][1]["content"]
