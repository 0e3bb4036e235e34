import collections
import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from inkloom.llm import html_layout

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Events(HTMLParser):
    """Visible words by the standard library's events: text outside of hidden elements."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0
        self.stack = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in html_layout.VOID:
            if tag not in ("img", "wbr"):
                self.words.append(None)
            return
        gone = tag in html_layout.HIDDEN or "hidden" in attrs or re.search(r"display:\s*none|visibility:\s*hidden", attrs.get("style") or "") is not None
        self.stack.append((tag, gone))
        if tag in html_layout.BLOCK | html_layout.CELLS | {"option", "caption"}:
            self.words.append(None)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if tag in html_layout.BLOCK | html_layout.CELLS | {"option", "caption"}:
            self.words.append(None)

    def handle_data(self, data):
        if not any(gone for _, gone in self.stack):
            self.words.append(data)

    def result(self):
        return "".join("\n" if x is None else x for x in self.words).split()


def words(text):
    """Without what the layout adds: bullets, numbers, rules."""
    return [w for w in text.split() if w not in ("*", "---") and not re.fullmatch(r"\d+\.", w)]


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no pages here")
def test_all_visible_words_of_all_pages(spark):
    pages = [r.html for r in spark.read.parquet(PAGES).collect()]
    assert len(pages) >= 200
    for page in pages:
        if not page:
            continue
        events = Events()
        events.feed(page)
        events.close()
        have, want = words(html_layout.extract_text(page)), [w for w in events.result() if w not in ("*", "---") and not re.fullmatch(r"\d+\.", w)]
        assert collections.Counter(have) == collections.Counter(want), page[:300]
        if "<t" not in page.replace("<title", ""):
            assert have == want


def test_broken_pages_take_time_in_proportion():
    pages = ["<div>" * 50_000 + "x", "<blockquote>y" * 20_000, "<ul><li>y" * 20_000, "<p><button>" + "<div>a" * 50_000, "<a " + '"' * 100_001, "<a " * 100_000 + '="  > "']
    pages += ["<a b=\"1\"" + " c='d'" * 20_000, "<table><tr><td>x" * 3_000, "<table>" + "<td colspan=1000 rowspan=9>x" * 5_000, "<" * 100_000, "<![CDATA[" * 50_000, "<script>" * 100_000]
    pages += ["<table>" + "<tr><td>a<td>b" * 5_000 + "<tr><td>" + "x" * 100_000 + "<td>y</table>", "<i>" * 50_000 + "</b>" * 50_000 + "z"]
    for page in pages:
        began = time.process_time()
        html_layout.extract_text(page)
        assert time.process_time() - began < 5, page[:40]


def test_random_markup_keeps_text_and_ends():
    r = random.Random(3)
    parts = ["<div>", "</div>", "<p>", "</p>", "<table>", "<tr>", "<td rowspan=2>", "<td colspan=3>", "</table>", "<ul>", "<ol>", "<li>", "</ul>", "<b x='", "\">", "<!--", "-->", "<pre>", "</pre>", "<a href=\"q\">", "'", '"', "=", "<", ">", "<select>", "<option>", "İ", "&amp;", "&#x41", "<h1>", "</h2>", "<dd>", "<br>", "<blockquote>", "<caption>", "\n"]
    for _ in range(1500):
        page = "".join(r.choice(parts) + (f"w{r.randrange(99)} " if r.random() < 0.5 else "") for _ in range(r.randrange(40)))
        assert isinstance(html_layout.extract_text(page), str)
    plain = [x for x in parts if x.startswith(("<div", "</d", "<p>", "</p", "<table", "<tr", "<td", "</t", "<ul", "<ol", "<li", "</u", "<pre", "</pre", "<h1", "</h2", "<dd", "<br", "<bl", "<caption"))]
    for _ in range(1500):
        named = [f"w{i}" for i in range(r.randrange(30))]
        page = "".join(r.choice(plain) + " " + w + " " for w in named)
        assert sorted(words(html_layout.extract_text(page))) == sorted(named), page


def test_rules():
    x = html_layout.extract_text
    assert x("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>") == "A  b\n   c"
    assert x('<div style="visibility:hidden">no<b style="visibility: visible">yes</b>no</div>') == "yes"
    assert x("İ" * 12 + "<SCRIPT>x</Script >after text here") == "İ" * 12 + "after text here"
    assert x("<ul><li><p>a<p>b<ul><li>c</ul></ul>d") == "* a\n\n  b\n\n  * c\n\nd"
    assert x("<blockquote><p>q<p>r</blockquote>z") == "  q\n\n  r\n\nz"
    assert x("1 < 2 and <3 </ >x") == "1 < 2 and <3 x"
