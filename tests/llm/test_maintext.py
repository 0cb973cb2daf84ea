"""Main text: the given pages against a document parser, odd markup, and pages the tree has not seen."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pytest

from foliomill.llm import maintext
from foliomill.llm.maintext_pages import PAGES


@pytest.fixture(scope="module")
def tree():
    return maintext.default_tree()


class Article(HTMLParser):
    """What stands in the article element, by its paragraphs and headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.now = False, [], ""

    def end_block(self):
        if words := self.now.split():
            self.out.append(" ".join(words))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.end_block()
        self.now += " " * (tag == "br")
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end_block()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.now += data * self.inside


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r for r in maintext.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        parser = Article()
        parser.feed(r.html)
        parser.close()
        parser.end_block()
        want = "\n\n".join(parser.out)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_labelled_pages_left_out_of_the_table():
    """Each labelled page is judged by a tree grown on the others."""
    right = total = 0
    for place in range(len(PAGES)):
        own = maintext.grow(*maintext.labelled(PAGES[:place] + PAGES[place + 1 :]))
        x, y = maintext.labelled([PAGES[place]])
        right, total = right + int((own.predict(x) == y).sum()), total + len(y)
    assert total > 130 and right / total >= 0.9
    x, y = maintext.labelled(PAGES)
    assert (maintext.default_tree().predict(x) == y).mean() >= 0.97


def test_unseen_surroundings(tree):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home no-sidebar">
    <div id="cookieBanner"><p>We use cookies, and by reading on in these pages you agree to all of our terms and rules.</p></div><header><h1>Site</h1></header>
    <form action="/s"><input name=q value="a > b"><button>Search</button></form>
    <section class="alert alert-info">The office is closed on all public holidays and on the day after each of them.</section>
    <article class="post has-comments"><h1>Title &amp; more</h1><p>One<br>two <b>bo</b>ld &lt;tag&gt; caf&eacute;&nbsp;&#8212; 3 &#x3c; 4</p><aside>Side note in the article that nobody needs, really.</aside>
    <ul><li>item<li><a href="/x">linked item</a></ul><script>document.write("<p>no</p>")</script><!-- <p>no</p> --><div class="ad-slot"><div>Buy</div> now</div><p>End.</article>
    <div class="comment-list"><article class="comment"><p>A reader's long remark on the text above, which says that all of it is true and well put.</p></article></div>
    <footer>&copy; Site</footer></body></html>"""
    assert maintext.main_text(page, tree) == "Title & more\n\nOne two bold <tag> café — 3 < 4\n\nitem\n\nlinked item\n\nEnd."


def test_odd_markup(tree):
    text = lambda page: maintext.main_text(page, tree)
    assert text(None) == text("") == text("  \n ") == text("<p></p><script>x") == text("<article><!-- x") == ""
    assert text("<ARTICLE><P CLASS='x'>a&ampb</P>c < d <3 & e</ARTICLE>") == "a&b\n\nc < d <3 & e"
    assert text("<article><p>kept</p><p class='cut") == "kept"
    assert text("<article><p title=\"a>b\">kept</p></div></nav>more") == "kept\n\nmore"
    assert text("<article><p title=\"a>kept</p>") == "kept"
    assert text("<article><p class=ad>gone<p>kept</article>") == "kept"
    assert text("<form><article>in a form</article></form>") == "in a form"
    assert text("<aside><div><div>x</div> y</div> z</aside><article>kept</article>") == "kept"
    assert text("<article><script>if (a</script b) {</scripty></script >kept</article>").endswith("kept")
    long = "<article>" + "<p>word " * 200_000 + "<i" * 50_000 + "<div class=ad>" * 50_000 + "</span>" * 50_000
    assert text(long).count("word") == 200_000


def test_grow_and_predict_agree():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, size=(400, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] <= 1)).astype(float)
    assert (maintext.grow(x, y).predict(x) == y).all()
    assert maintext.grow(x, np.ones(400)).predict(x).all()


def test_odd_tables(spark):
    schema = "page_id string, url string, html string, text string, n_chars int"
    rows = [("a", None, None, "t", 1), (None, "u", "<article>x\n y</article>", "t", 1), ("a", "u", "<article>x y</article>", None, None)]
    got = sorted(maintext.extract(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted((r.page_id or "", r.text, r.n_chars) for r in got) == [("", "x y", 3), ("a", "", 0), ("a", "x y", 3)]
    assert maintext.extract(spark.createDataFrame([], schema)).collect() == []
