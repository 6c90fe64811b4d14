"""Main text of pages: hand-made pages of many layouts, edge rows, whole given tables."""

from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from touchline.llm.op12_html_extraction import extract, main_text, op12_html_extraction

DATA = "/root/testdata/sf0.001"
P = "The river was low in the summer of that year, and the people of the town walked to the other bank to look for the bell that was lost in the flood."
Q = "It is said that the bell was from the old church, but there is no book in which it is named, and the priest who had seen it was not there for long."
PAGES = {
    "an article among other parts": (f"<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article><header><h1>The bell</h1></header><p>{P}</p><p>Short one.</p><p>{Q}</p></article><aside>About us</aside><footer>(c) us</footer></body></html>", f"The bell\n{P}\nShort one.\n{Q}"),
    "no article, unclosed tags": (f"<body><div id='menu'><a href=1>One</a> <a href=2>Two</a></div><div><h1>The bell</h1><p>{P}<p>Yes.<p>{Q}</div><div class=sidebar><p>{Q}</p></div><div id=footer>{P}</div>", f"The bell\n{P}\nYes.\n{Q}"),
    "readers' comments": (f"<article><h2>T</h2><p>{P}</p><section id=comments><h3>3 comments</h3><p>{Q}</p></section></article>", f"T\n{P}"),
    "an article in an article": (f"<article><h2>T</h2><p>{P}</p><article><p>{Q}</p></article></article>", f"T\n{P}"),
    "main, notice, list, form": (f"<main><div class=cookie-notice>{Q}</div><h1>T</h1><p>{P}</p><ul><li>one thing</li><li>another</li></ul><p>{Q}</p><form><p>{P}</p><input></form></main><p>{P}</p>", f"T\n{P}\none thing\nanother\n{Q}"),
    "hidden parts and scripts": (f"<article><p>{P}</p><div style='display:none'>{Q}</div><div hidden>{Q}</div><script>if (a<b) document.write('<p>x</p>')</script></article>", P),
    "an advert that never ends": (f"<article><p>{P}<div class='ad'>{Q}", P),
    "plain text": ("just words", "just words"),
    "null": (None, ""),
    "empty": ("", ""),
    "character references": ("<article><p>a &lt;b&gt; &#233;&amp;amp;&nbsp;  c <b>d</b>e <!-- x > y --> f</p></article>", "a <b> é&amp; c de f"),
    "quotes in attributes": (f"<article data-x='a>b' title=\"<p>\"><p it's>{P}</p></article>", P),
    "link lists": (f"<article><p>{P} <a href=x>{P[:60]}</a></p><ul><li><a href=1>Related story one</a></li><li><a href=2>Two</a></li></ul></article>", f"{P} {P[:60]}"),
    "text after the article": (f"<article><p>{P}</p></article><div><h3>More</h3><p>{Q}</p></div>", P),
    "a form around all": (f"<form><div><article><p>{P}</p></article></div></form>", P),
    "menus only": ("<nav><a href=/>Home</a></nav><footer>x</footer>", ""),
    "a header by class": (f"<div class='page-header'><p>{Q}</p></div><div class='post'><h2>T</h2><p>{P}</p></div><div class='notice'>{Q}</div>", f"T\n{P}"),
    "a title above the article": (f"<div class='post'><div class='entry-header'><h1>T</h1></div><div class='entry-content'><p>{P}</p></div></div>", f"T\n{P}"),
    "tables": (f"<article><p>{P}</p><table><tr><td>1</td><td>2</td></tr></table><p>{Q}</p></article>", f"{P}\n1\n2\n{Q}"),
    "sharing, quotes, figures": (f"<article><div class='share'><a>tweet</a></div><p>{P}</p><blockquote>{Q}</blockquote><figure><img><figcaption>A bell.</figcaption></figure></article>", f"{P}\n{Q}\nA bell."),
    "line breaks": (f"<article><p>{P}<br>{Q}<br><br>End.</p></article>", f"{P} {Q}\nEnd."),
    "no stop words, in an article": ("<article><p>" + "xyzzy plugh " * 20 + "</p></article>", ("xyzzy plugh " * 20).strip()),
    "no stop words, beside text": (f"<div><p>{P}</p><p>{Q}</p></div><div><p>" + "xyzzy plugh " * 20 + "</p></div>", f"{P}\n{Q}"),
    "short blocks inherit": (f"<div><p>Ad one</p><p><a href=x>{P}</a></p><p>Near links</p><p><a href=x>{P}</a></p></div><div><p>{P}</p><p>Within text</p><p>{Q}</p></div>", f"{P}\nWithin text\n{Q}"),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_layouts(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_broken_pages_take_linear_time():
    began = time.process_time()
    for page in ("<div>" * 100_000 + "x" + "</section>" * 100_000, "<a href='" * 100_000, "<p>" + "a " * 1_000_000, '<p ="' * 100_000, "<" * 500_000, "<!--" * 100_000, "&" * 200_000, "<p>x<br>" * 50_000, "<script>" * 50_000):
        main_text(page)
    assert time.process_time() - began < 30


def test_edge_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (3, "u", PAGES["tables"][0]), (3, "u", PAGES["tables"][0]), (4, "v", "<p>" + "the word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = extract(df.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("x")))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, u, main_text(h), len(main_text(h))) for i, u, h in rows), key=str)
    assert extract(df.limit(0)).collect() == []


def test_whole_articles_of_the_given_pages(spark):
    def article(page):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", body))))

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in op12_html_extraction(spark, DATA).collect()}
    assert got == {k: (article(v), len(article(v))) for k, v in pages.items()}
