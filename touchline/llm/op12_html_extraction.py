"""Main text of web pages by two passes of block rules.

A page is cut into blocks (texts between block-level tags) with three measures: length,
share of characters in links, share of stop words. The first pass decides blocks by
them: link lists are bad; long blocks rich in stop words are good; long ones poor in
them are bad outside an article and undecided inside one; short ones stay undecided.
The second pass gives each undecided block the label of its nearest decided neighbours in
page order; where the two sides disagree, or there is none, blocks of an article are
good and others bad. A heading looks at what follows it.

Markup settles some blocks before the passes: parts that are not text (scripts, styles,
forms, controls, hidden parts) and marked boilerplate (menus, asides, footers, headers
outside an article, adverts, notices, comments) are neither kept nor neighbours. Where a
page has an article with text, blocks outside it are bad, but for a title above an article
without one.

Defined results: null or empty html gives an empty text; broken, cut and unclosed markup is
read as far as it goes; a page without any good block keeps its undecided ones without
links (plain text, for instance); repeated rows give repeated results; an empty table an
empty one; other columns do not matter. Work is linear in the length of a page, and no row
meets another, so there is no shuffle.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table

#: Blocks of fewer characters are undecided.
SHORT = 70
#: Blocks with a larger share of their characters in links are bad.
LINKED = 0.5
#: Long blocks with at least this share of stop words are good.
STOPS = 0.2

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i if in is it its not of on or our she that the their there they this to was we were what when which who will with would you
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war wenn werden wie wird zu zum zur
    au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sont sur un une vous
    al como con del el ella ellos era este esta ha hay las lo los más muy no nos o para pero por se sin su sus también una uno y ya""".split()
)
# Elements of HTML by their part in a page.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend
    li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul noscript template svg button object canvas audio video map""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav aside footer menu form fieldset select option button template noscript svg object canvas audio video map dialog search".split())
# Words in class, id or role that mark boilerplate, and values that mark an article.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup
    login popup modal overlay share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager menu nav navbar navigation sidebar footer masthead comment comments
    commentlist disqus respond reply replies disclaimer copyright toolbar complementary contentinfo""".split()
)
ARTICLES = frozenset("article articlebody article-body article-content entry-content post-content post-body story-body main-content main content".split())

TITLES = frozenset("entry post article story".split())

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[^a-zA-Z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A text of the page; linked: its characters in links; part: its article (0: none); marked: boilerplate by markup."""

    text: str
    linked: int
    tag: str
    part: int
    marked: bool
    label: str = ""


@dataclass
class _Open:
    """An open element and what holds for the blocks in it. form: marked only because a form is around it."""

    tag: str
    part: int
    marked: bool
    form: bool


@dataclass
class _Reader:
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, False, False)])
    open: Counter = field(default_factory=Counter)
    blocks: list[Block] = field(default_factory=list)
    #: Of each article (from 1 on): the one around it, or 0; whether it is main, which may hold more than an article.
    outer: list[int] = field(default_factory=lambda: [0])
    wide: list[bool] = field(default_factory=lambda: [False])
    tag: str = ""
    data: list[tuple[str, bool]] = field(default_factory=list)
    #: Height of the stack where a link was opened; 0: no link.
    link: int = 0
    breaks: int = 0

    def flush(self) -> None:
        self.breaks = 0
        if not self.data:
            return
        text = " ".join("".join(x for x, _ in self.data).split())
        if text:
            top = self.stack[-1]
            linked = sum(len("".join(x.split())) for x, inside in self.data if inside)
            self.blocks.append(Block(text, linked, self.tag, top.part, top.marked))
        self.data = []

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = len(self.stack)
        elif tag == "br":
            self.breaks += 1
            self.data.append((" ", False))
            if self.breaks > 1:
                self.flush()
        if tag not in BLOCK:
            return
        self.flush()
        self.tag = tag
        if tag in VOID:
            return
        top = self.stack[-1]
        part, marked, form = top.part, top.marked, top.form
        hints, values = set(), set()
        if attributes.strip() and tag not in ("html", "body"):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    hints.add("hidden")
                elif name in ("class", "id", "role", "itemprop"):
                    values |= set(value.lower().split())
                    hints |= {w.lower() for w in _HUMP.split(value) if w}
        article = tag in ("article", "main") or bool(values & ARTICLES)
        bad = bool(hints & MARKS) or "hidden" in hints or tag in DROPPED or ((tag == "header" or ("header" in hints and tag != "main" and not hints & TITLES)) and not part)
        if article and not bad:
            if form:
                marked = form = False
            if tag == "article" or not part:
                # Text around an article in main, or in a wrapper without text, is no article around it.
                self.outer.append(part if part and not self.wide[part] else 0)
                self.wide.append(tag == "main")
                part = len(self.outer) - 1
        elif bad and not marked:
            marked, form = True, tag == "form"
        self.stack.append(_Open(tag, part, marked, form))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag not in BLOCK:
            return
        self.flush()
        self.tag = ""
        if tag != "p" and not self.open[tag]:
            return
        while self.open[tag]:
            top = self.stack.pop()
            self.open[top.tag] -= 1
            if top.tag == tag:
                break
        if self.link > len(self.stack):
            self.link = 0

    def read(self, page: str) -> list[Block]:
        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            stop = m.start() if m else n
            if stop > at:
                self.data.append((_html.unescape(page[at:stop]) if "&" in page[at:stop] else page[at:stop], self.link > 0))
                if self.breaks and not page[at:stop].isspace():
                    self.breaks = 0
            if not m:
                break
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                elif tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = close.end() if close else n
                else:
                    if tag == "p" and self.open["p"] and self.stack[-1].tag == "p":
                        self.end("p")
                    self.start(tag, m[3])
        self.flush()
        return self.blocks


def first_pass(b: Block) -> str:
    """good, bad, or nothing where the measures do not decide; none where markup does."""
    if b.marked:
        return "none"
    if b.linked > LINKED * len(b.text):
        return "bad"
    if len(b.text) < SHORT:
        return ""
    if not b.part and "©" in b.text:
        return "bad"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    if stops >= STOPS * max(len(words), 1):
        return "good"
    return "" if b.part else "bad"


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of their nearest decided neighbours within the same article or outside of all."""
    sides: list[list[str]] = []
    for run in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        seen: dict[int, str] = {}
        found = [""] * len(blocks)
        for i in run:
            b = blocks[i]
            found[i] = seen.get(b.part, "")
            if b.label in ("good", "bad"):
                seen[b.part] = b.label
        sides.append(found)
    new = []
    for b, before, after in zip(blocks, *sides):
        if b.label:
            new.append(b.label)
        elif b.tag in HEADINGS and after:
            new.append("good" if b.part and before != "bad" else after)
        elif before == after and before:
            new.append(before)
        else:
            new.append("good" if b.part else "bad" if before or after else "")
    for b, label in zip(blocks, new):
        b.label = label


def page_blocks(page: str | None) -> list[Block]:
    """All blocks of a page with their labels: good (main text), bad, none (markup that is no main text)."""
    reader = _Reader()
    blocks = reader.read(page or "")
    for b in blocks:
        b.label = first_pass(b)
    second_pass(blocks)
    good = {b.part for b in blocks if b.label == "good" and b.part}
    # An article within one that has text of its own is a reader's comment.
    comment = [False]
    for up in reader.outer[1:]:
        comment.append(comment[up] or up in good)
    # The title may stand above the article.
    first = next((i for i, b in enumerate(blocks) if b.label == "good" and b.part), 0)
    titled = any(b.tag == "h1" and b.part and b.label == "good" for b in blocks)
    title = next((b for b in reversed(blocks[:first]) if b.tag == "h1" and not b.part and b.label != "none" and not b.linked), None)
    for b in blocks:
        if b.label != "none" and (comment[b.part] or (good and not b.part)):
            b.label = "good" if b is title and not titled else "bad"
    if not any(b.label == "good" for b in blocks):
        for b in blocks:
            if b.label != "none":
                b.label = "bad" if b.linked > LINKED * len(b.text) or "©" in b.text else "good"
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in page_blocks(page) if b.label == "good")


def extracted(html: Column) -> Column:
    """The main text of a page; empty where there is none."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype="object")

    return texts(html)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and its length in code points, one row for each page."""
    return pages.select("page_id", "url", extracted(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op12_html_extraction": op12_html_extraction}
ORACLES: dict[str, str] = {}
