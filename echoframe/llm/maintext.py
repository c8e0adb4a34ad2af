"""HTML extraction: the best-scoring contiguous run of words and tags.

A page is one sequence of tags and stretches of text. Every word scores above zero, and
every tag below zero; how much is the log-odds of lying inside the content, counted on
labelled pages, by the word's surroundings (plain, in a link, or outside the article on
a page that marks one; inside a marked article a link's words are plain) and by the tag's
name. One linear scan finds the contiguous
run of greatest sum. Elements that are boilerplate by name or class (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) score nothing
and give no text, so an advert in the middle does not break a run.

Defined results
---------------
* A null or empty page, or one without content words, has an empty text.
* Character references are decoded as HTML5 does; white space, also between blocks, becomes one space.
* Unclosed elements end where an element around them ends, or with the page; a tag that the page's end cuts off is no text.
* A quotation mark counts only behind an equals sign of a tag; elsewhere, and unclosed, it is a character like others.
* Of runs with the same sum, the first to end wins. Repeated rows give equal rows. One pass, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import schema_of

_RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(_RAW)})\b(?P<rest>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')?|[^<>=])*+)(?P<end>>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are boilerplate by their name, and words that make an element so by its class, id or role.
CHROME_TAGS = frozenset("nav header footer aside form button select dialog menu head".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar related recommended share sharing social comment comments replies disqus respond widget footer masthead pagination toolbar".split()
)
#: Beside one of these, only the plainest of the words above make an element boilerplate.
CONTENT_WORDS = frozenset("content main article post entry story page wrapper container layout body".split())
PLAINEST = frozenset("ad ads advert adverts advertisement cookie cookies consent comment comments replies disqus newsletter".split())
MARKED = frozenset({"article", "main"})


@dataclass(slots=True)
class Item:
    """A tag, or a stretch of text between tags (name empty)."""

    name: str
    close: bool
    text: str
    words: int
    kind: str  # of text: plain, link or outside
    chrome: bool


def items_of(page: str) -> list[Item]:
    out: list[Item] = []
    stack: list[tuple[str, bool]] = []
    counts = Counter()  # of open chrome, marked and link elements
    opened = Counter()  # of open elements by name
    marked = False
    at = 0

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            out.append(Item("", False, piece, len(piece.split()), "in" if counts["marked"] else "link" if counts["a"] else "plain", counts["chrome"] > 0))

    def shift(name: str, chrome: bool, by: int) -> None:
        counts["chrome"] += by * chrome
        counts["marked"] += by * (name in MARKED)
        counts["a"] += by * (name == "a")
        opened[name] += by

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                out.append(Item(m["raw"].lower(), False, "", 0, "", counts["chrome"] > 0))
            continue
        if m["close"]:
            if opened[name]:
                while True:
                    n, chrome = stack.pop()
                    shift(n, chrome, -1)
                    if n == name:
                        break
            out.append(Item(name, True, "", 0, "", counts["chrome"] > 0))
        else:
            chrome = name in CHROME_TAGS
            if m["attrs"] and not chrome and name not in ("html", "body"):
                marks = " ".join(a or b or c for a, b, c in _MARK.findall(m["attrs"]))
                words = {w.lower() for w in _PART.split(marks)}
                chrome = not (CHROME_WORDS if words.isdisjoint(CONTENT_WORDS) and name not in MARKED else PLAINEST).isdisjoint(words)
            out.append(Item(name, False, "", 0, "", counts["chrome"] > 0 or chrome))
            if name not in VOID and not m["attrs"].endswith("/"):
                marked |= name in MARKED and not chrome
                stack.append((name, chrome))
                shift(name, chrome, 1)
    text(page[at:])
    if marked:
        for x in out:
            if not x.name:
                x.kind = {"in": "plain", "plain": "outside"}.get(x.kind, x.kind)
    else:
        for x in out:
            if x.kind == "in":
                x.kind = "plain"
    return out


@dataclass(frozen=True)
class Weights:
    words: dict[str, float]
    tags: dict[str, float]
    other_tag: float

    def score(self, x: Item) -> float:
        if x.chrome:
            return 0.0
        return self.words[x.kind] * x.words if not x.name else self.tags.get(("/" if x.close else "") + x.name, self.other_tag)


#: Labelled pages: the content lies between ⟦ and ⟧.
LABELLED = (
    "<html><head><title>Tea</title></head><body><nav><a href='/'>Home</a> <a href='/s'>Shop</a></nav>⟦<article><h1>On tea</h1><p>Tea is made from the leaves of one plant, picked young.</p><p>Water just off the boil suits <b>black</b> tea; green tea likes it <a href='/c'>cooler</a>.</p></article>⟧<footer>Imprint</footer></body></html>",
    "<body><div><a href='/a'>News</a><a href='/b'>Sport</a><a href='/c'>Weather</a></div><div>⟦<h2>Floods in the valley</h2><p>The river rose two metres overnight and reached the old bridge by dawn.</p><p>No one was hurt, the mayor said on Tuesday.</p>⟧</div><ul><li><a href='/1'>More floods</a></li><li><a href='/2'>Bridges of the world</a></li></ul><div>All rights reserved</div></body>",
    "<body><table><tr><td><a href='/x'>Index</a></td><td><a href='/y'>Search</a></td></tr></table>⟦<h1>Field notes</h1><p>Day one: rain, and a long walk to the ridge with all the instruments.</p><ul><li>barometer read low all day</li><li>wind turned north after noon</li></ul><p>We slept well.</p>⟧<div><a href='/p'>Previous</a> <a href='/n'>Next</a></div></body>",
    "<body><div>Sign up now</div><main>⟦<h1>Bread</h1><p>Flour, water, salt and time are all that a good loaf needs.</p><blockquote>Patience is the best baker, as they say in the village.</blockquote><p>Bake it hot.</p>⟧</main><div>Our partners offer you more</div></body>",
    "<body><p><a href='/'>Start</a></p>⟦<h3>Minutes</h3><p>The meeting opened at nine with all members present.<br>The budget was approved without changes after a short debate.</p><pre>votes: ten for, none against</pre>⟧<p><a href='/t'>Top of page</a></p></body>",
    "<body><div>Breaking: call now</div><article>⟦<h1>Stars</h1><p>On a clear night some three thousand stars can be seen without a glass.</p><figure><img src='s.png'><figcaption>The northern sky in winter</figcaption></figure><p>Most have no name.</p>⟧</article><div>Buy a telescope today</div><div>Contact</div></body>",
)


def train(pages: tuple[str, ...] = LABELLED) -> Weights:
    """Log-odds of lying inside the content, smoothed by a half; kept above zero for plain words and below it for tags."""
    inside, outside = Counter(), Counter()
    for page in pages:
        within = False
        for x in items_of(page):
            if not x.name:
                for piece in re.split("([⟦⟧])", x.text):
                    if piece in ("⟦", "⟧"):
                        within = piece == "⟦"
                    elif not x.chrome:
                        (inside if within else outside)["", x.kind] += len(piece.split())
            elif not x.chrome:
                (inside if within else outside)["tag", ("/" if x.close else "") + x.name] += 1
    odds = lambda k: math.log((inside[k] + 0.5) / (outside[k] + 0.5))
    tags = {k[1]: min(odds(k) if k[1].lstrip("/") not in INLINE else 0.0, -0.1) for k in inside | outside if k[0]}
    return Weights({"plain": max(odds(("", "plain")), 0.5), "link": odds(("", "link")), "outside": min(odds(("", "outside")), -1.0)}, tags, min(tags.values()) / 2)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest sum above zero; empty if there is none."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def extract(page: str | None, w: Weights) -> str:
    if not page:
        return ""
    items = items_of(page)
    start, end = best_run([w.score(x) for x in items])
    return " ".join("".join("" if x.name in INLINE else " " if x.name else "" if x.chrome else x.text for x in items[start:end]).split())


OUT = schema_of("page_id long, url string, text string, n_chars long")


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row per row of df: page_id, url, the main text, and its code points."""
    w = weights or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(p, w) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=OUT.names)

    return df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")).mapInArrow(run, OUT)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
