"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A block is described by its words and link density, by those of its neighbours
and by the elements around it. The tree is grown from the blocks of a few
labelled pages below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.S,
)
_HINT = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?\s*main\b(?!-)", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Elements and the words of class, id and role that tell what a part of a page is for.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
_HIDDEN = frozenset("script style noscript template textarea select svg iframe object head title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog button".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar side nav "
    "navbar navigation menu breadcrumb breadcrumbs footer comment comments reply replies respond disqus cookie cookies "
    "notice notices alert consent gdpr newsletter subscribe subscription popup modal share sharing social related "
    "recommended widget widgets toolbar login signup search pagination pager skip contentinfo complementary".split()
)
#: Words that stand before or after one of these in a compound that still names the part itself.
_BEFORE = frozenset("site page post main global entry article blog the".split())
_AFTER = frozenset("list area section box block bar links buttons button items item posts wrapper container inner".split())
_CONTENT = frozenset("article main".split())


@dataclass
class Block:
    text: str
    words: int
    linked: float
    article: bool
    noise: bool
    page_head: bool
    heading: bool


def _names_noise(token: str) -> bool:
    """Whether a class names a part that is noise: ``comments``, ``site-footer``, but not ``has-sidebar``."""
    parts = [part.lower() for part in _PART.findall(token)]
    while len(parts) > 1 and parts[0] in _BEFORE:
        parts.pop(0)
    while len(parts) > 1 and parts[-1] in _AFTER:
        parts.pop()
    return bool(parts) and all(part in _NOISE for part in parts)


def _is_noise(attributes: str) -> bool:
    for found in _HINT.finditer(attributes):
        value = found.group(1) or found.group(2) or found.group(3) or ""
        if any(map(_names_noise, value.split())):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; what a cut-off page still has counts.

    Body, main and article are no noise, nor is what holds the main element. What
    holds an article is none either if all articles of the page would go with it
    (comments are often articles as well).
    """
    out: list[Block] = []
    marks: list[frozenset[int]] = []  # per block: the elements around it that look like noise
    around: frozenset[int] = frozenset()
    with_main: set[int] = set()
    with_article: set[int] = set()
    n_marks = 0
    text: list[str] = []
    link_words = link = 0
    stack: list[tuple[str, frozenset[int], bool, bool]] = []  # tag, noise, article, page head
    article = head = heading = False

    def close() -> None:
        nonlocal link_words
        joined = "".join(text)
        joined = " ".join((html.unescape(joined) if "&" in joined else joined).split())
        text.clear()
        if joined:
            n = joined.count(" ") + 1
            out.append(Block(joined, n, min(1.0, link_words / n), article, False, head, heading))
            marks.append(around)
        link_words = 0

    def add(piece: str) -> None:
        nonlocal link_words
        if piece:
            text.append(piece)
            if link:
                link_words += len(piece.split())

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found.group(2) or found.group(5) or "").lower()
        if not name:
            continue
        ends, attributes = bool(found.group(1) or found.group(4)), found.group(3) or found.group(6) or ""
        if name in _HIDDEN and not ends:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if name == "head" and (body := re.compile(r"<body\b", re.I).search(page, at)):
                    at = min(body.start(), end.end() if end else len(page))
                else:
                    at = end.end() if end else len(page)
            close()
        elif name == "br":
            add(" ")
        elif name == "a":
            link = max(0, link - 1) if ends else 1
        elif name in _INLINE:
            pass
        elif ends:
            close()
            if name in _HEADS:
                heading = False
            if any(own == name for own, *_ in stack):
                while stack:
                    own, around, article, head = stack.pop()
                    if own == name:
                        break
            link = 0
        else:
            close()
            if name in _HEADS:
                heading = True
            elif name == "p":
                heading = False
            if name not in _VOID and name not in _HEADS and name != "p":
                stack.append((name, around, article, head))
                is_main = name == "main" or bool(_MAIN_ROLE.search(attributes))
                if name == "body" or is_main:
                    with_main |= around
                elif name == "article":
                    with_article |= around
                elif name in _ASIDE or _is_noise(attributes):
                    around |= {n_marks}
                    n_marks += 1
                article = article or name in _CONTENT or is_main
                head = head or (name == "header" and not article)
    close()
    lifted = with_main
    if not any(block.article and not own - lifted for block, own in zip(out, marks)):
        lifted = with_main | with_article
    for block, own in zip(out, marks):
        block.noise = bool(own - lifted)
    return out


def features(found: list[Block]) -> np.ndarray:
    """Words and link density of each block and its neighbours, and what stands around it."""
    words = np.array([0, *[b.words for b in found], 0], dtype=np.float64)
    linked = np.array([0, *[b.linked for b in found], 0], dtype=np.float64)
    inside = any(b.article for b in found)
    rows = [
        (
            words[i], linked[i], words[i - 1], linked[i - 1], words[i + 1], linked[i + 1],
            b.article or not inside, b.noise, b.page_head, b.heading,
        )
        for i, b in enumerate(found, 1)
    ]
    return np.asarray(rows, dtype=np.float64).reshape(-1, 10)


@dataclass
class Tree:
    """A node of a binary tree: at a leaf ``feature`` is -1 and ``main`` decides."""

    feature: int = -1
    bound: float = 0.0
    main: bool = False
    low: Tree | None = None
    high: Tree | None = None

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
        """The split with the least Gini impurity, again and again, as in CART."""
        node = cls(main=bool(y.mean() >= 0.5) if len(y) else False)
        if not depth or not len(y) or y.all() or not y.any():
            return node
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for bound in (values[1:] + values[:-1]) / 2:
                parts = y[x[:, feature] <= bound], y[x[:, feature] > bound]
                impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in parts)
                best = min(best, (impurity, feature, bound))
        _, node.feature, node.bound = best
        if node.feature >= 0:
            low = x[:, node.feature] <= node.bound
            node.low, node.high = cls.grow(x[low], y[low], depth - 1), cls.grow(x[~low], y[~low], depth - 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.main)
        low = x[:, self.feature] <= self.bound
        out = np.empty(len(x), dtype=bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


# The labelled table: blocks that begin with + are main text, those with - are not.
LABELLED = (
    "<body><nav><ul><li><a href=/>-Home</a><li><a href=/n>-News</a></ul></nav><div class=ad>-Buy this now and save a lot "
    "of money today</div><article><h1>+A title of the page</h1><p>+First words of the text that go on for a while and say "
    "something.<p>+Short.<p>+And a last paragraph with <a href=x>one link</a> in it.</article><footer>-c site</footer>",
    "<body><header><h1>-The Site</h1><p>-What it is about in some words</p></header><main><h2>+Heading</h2><p>+Text of a page "
    "without the other element, long enough to look like prose, as it is.<ul><li>+one point<li>+another point of it</ul>"
    "<aside><p>-Read also this long teaser about something else entirely, with words and words.</aside></main>"
    "<form><p>-Your name and address please</form><footer><p>-All about us and the imprint of this site in a few words</footer>",
    "<div id=menu><a href=1>-one</a> <a href=2>-two</a></div><div class=content><h1>+Plain page</h1><p>+There is no article "
    "element here at all but a few sentences stand in a row and they are the text. So this is it.<p>+The second one is also "
    "part of the text, and it has more than ten words in it.<p>+Yes.</div><div class=sidebar><h3>-Popular</h3><ul><li>"
    "<a href=3>-a link that is long enough to be a sentence</a></ul></div><div id=footer>-Copyright and so on</div>",
    "<div>-<a href=a>all of this is a link</a></div><div>-<a href=b>and this one as well</a></div><div><p>+Here the words "
    "begin, outside of everything that would tell what they are, and go on.<p>+Then more of them, and still more of them, to "
    "be sure about it.</div><div>-<a href=c>next page</a></div><div class=comments><p>-I liked this text very much and would "
    "like to say so at some length, for I am a reader.</div><div class='cookie notice'>-We use cookies to make it better</div>",
    "<article><header><h1>+Own header of an article</h1><p>+By somebody, on a day</header><p>+Its first paragraph is here and "
    "it is of a fair length, too.</p><div class=share><a href=s>-Share</a></div><div class=promo><p>-Subscribe to our letter "
    "and get ten of them for nothing at all</div><p>+End.</p><section class=comments><h2>-Comments</h2><p>-First! This is "
    "what readers say below the text in their own words.</section></article><div><p>-Something below the article that does "
    "not belong to it, even though it is long and reads well.</div>",
    "<table><tr><td>-<a href=1>a</a><td>+A page made of tables holds its sentences in cells, as this long one shows to us."
    "<td>+Another cell that has a sentence of some length, too, in it.</table>",
    "<body class='has-sidebar'><div class='layout sidebar-right'><article class='post comments-open'><h1>+Under a theme</h1>"
    "<p>+All that stands around this text names a sidebar or comments, and still it is the text of the page.<p>+So is this."
    "</article></div><div class='site-footer'><p>-Who made the theme and where it can be had, in one sentence</div></body>",
    "<body class='no-sidebar'><div class='content has-sidebar'><h1>+No article here</h1><p>+A wrapper with the name of a part "
    "that stands beside it holds the words of this page, which are many.<p>+And these.</div><ol class='comment-list'><li>"
    "<p>-A reader says below the text what they think of it, in more than a few words.</ol></body>",
)


@lru_cache(maxsize=1)
def trained() -> Tree:
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page)
        rows.append(features(found))
        labels += [b.text.startswith("+") for b in found]
    return Tree.grow(np.concatenate(rows), np.asarray(labels))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(features(found))
    return " ".join(b.text for b, main in zip(found, keep) if main)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    Null and empty pages have empty text. A page is read whole, in one task; rows
    are kept one to one, repeated ones too; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(tree or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
