"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags.  Blocks within an element
that is never part of an article, by its tag, its role or a name such as
``comments`` or ``sidebar-left`` in its class or id, are dropped.  A name that
only mentions such a part (``has-sidebar``, ``comments-open``, ``post-share``)
puts its blocks in doubt: they are dropped, unless their element holds over
half of the page's good text, as an article's own element does.

The first pass decides a block by link density, length and the density of stop
words.  In the second pass every undecided block takes the label of its nearest
decided neighbour; two that differ at the same distance leave it to whether the
block lies in a marked-up article.  Where nothing is decided, the undecided
blocks are kept.  Where marked-up articles (``article`` or ``main``) hold at
least half of the good text, the blocks outside are no candidates, and long
ones inside are only decided against by link density; a page whose only marked-up
article is a teaser is taken as one without.

Character references are decoded, white space within a block becomes one
space, and the blocks kept are joined by line feeds.  The whole page is read; a
tag, comment or script that the page's end cuts off counts as markup.

A null or empty page has an empty text.  Repeated rows stay.  An empty table
gives no rows.  Columns ``text`` and ``n_chars`` of the input are replaced, others
are kept whatever their names.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by their role in a page, names that mark parts beside the article, frequent words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe noembed noframes textarea title svg math object canvas audio video select xmp".split())
DROPPED_TAGS = frozenset("head nav footer aside form button dialog menu fieldset label".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising adbox adslot adsense sponsor sponsored sponsors promo promotion promotions banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead toolbar topbar pagination pager "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer paywall "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations trending widget widgets "
    "comment comments commentlist replies reply respond disqus feedback tags skip hidden".split()
)
#: Words in a name that make it tell of a state, a layout or the article itself, rather than of a part beside it.
MENTIONING = frozenset(
    "no not non has have with without is in on off to hide hides show shows open opened closed enabled disabled allow allowed skip "
    "content contents article articles post posts entry story main body page text wrapper wrap container outer inner layout template single site col cols column columns row grid full width left-of right-of".split()
)
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we "
        "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum "
        "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais "
        "el y los del las por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre"
    ).split()
)
DEEPEST = 32  # doubted elements around one another that are told apart
LINK_LIMIT, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.4, 40, 140, 0.12, 0.2

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))|</[^a-zA-Z][^>]*(?:>|\Z)|</\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _standing(tag: str, attributes: str, in_article: bool) -> str:
    """``out``: never part of an article; ``doubt``: its name mentions a part that isn't; else empty."""
    if tag in DROPPED_TAGS or tag == "header" and not in_article:
        return "out"
    if not attributes or attributes == ">" or tag in ("html", "body"):
        return ""
    doubt = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return "out"
        if name == "role" and value.strip().lower() in DROPPED_ROLES:
            return "out"
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _NAME.findall(token)}
                if words & DROPPED_NAMES:
                    if not words & MENTIONING and tag not in ("article", "main"):
                        return "out"
                    doubt = True
    return "doubt" if doubt else ""


class Block(NamedTuple):
    text: str
    linked: int
    article: bool
    heading: bool
    doubts: tuple[int, ...] = ()

    def stop_density(self) -> float:
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?()\"'«»“”") in STOP_WORDS for w in words) / len(words)

    def label(self, in_article: bool) -> bool | None:
        """The first pass: good, bad or undecided."""
        if self.linked > LINK_LIMIT * len(self.text):
            return None if self.heading else False
        stop = self.stop_density()
        if len(self.text) >= SHORT and stop >= STOP_HIGH or len(self.text) >= LONG and (stop >= STOP_LOW or in_article):
            return True
        return False if not in_article and len(self.text) >= LONG else None


class _Page:
    """Blocks of a page: their text, characters in links, whether in a marked-up article, whether a heading, doubted elements around them."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # tag, dropped, in an article, doubted elements
        self.open: dict[str, int] = {}
        self.dropped = self.article = False
        self.doubts: tuple[int, ...] = ()
        self.n_doubts = 0
        self.breaks = 0
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                heading = any(t in self.open and self.open[t] for t in ("h1", "h2", "h3", "h4", "h5", "h6"))
                self.blocks.append(Block(text, self.linked, self.article, heading, self.doubts))
        self.parts, self.linked, self.breaks = [], 0, 0

    def _text(self, text: str) -> None:
        if text and not self.dropped:
            self.parts.append(text)
            if self.open.get("a"):
                self.linked += len(text.strip())
            if text.strip():
                self.breaks = 0

    def _push(self, tag: str, attributes: str) -> None:
        article = self.article or tag in ("article", "main")
        self.stack.append((tag, self.dropped, self.article, self.doubts))
        self.open[tag] = self.open.get(tag, 0) + 1
        if not self.dropped:
            standing = _standing(tag, attributes, self.article)
            self.dropped = standing == "out"
            if standing == "doubt" and len(self.doubts) < DEEPEST:
                self.n_doubts += 1
                self.doubts = (*self.doubts, self.n_doubts)
        self.article = article

    def _pop(self, tag: str) -> None:
        if self.open.get(tag):
            while True:
                top, dropped, article, doubts = self.stack.pop()
                self.open[top] -= 1
                if top in BLOCK_TAGS:
                    self._flush()
                self.dropped, self.article, self.doubts = dropped, article, doubts
                if top == tag:
                    break

    def _read(self, page: str) -> None:
        at = 0
        while m := _TOKEN.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK_TAGS:
                    self._flush()
                self._pop(tag)
            elif tag == "br":
                self.breaks += 1
                self._text(" ") if self.breaks < 2 else self._flush()
                self.breaks = max(self.breaks, 1)
            elif tag in RAW_TAGS:
                if not m[3].rstrip(">").endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else len(page)
            else:
                if tag in BLOCK_TAGS:
                    self._flush()
                    if self.open.get("p"):
                        self._pop("p")
                if tag == "li" and self.stack and self.stack[-1][0] == "li":
                    self._pop("li")
                if tag not in VOID_TAGS:
                    self._push(tag, m[3])
        self._text(page[at:])


def decided(labels: list[bool | None], inside: list[bool]) -> list[bool]:
    """The second pass: every undecided block by its nearest decided neighbour; inside: whether in a marked-up article."""
    n = len(labels)
    before, after = [-1] * n, [-1] * n
    for i in range(n):
        before[i] = i if labels[i] is not None else before[i - 1] if i else -1
    for i in reversed(range(n)):
        after[i] = i if labels[i] is not None else after[i + 1] if i + 1 < n else -1
    out = []
    for i, label in enumerate(labels):
        a, b = before[i], after[i]
        if label is not None:
            out.append(label)
        elif a < 0 or b < 0:  # neighbours on one side at most
            out.append(bool(labels[max(a, b)]) or inside[i] if max(a, b) >= 0 else True)
        elif i - a == b - i and labels[a] != labels[b]:
            out.append(inside[i])
        else:
            out.append(bool(labels[a if i - a <= b - i else b]))
    return out


def main_text(page: str | None) -> str:
    blocks = _Page(page or "").blocks
    good = [len(b.text) if b.label(False) else 0 for b in blocks]
    in_doubt: Counter[int] = Counter()
    for b, n in zip(blocks, good, strict=True):
        for d in b.doubts:
            in_doubt[d] += n
    total = sum(good)
    kept = [not any(2 * in_doubt[d] <= total for d in b.doubts) for b in blocks]
    blocks, good = list(itertools.compress(blocks, kept)), list(itertools.compress(good, kept))
    marked = sum(n for b, n in zip(blocks, good, strict=True) if b.article)
    if any(b.article for b in blocks) and 2 * marked >= sum(good):
        blocks = [b for b in blocks if b.article]
        inside = [True] * len(blocks)
    else:
        inside = [False] * len(blocks)
    labels = [b.label(i) for b, i in zip(blocks, inside, strict=True)]
    return "\n".join(b.text for b, ok in zip(blocks, decided(labels, inside), strict=True) if ok)


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with the main text in ``text`` and its number of characters in ``n_chars``."""

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return pages.withColumn("text", texts(F.col(html_column))).withColumn("n_chars", F.length("text").cast("long"))
