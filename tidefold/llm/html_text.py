"""HTML extraction: streaming parser events, text-to-tag ratio, Gaussian smoothing and threshold clustering.

The standard library's parser gives events; block-level tags and line breaks bound lines.  A line's text-to-tag
ratio is its characters, those of links left out, over its tags (at least one).  Ratios are smoothed
with a Gaussian along the page; lines above ``THRESHOLD`` standard deviations of the smoothed ratios form the
cluster of content lines, and their characters are the content.  Tags, roles, class names and ids only weigh:

* What they say of menus, headers, footers, sidebars, notices, adverts, forms and reader comments counts as long as ``FREE`` of the
  content, or of the page's characters ``FREE_ARTICLE`` in an ``article`` or ``main``, stands outside of all that is so marked.  Else the mark (a tag,
  a role or one class name) that holds most of the content is taken to say nothing, and so on, until the rest is enough.  Then the
  lines outside of marks are smoothed and clustered by themselves.
* The content region is the smallest container with ``SHARE`` of the content outside of marks; content in ``article`` or ``main`` weighs
  ``ARTICLE`` times as much, and a region is not narrowed below such an element.

Of the region all lines outside of marks are kept but those that are mostly links; in an ``article`` or ``main``, only if another such
line is next to them.

``extract`` returns one row per row of the input: ``page_id, url, text, n_chars``.  Character references are
decoded, white space in a line becomes one space, lines are joined in page order by one space.  Null,
empty or textless html gives an empty text.  Markup may be cut off anywhere.  Repeated rows and null ids are kept as they are;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm._shared import own_columns

SIGMA, THRESHOLD, SHARE, FREE, FREE_ARTICLE, ARTICLE, FEED = 1.0, 0.5, 0.85, 0.1, 0.02, 4.0, 1 << 16
_Line = tuple[str, int, int, int, int]
#: Marks that are told apart; beyond that, class names with one word in common count as one.
MARKS = 512

#: Elements by role in the extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template button select textarea option iframe object svg head title audio video canvas math".split())
MARKED = frozenset("nav header footer aside dialog menu form".split())
CONTAINERS = frozenset("html body div section article main td center".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status toolbar".split())
#: Words of class names and ids that mark what is not the article.
MARK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors comment comments commentlist respond responses disqus reply replies reactions "
    "promo promos promotion banner sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager login paywall disclaimer footer masthead toc skip".split()
)
#: Whole class names and ids that do so.
MARK_NAMES = frozenset("header site-header page-header top-header header-top topbar top-bar copyright site-info search searchbox search-form search-box legal".split())
_WORDS, _DIGITS = re.compile(r"[a-z]+"), re.compile(r"[0-9]+")


def _marks(tag: str, attrs: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
    """What marks an element as other than the article: (mark, its word)."""
    out = [(f"<{tag}>", tag)] if tag in MARKED else []
    for name, value in attrs:
        if name in ("class", "id") and value:
            for c in value.lower().split():
                found = MARK_WORDS.intersection(_WORDS.findall(c))
                if found or c in MARK_NAMES:
                    out.append((_DIGITS.sub("#", c), min(found, default=c)))
        elif name == "role" and value and value.lower() in ROLES:
            out.append((f"role={value.lower()}", "role"))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            out.append(("hidden", "hidden"))
    return out


class _Lines(HTMLParser):
    """Lines of a page: text, tags, characters in links, innermost container, marks.

    Every event takes time in proportion to what it opens and closes, however deep or unbalanced the markup is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, whether what is in it is dropped, container, marks as bits
        self.count: dict[str, int] = {}  # of open elements by tag
        self.parent, self.kind = [-1], ["page"]
        self.bits: dict[str, int] = {}  # the bit of each mark
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, max(1, self.tags), self.linked, *(self.open[-1][2:] if self.open else (0, 0))))
            self.parts.clear()
        self.tags = self.linked = 0

    def _bit(self, mark: str, word: str) -> int:
        if mark not in self.bits and len(self.bits) >= MARKS:
            mark = word
        return 1 << self.bits.setdefault(mark, len(self.bits))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag not in INLINE:
                self.end_line()
            self.tags += 1
            return
        if tag not in INLINE:
            self.end_line()
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd"):
                self._imply_end(tag)
        self.tags += 1
        dropped, container, marks = self.open[-1][1:] if self.open else (False, 0, 0)
        dropped = dropped or tag in DROPPED
        if not dropped:
            if (attrs or tag in MARKED) and tag not in ("html", "body"):
                for mark, word in _marks(tag, attrs):
                    marks |= self._bit(mark, word)
            if tag in CONTAINERS:
                self.parent.append(container)
                self.kind.append(tag)
                container = len(self.parent) - 1
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append((tag, dropped, container, marks))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in INLINE and tag not in CONTAINERS | DROPPED | MARKED | {"p"}:
            self.end_line()
        else:
            self.handle_starttag(tag, attrs)

    def _imply_end(self, tag: str) -> None:
        """A new p, li or cell ends an open one, unless a container, a list or a table lies between."""
        ends = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else ("tr", "td", "th") if tag == "tr" else (tag,)
        if not any(self.count.get(t) for t in ends):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                self._close(k)
                return
            if self.open[k][0] not in INLINE and self.open[k][0] != "p":
                return

    def _close(self, k: int) -> None:
        for x in self.open[k:]:
            self.count[x[0]] -= 1
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.tags += 1
                self._close(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)
            if self.count.get("a"):
                self.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and scaled to sum 1."""
    r = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[r : r + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[r : r + len(ratios)]


def content_lines(lines: list[_Line]) -> tuple[np.ndarray, np.ndarray]:
    """The characters outside of links of each line, and which lines are in the cluster of content."""
    sizes = np.array([len(x[0]) - min(x[2], len(x[0])) for x in lines], dtype=float)
    ratios = smoothed(sizes / np.array([x[1] for x in lines]))
    return sizes, ratios > THRESHOLD * ratios.std()


def _articles(page: _Lines) -> list[bool]:
    """Which containers are in an article."""
    out = [False] * len(page.parent)
    for c in range(1, len(out)):
        out[c] = out[page.parent[c]] or page.kind[c] in ("article", "main")
    return out


def _free(page: _Lines, article: list[bool]) -> list[_Line]:
    """The lines outside of marks, leaving aside those marks that would leave too little."""
    sizes, content = content_lines(page.lines)
    by: dict[int, tuple[float, float]] = {}  # content, and characters in articles, behind each set of marks
    for x, n, c in zip(page.lines, sizes, content, strict=True):
        m, a = by.get(x[4], (0.0, 0.0))
        by[x[4]] = (m + n * c, a + n * article[x[3]])
    enough, enough_article, void = FREE * sum(m for m, _ in by.values()), FREE_ARTICLE * sizes.sum(), 0
    while any(by):
        m, a = by.get(0, (0.0, 0.0))
        if m > enough or a > enough_article:
            break
        # the mark that alone stands before most content, else that which stands before most at all
        held: dict[int, float] = {}
        for marks, (m, _) in by.items():
            if marks and not marks & (marks - 1):
                held[marks] = held.get(marks, 0.0) + m
        if not held:
            for marks, (m, _) in by.items():
                for k in range(marks.bit_length()):
                    if marks >> k & 1:
                        held[1 << k] = held.get(1 << k, 0.0) + m
        gone = max(held, key=lambda k: (held[k], -k))
        void |= gone
        rest: dict[int, tuple[float, float]] = {}
        for marks, (m, a) in by.items():
            n, b = rest.get(marks & ~gone, (0.0, 0.0))
            rest[marks & ~gone] = (m + n, a + b)
        by = rest
    return [x for x in page.lines if not x[4] & ~void]


def _region(page: _Lines, lines: list[_Line], mass: np.ndarray, article: list[bool]) -> list[bool]:
    """Which containers are in the region."""
    n = len(page.parent)
    held, heaviest = [0.0] * n, [0] * n
    for x, m in zip(lines, mass, strict=True):
        held[x[3]] += m * (ARTICLE if article[x[3]] else 1.0)
    for c in range(n - 1, 0, -1):  # a container comes before those in it
        p = page.parent[c]
        held[p] += held[c]
        if not heaviest[p] or held[c] >= held[heaviest[p]]:
            heaviest[p] = c
    root = 0
    while not article[root] and heaviest[root] and held[0] > 0 and held[heaviest[root]] >= SHARE * held[0]:
        root = heaviest[root]
    inside = [False] * n
    for c in range(n):
        inside[c] = c == root or c > 0 and inside[page.parent[c]]
    return inside


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Lines()
    for i in range(0, len(html), FEED):
        page.feed(html[i : i + FEED])
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    article = _articles(page)
    lines = _free(page, article)
    sizes, content = content_lines(lines)
    inside = _region(page, lines, np.where(content, sizes, 0.0), article)
    links = [2 * x[2] > len(x[0]) for x in lines]
    beside = [any(links[max(0, k - 1) : k] + links[k + 1 : k + 2]) for k in range(len(links))]
    return " ".join(x[0] for k, x in enumerate(lines) if inside[x[3]] and (not links[k] or article[x[3]] and not beside[k]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, held, first = [], 0, 0
        for k in range(batch.num_rows):
            texts.append(main_text(batch.column(2)[k].as_py()))
            held += len(texts[-1])
            if held > 8_000_000 or k == batch.num_rows - 1:
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                texts, held, first = [], 0, k + 1


def extract(pages: DataFrame) -> DataFrame:
    p = own_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
