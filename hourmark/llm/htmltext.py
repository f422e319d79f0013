"""Main text of web pages by text-to-tag ratios.

A page goes through the standard library's streaming parser once. Its events are
cut into lines at the borders of block elements; a line knows its text, the tags
seen in it, whether it lies within an element that is never an article (menus,
headers, footers, asides, forms, adverts, notices, reader comments, scripts), and
the containers around it. Each line's ratio of characters to tags is smoothed with
a Gaussian over its neighbours; lines above the deviation of the smoothed ratios
cluster as content. The region with most content characters, an article
element where the page has one, is the article: all its lines stay, however short,
but those of excluded elements.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import arrow_rows

# Element names of HTML, by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div body td".split())
EXCLUDED = frozenset(
    "head script style noscript template nav menu header footer aside form button select option textarea input dialog iframe object embed svg canvas audio video map math".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id values that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus respond replies share sharing social related recommended pagination pager widget toolbar search".split()
)
#: Those of them that count on article elements: reader comments, adverts and teasers come as such too.
NESTED_MARKS = frozenset("ad ads advert sponsored promo comment comments related".split())
#: An open element of the first kind ends when one of the second starts.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_WORD = re.compile(r"[a-z]+")

#: Standard deviation of the smoothing in lines, the share of content characters a region needs, and containers within
#: containers up to which they are told apart (text further in belongs to the last one, and stays).
SIGMA, SHARE, DEPTH = 1.0, 0.5, 256


class _Line:
    __slots__ = ("text", "tags", "kept", "inside")

    def __init__(self, kept: bool, inside: tuple[int, ...]) -> None:
        self.text, self.tags, self.kept, self.inside = [], 0, kept, inside


class PageLines(HTMLParser):
    """Lines of a page in order, from parser events; ``containers`` holds (tag, is an article) by number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.containers: list[tuple[str, bool]] = []
        self.open: list[tuple[str, bool, tuple[int, ...]]] = []  # tag, kept, containers around what is in it
        self._break()

    def _state(self) -> tuple[bool, tuple[int, ...]]:
        return self.open[-1][1:] if self.open else (True, ())

    def _break(self) -> None:
        if not self.lines or self.lines[-1].text or self.lines[-1].tags:
            self.lines.append(_Line(*self._state()))
        else:
            self.lines[-1].kept, self.lines[-1].inside = self._state()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag not in INLINE
        if block:
            self._imply(tag)
        kept, inside = self._state()
        values = dict(attrs)
        role = (values.get("role") or "").strip().lower()
        if tag in EXCLUDED or role in ROLES or "hidden" in values or (values.get("aria-hidden") or "").lower() == "true" or self._marked(tag, values):
            kept = False
        if tag in CONTAINERS and len(inside) < DEPTH:
            article = tag in ("article", "main") or role in ("main", "article") or (values.get("itemprop") or "").lower() == "articlebody"
            inside = (*inside, len(self.containers))
            self.containers.append((tag, article))
        if tag == "br":
            self.lines[-1].text.append(" ")
        outer = self._state()
        if tag not in VOID:
            self.open.append((tag, kept, inside))
        if block or kept != outer[0]:
            self._break()
        self.lines[-1].tags += 1

    @staticmethod
    def _marked(tag: str, values: dict) -> bool:
        if tag in ("html", "body"):
            return False
        found = _WORD.findall(f"{values.get('class') or ''} {values.get('id') or ''}".lower())
        return not (NESTED_MARKS if tag in ("article", "main") else MARKS).isdisjoint(found)

    def _imply(self, tag: str) -> None:
        """Ends that HTML leaves out: of a paragraph before a block, of an item before the next one."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == "p" or tag in _ENDS.get(name, ()):
                del self.open[k:]
                self._break()
                return
            if name in CONTAINERS or name in ("ul", "ol", "table", "dl"):
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash of <div/> counts for nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.lines[-1].text.append(" ")
        self.lines[-1].tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                outer = self._state()
                del self.open[k:]
                if tag not in INLINE or self._state() != outer:
                    self._break()
                return
        if tag == "p":
            self._break()

    def handle_data(self, data: str) -> None:
        if self.lines[-1].kept:
            self.lines[-1].text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of every ratio and its neighbours within three deviations."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def main_text(html: str | None) -> str:
    """The article of a page as lines of text."""
    parser = PageLines()
    parser.feed(html or "")
    parser.close()
    lines = [(text, max(1, x.tags), x.inside) for x in parser.lines if x.kept and (text := " ".join("".join(x.text).split()))]
    if not lines:
        return ""
    sizes = np.array([len(t) for t, _, _ in lines], float)
    ratios = smoothed(sizes / np.array([n for _, n, _ in lines]))
    content = ratios >= min(ratios.std(), ratios.max())
    region = _region(parser.containers, [inside for _, _, inside in lines], sizes * content)
    return "\n".join(t for t, _, inside in lines if region is None or region in inside)


def _region(containers: list[tuple[str, bool]], inside: list[tuple[int, ...]], weight: np.ndarray) -> int | None:
    """The container of the article, None for the whole page.

    The outermost article element with most content characters; without one, the
    innermost container with more than ``SHARE`` of them, widened while what it
    would add is mostly content.
    """
    held: dict[int, float] = {}
    parents: dict[int, tuple[int, ...]] = {}
    for around, w in zip(inside, weight.tolist()):
        for k, number in enumerate(around):
            held[number] = held.get(number, 0.0) + w
            parents[number] = around[:k]
    articles = [n for n in held if containers[n][1]]
    outer = [n for n in articles if not any(containers[p][1] for p in parents[n])]
    if outer:
        best = max(outer, key=lambda n: (held[n], -n))
        inner = [n for n in articles if best in parents[n] and containers[best][0] == "main" and held[n] > SHARE * held[best]]
        return min(inner, key=lambda n: (len(parents[n]), n), default=best)
    whole = float(weight.sum())
    fit = [n for n in held if held[n] > SHARE * whole]
    if not fit:
        return None
    chosen = max(fit, key=lambda n: (len(parents[n]), n))
    for wider in reversed(parents[chosen]):
        added = [w > 0 for around, w in zip(inside, weight.tolist()) if wider in around and chosen not in around]
        if added and 2 * sum(added) < len(added):
            break
        chosen = wider
    return chosen


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    Character references are decoded, white space within a block (line breaks
    included) becomes one space, and blocks are joined by one line feed; nothing is
    dropped for being short and nothing is cut. A null or empty page, and one
    without text, gives the empty string. Unclosed and stray tags are read as
    browsers do for paragraphs and list items; else an element ends with the one
    around it. Repeated rows and null ids give a row each, an empty table none.
    Very long pages are parsed whole, a page at a time. Other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch):
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = main_text(html.as_py())
                yield {"page_id": page_id, "url": url, "text": text, "n_chars": len(text)}

        return step

    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_rows(chosen, make, "page_id bigint, url string, text string, n_chars bigint", rows=128)
