"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events once. Block elements cut the text into lines;
every line counts its characters, the tags inside it, its link text and the region it lies in, the
nearest enclosing section-like element. Lines of parts that say what they are (menus, page headers
and footers, sidebars, notices, adverts, forms, scripts, reader comments) never count as text. The
text-to-tag ratios of the lines are smoothed by a Gaussian along the page and clustered around a
threshold, the pooled mean between the two clusters; a region with a line above it is content, and
gives all its lines in page order, so that short paragraphs and headings of an article stay. That
decides on every page. A marked article only bounds the choice, unless the regions chosen outside of
it hold more characters, as a body in plain elements beside teaser cards does. Where it bounds,
regions outside go, and marked regions stay unless links make up most of their characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
MAX_LINK_SHARE = 0.5
MIN_UNMARKED = 100  # characters chosen outside a marked article that may outweigh it

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
_REGIONS = {"article", "main", "section", "div", "td", "body", "center", "details"}
_ARTICLES = {"article", "main"}
_DROPPED = {
    "script", "style", "head", "title", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video",
    "nav", "menu", "aside", "footer", "form", "button", "select", "textarea", "fieldset", "dialog", "search", "noframes",
}
_DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "masthead", "menu", "nav", "navbar",
    "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "replies", "respond",
    "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
}
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
# parts of readers: they may be longer than the article
_COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "respond"}
_BARRIERS = ("ul", "ol", "dl", "table", "menu", "div", "select")
_CLOSES_P = _BLOCKS - {"body", "html", "head", "option", "optgroup", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "summary"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class _Lines(HTMLParser):
    """Collects lines as (text, tags, link characters, region, in a marked article).

    A tag, role or attribute that makes an element no text drops it at once. A class or id that names
    it as such is weak evidence: the element is dropped when the page ends, unless it holds an article
    or main that isn't so named, or more than half of the text and isn't named as comments.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.owner: list[int] = []  # of every line, the innermost named element, or -1
        self.named: list[list] = []  # parent named element, named as comments, holds an article
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.stack: list[tuple[str, bool, int, int]] = []  # name, dropped from here on, region, named element
        self.open: dict[str, list[int]] = {}  # places in the stack
        self.regions = 0
        self.article_depth = 0

    def _flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                region = self.stack[-1][2] if self.stack else 0
                self.lines.append((line, self.tags, self.linked, region, self.article_depth > 0))
                self.owner.append(self.stack[-1][3] if self.stack else -1)
        self.text, self.tags, self.linked = [], 0, 0

    def _dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _DROPPED or tag == "header" and not self.article_depth:
            return True
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value and value.lower() in _DROPPED_ROLES:
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether a class or id names the element as no text, and whether as comments."""
        found = comments = False
        if tag not in ("body", "html", "main"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    for token in value.lower().split():
                        parts = set("".join(c if c.isalnum() else " " for c in token).split())
                        if tag in _ARTICLES and len(parts) > 1 and not token.startswith("comment-"):
                            continue  # says something of the article, not what it is
                        found = found or bool(parts & _DROPPED_WORDS) or "header" in parts and not self.article_depth
                        comments = comments or token in _COMMENT_WORDS or token.startswith("comment-")
        return found, comments

    def _pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name].pop()
        self.article_depth -= name in _ARTICLES
        return name

    def _close(self, tag: str) -> None:
        while self.open.get(tag) and self._pop() != tag:
            pass

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self._flush()
            if tag in _CLOSES_P and self.open.get("p"):
                self._close("p")
            for sibling in _SIBLINGS.get(tag, ()):
                # an unclosed item ends where the next one of the same list begins
                last = self.open.get(sibling)
                if last and last[-1] > max((self.open[b][-1] for b in _BARRIERS if self.open.get(b)), default=-1):
                    self._close(sibling)
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        dropped = self.stack[-1][1] if self.stack else False
        region = self.stack[-1][2] if self.stack else 0
        owner = self.stack[-1][3] if self.stack else -1
        if not dropped and self._dropped(tag, attrs):
            self._flush() if tag not in ("script", "style") else None
            dropped = True
        elif not dropped:
            named, comments = self._named(tag, attrs)
            if named:
                self._flush()
                self.named.append([owner, comments, False])
                owner = len(self.named) - 1
            elif tag in _ARTICLES:
                above = owner
                while above >= 0 and not self.named[above][2]:
                    self.named[above][2] = True
                    above = self.named[above][0]
        if tag in _REGIONS:
            self.regions += 1
            region = self.regions
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, dropped, region, owner))
        self.article_depth += tag in _ARTICLES

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self._flush()
        if self.open.get(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        self.text.append(data)
        if self.open.get("a"):
            self.linked += len(data)

    def finish(self) -> list[tuple[str, int, int, int, bool]]:
        self.close()
        self._flush()
        if not self.named:
            return self.lines
        held = [0] * len(self.named)
        for line, owner in zip(self.lines, self.owner):
            if owner >= 0:
                held[owner] += len(line[0])
        for at in range(len(self.named) - 1, -1, -1):  # inner ones come later
            if self.named[at][0] >= 0:
                held[self.named[at][0]] += held[at]
        half = sum(len(line[0]) for line in self.lines) / 2
        gone = [False] * len(self.named)
        for at, (parent, comments, article) in enumerate(self.named):
            gone[at] = parent >= 0 and gone[parent] or not article and (comments or held[at] <= half)
        return [line for line, owner in zip(self.lines, self.owner) if owner < 0 or not gone[owner]]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with weights renormalised at both ends."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The value midway between the means of the two clusters it separates (found by iteration)."""
    cut = float(values.mean())
    for _ in range(32):
        high, low = values[values > cut], values[values <= cut]
        following = float((high.mean() + low.mean()) / 2) if len(high) and len(low) else cut
        if following == cut:
            break
        cut = following
    return cut


def _lines(html: str) -> list[tuple[str, int, int, int, bool]]:
    parser = _Lines()
    parser.feed(html)
    return parser.finish()


def main_text(html: str | None) -> str:
    """The blocks of a page's main text, joined by newlines."""
    try:
        lines = _lines(html or "")
    except AssertionError:  # the parser gives up on an unknown marked section; read it as text
        lines = _lines(html.replace("<![", "&lt;!["))
    if not lines:
        return ""
    chars = np.array([len(x[0]) for x in lines], float)
    linked = np.array([x[2] for x in lines], float)
    ratio = smoothed(chars / (1 + np.array([x[1] for x in lines], float)))
    good = (ratio >= min(threshold(ratio), float(ratio.max()))) & (linked <= MAX_LINK_SHARE * chars)
    chosen = {x[3] for x, ok in zip(lines, good) if ok}
    regions = np.array([x[3] for x in lines])
    inside = np.array([x[4] for x in lines])
    taken = np.isin(regions, list(chosen))
    if inside.any() and chars[taken & ~inside].sum() < max(MIN_UNMARKED, chars[taken & inside].sum()):
        # inside the marks a region goes only as a list of links; its ratio may be low beside a longer one
        total, links = np.bincount(regions, chars), np.bincount(regions, linked)
        taken = inside & (taken | (links <= MAX_LINK_SHARE * total)[regions])
    return "\n".join(x[0] for x, ok in zip(lines, taken) if ok)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`.

    Null and empty html give an empty text. Cut-off markup is read as far as it goes. Rows are
    independent; repeated rows, null ids and null urls pass. Other columns are ignored. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
