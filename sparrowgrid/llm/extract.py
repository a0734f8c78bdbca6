"""Main-text extraction from HTML by text-to-tag ratio.

The standard library's parser streams events.  Each run of text between block
tags is a line with its text length, its link text and the tags around it.
The ratios of text to tags are smoothed with a Gaussian over neighbouring
lines and split into two clusters.  The content region is the smallest
container that holds most of the upper cluster's text (and the headings that
stand right beside it); all its lines are kept in page order, so that short
paragraphs and headings between long ones stay.

Page furniture only assists: elements that HTML itself calls furniture (nav,
footer, form, ...) are no content, and a class name that speaks of furniture
tips the balance for a container that the ratios don't speak for: in the region
it goes only if its lines lie in the lower cluster or stand before or after all
other content, and never if it holds the region.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparrowgrid.llm.common import bounded

#: Share of the upper cluster's text that the content region holds.
MOST = 0.6
# Element names by their part in a page, and class names that mark furniture.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "textarea", "select"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "header"}
CONTAINERS = {"html", "body", "article", "main", "section", "div", "table", "blockquote", "ul", "ol", "dl", "figure", "details", "fieldset", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
BLOCKS = CONTAINERS | FURNITURE | HEADINGS | {
    "p", "li", "pre", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "dt", "dd",
    "hr", "br", "address", "figcaption", "summary", "legend", "option", "label", "input",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
NAMES = {
    "ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "header", "masthead", "footer", "sidebar", "side-bar", "widget", "cookie", "cookies", "cookie-notice", "cookie-banner",
    "consent", "notice", "notification", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "comments", "comment",
    "comment-list", "disqus", "replies", "respond", "share", "sharing", "social", "related", "related-posts", "recommended", "pagination",
    "pager", "toolbar",
}


class Events(HTMLParser):
    """Turns parser events into lines and the tree of containers they stand in.

    A line is (text, link characters, tags since the last line, container,
    whether it is a heading).  A container is (container around it, tag,
    whether it is furniture, whether a class name says so).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.containers: list[tuple[int, str, bool, bool]] = [(-1, "", False, False)]
        self.titled: list[int] = []  # containers of articles and page titles
        self.open: list[tuple[str, int]] = []  # tag, the container outside it
        self.counts: Counter = Counter()  # open elements by tag
        self.here = self.links = self.tags = self.link_chars = self.silent = self.heading = 0
        self.parts: list[str] = []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.link_chars, self.tags, self.here, self.heading > 0))
            self.tags = 0
        self.parts, self.link_chars = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS or tag in SILENT:
            self.flush()
        if tag in BLOCKS and tag != "br":
            while self.counts["head"]:  # its end can be left out
                self._close()
            if self.open and (self.open[-1][0] == "p" or self.open[-1][0] in HEADINGS):  # these end where the next block begins
                self._close()
        if tag == "a":
            self.links += 1
        if tag in VOID:
            return
        named = dict(attrs)
        hidden = "hidden" in named or named.get("aria-hidden") == "true"
        box = tag in CONTAINERS or tag in FURNITURE
        if not (box or hidden or tag in SILENT or tag in HEADINGS):
            return
        self.open.append((tag, self.here))
        self.counts[tag] += 1
        self.silent += tag in SILENT
        self.heading += tag in HEADINGS
        if box or hidden:
            # the heading of an article or a section is its own
            own = tag == "header" and self.counts["article"] + self.counts["main"] + self.counts["section"] > 0
            furniture = hidden or tag in FURNITURE and not own or (named.get("role") or "").lower() in ROLES
            said = f"{named.get('class') or ''} {named.get('id') or ''}".lower().split()
            self.containers.append((self.here, tag, furniture, not NAMES.isdisjoint(said)))
            self.here = len(self.containers) - 1
        if tag in ("article", "main", "h1"):
            self.titled.append(self.here)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS or tag in SILENT:
            self.flush()
        if tag == "a" and self.links:
            self.links -= 1
        if self.counts[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, self.here = self.open.pop()
        self.counts[tag] -= 1
        self.silent -= tag in SILENT
        self.heading -= tag in HEADINGS
        return tag

    def handle_data(self, data):
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, 0)  # HTML has no marked sections

    def finish(self):
        """The end of the page: plain text that is left counts, an unfinished tag or comment doesn't."""
        rest, self.rawdata = self.rawdata, ""
        if rest and not re.match(r"<[A-Za-z/!?]", rest):
            self.handle_data(unescape(rest))
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a window of three deviations, normalised at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(np.pad(ratios, reach), kernel, "valid")
    return padded / np.convolve(np.pad(np.ones(len(ratios)), reach), kernel, "valid")


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of the values (two-means, from the extremes); the least value if all are alike."""
    low, high = float(values.min()), float(values.max())
    if high <= 2 * low:
        return low
    for _ in range(50):
        border = (low + high) / 2
        upper = values >= border
        new = float(values[~upper].mean()) if (~upper).any() else low, float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _region(events: Events, weights: np.ndarray) -> int:
    """The smallest container that holds most of the lines' weight."""
    held, best = np.zeros(len(events.containers)), {}
    for (_, _, _, where, _), w in zip(events.lines, weights.tolist(), strict=True):
        held[where] += w
    for k in range(len(held) - 1, 0, -1):  # a container's number is larger than that of the one around it
        up = events.containers[k][0]
        held[up] += held[k]
        if up not in best or held[k] >= held[best[up]]:
            best[up] = k
    region = 0
    while region in best and held[best[region]] >= MOST * held[0]:
        region = best[region]
    return region


def extract(html: str | None) -> str:
    """The main text of one page; empty for null, for empty pages and for pages without text."""
    if not html:
        return ""
    events = Events()
    events.feed(html)
    events.finish()
    lines, containers = events.lines, events.containers
    # furniture and named containers, with all they hold; one that holds an article or a title isn't named
    titled = set()
    for k in events.titled:
        while k not in titled and k >= 0:
            titled.add(k)
            k = containers[k][0]
    furniture, named = [False], [False]
    for k, (up, _, own, said) in enumerate(containers[1:], 1):
        furniture.append(own or furniture[up])
        named.append(said and k not in titled or named[up])
    shown = np.array([not furniture[x[3]] for x in lines], bool)
    if not shown.any():
        return ""
    plain = shown & np.array([not named[x[3]] for x in lines])
    if not plain.any():
        plain = shown
    score = smoothed(np.array([max(0, len(text) - links) / (tags + 1) for text, links, tags, _, _ in lines]))
    upper = score >= threshold(score)
    seeds = np.flatnonzero(upper & plain)
    if not len(seeds):
        seeds = np.flatnonzero(plain)[[np.argmax(score[plain])]]
    weights = np.zeros(len(lines))
    weights[seeds] = [len(lines[i][0]) for i in seeds]
    region = _region(events, weights)
    around = [region]
    while around[-1] > 0:
        around.append(containers[around[-1]][0])
    region = next((k for k in around if containers[k][1] in ("article", "main")), region)
    inside = [k == region for k in range(len(containers))]
    for k in range(region + 1, len(containers)):
        inside[k] = inside[k] or inside[containers[k][0]]
    kept = shown & np.array([inside[x[3]] for x in lines])
    # headings right before the region belong to it, and so does content of the containers around it right beside it
    for step, i in ((-1, int(np.argmax(kept))), (1, len(kept) - 1 - int(np.argmax(kept[::-1])))):
        i += step
        while 0 <= i < len(lines) and (not shown[i] or plain[i] and (upper[i] and lines[i][3] in around or lines[i][4] and step < 0)):
            kept[i] = shown[i]
            i += step
    seeds = seeds[kept[seeds]]
    between = np.zeros(len(lines), bool)
    between[seeds[0] : seeds[-1] + 1] = True
    kept &= plain | between & upper
    return "\n".join(x[0] for x, keep in zip(lines, kept.tolist(), strict=True) if keep)


def main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``text`` (string, never null) and ``n_chars`` (its code points) added; every row stays.

    Null, empty and textless pages give an empty text; repeated rows are read
    alike; columns of ``df`` called ``text`` or ``n_chars`` are replaced.
    """
    keep = [c for c in df.columns if c not in ("text", "n_chars") or c == html]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for part in bounded(batches, html):
            texts = [extract(x) for x in part.column(part.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return df.select(*keep).mapInArrow(run, schema)
