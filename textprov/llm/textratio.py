"""Main text of web pages by text-to-tag ratios.

A streaming standard-library parser turns a page into lines (the text between
block boundaries).  A line's ratio is its characters of running text, without
link text, over the tags seen in it.  Ratios are smoothed with a Gaussian over
the neighbouring lines and split in two clusters by a threshold between the
cluster means.  Menus, notices and other elements known by tag, role or class
have ratio 0 and are never content.  A class that only says something about a container
(``has-sidebar``, ``content header-fixed``, ``sidebar-layout``) makes the element doubtful: it is
left out only if it holds no more than half of the page's running text.  A ``br`` is white space
inside its block.  The elements (article, section, cell,
body ...) that hold lines of the upper cluster are the content regions; all
their lines are returned, so short paragraphs inside the article stay.  The ratios
choose on every page: an article element is one region among others, and is
only taken with its inner elements if it holds most of the upper cluster's
characters; regions of the upper cluster outside it stay.

Defined results: null or empty html gives an empty text and 0 characters;
repeated rows are extracted each by itself; an empty table gives an empty
result; other columns than ``keep`` play no part, whatever their names; equal ratios fall on one
side of the threshold together.  Whole pages are parsed, whatever their length, in time linear in
it, also where elements are nested thousands deep.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul title option""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("""script style noscript template head title nav footer aside form button select textarea svg
math iframe object canvas audio video dialog menu""".split())
REGION = frozenset("article main section div td body header html".split())
#: Words of class, id and role values that mark what is not the article.
MARKS = frozenset("""ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar
navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget
related recommended share sharing social comment comments commentlist reply replies response responses feedback
disqus discussion guestbook cookie cookies consent notice notification alert newsletter subscribe signup login popup modal overlay form search toolbar skip
copyright legal disclaimer pagination pager""".split())
#: First words of a class name that tell how its element looks or what stands beside it.
STATES = frozenset("has have with without no not is show shows hide hides hidden below above under".split())
#: Words of class names of containers.
CONTAINERS = frozenset("""content article post entry story main body page layout wrapper wrap container site grid row
column columns col""".split())
CLOSES_P = BLOCK - {"title", "option", "body", "html"}
P_STOPS = ("article", "main", "section", "div", "td", "li", "body")
LI_STOPS = ("ul", "ol", "menu")


def marked(value: str) -> str:
    """What the value of a class, id or role says of its element: ``noise``, ``doubt`` or nothing."""
    names = [re.findall(r"[a-z]+", x) for x in value.lower().split()]
    names = [x for x in names if x and x[0] not in STATES]
    marks = [x for x in names if not MARKS.isdisjoint(x)]
    if not marks:
        return ""
    beside = any(x[0] in CONTAINERS for x in names if MARKS.isdisjoint(x))
    return "doubt" if beside or all(x[-1] in CONTAINERS for x in marks) else "noise"


class _Lines(HTMLParser):
    """Collects (text, characters outside links, tags, region, article, doubtful element) per line; noise is skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []   # open element, whether it is noise, whether doubtful
        self.places: dict[str, list[int]] = {}          # per tag: where it stands on the stack
        self.noise = 0
        self.links = 0
        self.regions = [0]
        self.articles = [0]                       # per region: the article element it is in, or 0
        self.doubts = [0]                         # doubtful elements around, the innermost last
        self.outer = [0]                          # per doubtful element: the one around it
        self.count = 1
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        self.parts: list[str] = []
        self.plain = 0
        self.tags = 0

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.plain, self.tags, self.regions[-1], self.articles[-1], self.doubts[-1]))
            self.parts = []
        self.plain = self.tags = 0

    def _open(self, tag: str, noise: bool, doubt: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, noise, doubt))
        self.noise += noise
        self.links += tag == "a"
        if doubt:
            self.outer.append(self.doubts[-1])
            self.doubts.append(len(self.outer) - 1)
        if tag in REGION and not noise:
            self.regions.append(self.count)
            self.articles.append(self.count if tag == "article" else self.articles[-1])
            self.count += 1

    def _close(self) -> None:
        tag, noise, doubt = self.stack.pop()
        self.places[tag].pop()
        self.noise -= noise
        self.links -= tag == "a"
        if doubt:
            self.doubts.pop()
        if tag in REGION and not noise:
            self.regions.pop()
            self.articles.pop()

    def _last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _judge(self, attrs) -> str:
        found = ""
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true":
                return "noise"
            if value and name in ("class", "id", "role", "aria-label"):
                said = marked(value)
                if said == "noise":
                    return said
                found = found or said
        return found

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
        if tag == "br":
            if self.parts:
                self.parts.append(" ")
            return
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("article", "main", "body") and self.noise:
            # an element that was left open does not swallow the article
            while self.noise:
                self._close()
        if tag in CLOSES_P:
            self._end("p", stop=P_STOPS)
        if tag == "li":
            self._end("li", stop=LI_STOPS)
        noise = tag in NOISE or (tag == "header" and self._last("article", "main") < 0)
        said = "" if noise or tag in ("html", "body", "article", "main") else self._judge(attrs)
        self._open(tag, noise or said == "noise", said == "doubt")

    def _end(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        at = self._last(tag)
        if at >= 0 and at > self._last(*stop):
            while len(self.stack) > at:
                self._close()

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag(tag, ())  # as browsers do
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag not in VOID:
            self._end(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def handle_data(self, data):
        if not self.noise:
            self.parts.append(data)
            if not self.links:
                self.plain += len(data.strip())


def smooth(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian over the lines up to three standard deviations away, with weights that sum to 1."""
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(r + 1)]
    out = []
    for i in range(len(ratios)):
        num = den = 0.0
        for j in range(max(0, i - r), min(len(ratios), i + r + 1)):
            num += w[abs(i - j)] * ratios[j]
            den += w[abs(i - j)]
        out.append(num / den)
    return out


def threshold(values: list[float]) -> float:
    """Halfway between the means of the two clusters that the threshold makes (fixed point)."""
    t = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        if not low or not high:
            return t
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _settled(lines: list[tuple], outer: list[int]) -> list[tuple]:
    """The lines without those of doubtful elements that hold no more than half of the running text."""
    held = [0] * len(outer)
    for x in lines:
        held[x[5]] += x[1]
    for d in range(len(outer) - 1, 0, -1):  # an element comes after the one around it
        held[outer[d]] += held[d]
    stays = [True] * len(outer)
    for d in range(1, len(outer)):
        stays[d] = stays[outer[d]] and 2 * held[d] > held[0]
    return [x for x in lines if stays[x[5]]]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    p.cut()
    lines = _settled(p.lines, p.outer)
    if not lines:
        return ""
    ratios = smooth([plain / (tags + 1) for _, plain, tags, *_ in lines], sigma)
    t = threshold(ratios)
    chosen = [i for i, v in enumerate(ratios) if v >= t and lines[i][1]]
    regions = {lines[i][3] for i in chosen}
    held: dict[int, int] = {}
    for i in chosen:
        held[lines[i][4]] = held.get(lines[i][4], 0) + lines[i][1]
    most = max(held, key=held.get, default=0)
    whole = most if 2 * held.get(most, 0) > sum(held.values()) else 0
    return "\n".join(x[0] for x in lines if x[3] in regions or whole and x[4] == whole)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            sigma: float = SIGMA) -> DataFrame:
    """``keep`` columns, ``text`` (blocks joined by a newline) and ``n_chars`` (code points)."""

    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in col:
            yield pa.array([main_text(x.as_py(), sigma) for x in arr], pa.string())

    udf = F.arrow_udf(run, "string")
    return (pages.select(*[F.col(f"`{c}`") for c in keep], udf(F.col(f"`{html_col}`")).alias("text"))
            .select(*[F.col(f"`{c}`") for c in keep], "text", F.char_length("text").cast("long").alias("n_chars")))
