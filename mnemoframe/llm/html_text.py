"""Main text of web pages by text-to-tag ratios.

Events of the standard library's parser stream into lines, one per block of the page: its
text, how much of it is link text, how many tags it holds, and where it lies.  Scripts, styles
and hidden parts yield no line.  The text-to-tag ratio per line is smoothed by a Gaussian along
the lines of its part of the page, and lines above a threshold form the content clusters.

Marks weigh the lines.  Containers that name themselves navigation, header, footer, sidebar,
notice, advert, form or comments (by tag, role, class or id) weigh nothing, or little where the
page has an <article>.  There everything outside of it weighs little, the logarithm of a ratio
counts, and the threshold is a small share of the page's highest value: an article's short lines
and link lists stay, while no advert's length makes up for its mark.  Without an <article>, links
count as no text and the threshold is the smaller of mean and standard deviation, over the lines
in <main> if there are any.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one space.  Null html gives an empty text, and so does a page
without content.  Markup that is cut off, unclosed or malformed is read as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.rows import in_small_batches

SIGMA = 2.0
LINK_SHARE = 0.5
MAIN, ASIDE = -1, -2
# where a page has an article: the weight of lines outside, and the share of the highest value
OUTSIDE, SHARE = 0.02, 0.08

# fixed values: element names of HTML, and the words by which pages name their parts
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split())
CONTAINERS = frozenset(
    "article aside body button details dialog div dl fieldset figure footer form head header "
    "html iframe main menu nav noscript object ol section select svg table template textarea "
    "ul".split())
LEFT_OUT = frozenset(
    "aside button dialog footer form head iframe menu nav noscript object select svg template "
    "textarea".split())
# these hold no article: one that begins in them shows that their end is missing
NO_ARTICLE = frozenset("button footer form head header menu nav select textarea".split())
SILENT = frozenset("script style title".split())
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising aside banner breadcrumb breadcrumbs "
    "comment comments consent cookie cookies disclaimer discussion disqus footer gdpr header login "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion recommended related replies reply respond "
    "responses search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split())
CONTENT_NAMES = frozenset("article post entry content story main".split())
_NAME = re.compile(r"[a-z0-9]+")
_CUT = re.compile(r"<[A-Za-z/!?]")
# scripts, styles and comments as wholes; a comment without an end lasts to the end of the page
_COMMENTS = re.compile(
    r"<(script|style)\b[^>]*>.*?(?:</\1\b|\Z)|<!--(?:-?>|.*?(?:--!?>|\Z))", re.S | re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _set_aside(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a container names itself as something other than content."""
    if tag in LEFT_OUT:
        return True
    for name, value in attributes:
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id"):
            for single in value.split():
                words = set(_NAME.findall(_CAMEL.sub("-", single).lower()))
                if words & NAMES and not words & CONTENT_NAMES:
                    return True
    return False


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" and (value or "").strip().lower() != "until-found"
               for name, value in attributes)


class PageLines(HTMLParser):
    """Collects lines: (text, characters outside links, characters in links, tags, part).

    The part is the number of the outermost article, ``MAIN``, 0 outside of both, or ``ASIDE``
    in a container that names itself as something other than content.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, set aside, part, hidden
        self.aside, self.article, self.articles, self.hidden = False, 0, 0, False
        self.silent = self.link = 0
        self._fresh()

    def _fresh(self) -> None:
        self.pieces: list[str] = []
        self.linked, self.tags = 0, 0

    def end_line(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                linked = min(self.linked, len(text))
                self.lines.append((text, len(text) - linked, linked, max(self.tags, 1),
                                   ASIDE if self.aside else self.article))
        self._fresh()

    def _enter(self, tag: str, attributes: list) -> None:
        if tag in ("article", "main", "body") and not _set_aside(tag, attributes):
            # what a part before the article left open does not reach into it
            left = [at for at, (name, aside, *_) in enumerate(self.open) if aside and name in NO_ARTICLE]
            if left:
                del self.open[left[0]:]
        _, above_aside, above_article, hidden = self.open[-1] if self.open else ("", False, 0, False)
        article = above_article
        if tag == "article" and article <= 0:
            self.articles += 1
            article = self.articles
        elif tag == "main" and not article:
            article = MAIN
        aside = above_aside or _set_aside(tag, attributes) or tag == "header" and not article
        _, self.aside, self.article, self.hidden = top = (
            tag, aside, 0 if aside else article, hidden or _hidden(attributes))
        self.open.append(top)
        self.link = 0

    def _leave(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break
        _, self.aside, self.article, self.hidden = (
            self.open[-1] if self.open else ("", False, 0, False))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in CONTAINERS:
            self.end_line()
        self.tags += 1
        if tag in SILENT:
            self.silent += 1
        elif tag == "a":
            self.link = 1
        if tag in CONTAINERS:
            self._enter(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in CONTAINERS:
            self.end_line()
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.link = 0
        if tag in CONTAINERS:
            self._leave(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden or self.silent:
            return
        self.pieces.append(data)
        if self.link:
            self.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Read a marked section that HTML does not know as a comment."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean along the lines; at the ends, of the lines there are."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = lambda x: np.convolve(x, kernel)[reach:reach + len(x)]
    return whole(ratios) / whole(np.ones(len(ratios)))


def line_values(lines: list[tuple[str, int, int, int, int]]) -> tuple[np.ndarray, float]:
    """Smoothed and weighted ratio of every line, and the threshold for them."""
    own, linked, tags, part = (np.array([line[k] for line in lines]) for k in (1, 2, 3, 4))
    marked = part > 0
    if marked.any():
        ratios = np.log1p(np.where(marked, own + linked, own) / tags)
        weights = np.where(marked, 1.0, OUTSIDE)
    else:
        ratios = own / tags
        weights = np.where(part == part[part != ASIDE].min(initial=0), 1.0, 0.0)
    values = np.empty(len(lines))
    for one in np.unique(part):
        values[part == one] = smoothed(ratios[part == one])
    values *= weights
    if marked.any():
        return values, SHARE * values.max()
    inside = values[weights > 0]
    return values, min(inside.mean(), inside.std()) if len(inside) > 1 else 0.0


def content_lines(lines: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """Which lines are content: clusters of values over the threshold.

    On a page without an article, a line that is mostly links is none.
    """
    own, linked, part = (np.array([line[k] for line in lines]) for k in (1, 2, 4))
    values, threshold = line_values(lines)
    linky = (linked > LINK_SHARE * (own + linked)) & ~(part > 0).any()
    return (values >= threshold) & (values > 0) & ~linky


def _whole_markup(html: str) -> str:
    """The page without comments, and without a comment or tag that its end cuts off."""
    html = _COMMENTS.sub(lambda m: m[0] if m[1] else "", html)
    tag = html.rfind("<")
    return html[:tag] if tag > html.rfind(">") and _CUT.match(html, tag) else html


def main_text(html: str | None) -> str:
    """The main text of one page."""
    parser = PageLines()
    parser.feed(_whole_markup(html or ""))
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    keep = content_lines(parser.lines)
    return " ".join(line[0] for line, kept in zip(parser.lines, keep) if kept)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(map(main_text, batch.column("html").to_pylist()), pa.string())
            n_chars = pc.cast(pc.utf8_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), texts, n_chars],
                names=["page_id", "url", "text", "n_chars"])

    narrow = in_small_batches(pages).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
