"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one for each block element with text, and an empty one for each tag of
an element that only groups others (div, section, ul, table, ...) and for each removed frame (menu,
header, footer, sidebar, form, advert, notice, reader comments). A line weighs its characters
outside links; scripts, styles and hidden elements leave nothing. Blocks of ``window`` neighbouring
lines are summed. The text surges at the first line whose block reaches ``threshold``; it dives at
the next empty line whose block is under ``dive``. The text between a surge and its dive is a run, with
a heading that a block before the surge holds. The run with the most text is the main text, together
with runs of at least ``share`` of its length, which another element cut off. A page without a surge
keeps the stretch of lines with the most text.

Where the page marks articles, each article is a run, whole but for its frames, and other lines are
no text. Where it marks a ``main`` element only, other lines take no part.

Cases: a null or empty page gives an empty text and 0 characters; broken or cut-off markup is read
as far as it goes; equal rows each give a row; a null page_id or url is kept; other columns are
ignored. Blocks keep their order and are joined by one space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import known_id, null_ids, table

WINDOW, THRESHOLD, DIVE, SHARE = 3, 80, 20, 0.3
SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements whose whole content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select button textarea audio video datalist map".split())
#: Elements that hold a page's frame rather than its article.
FRAME = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Elements that start and end a line.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks with text of their own; the tags of other blocks leave an empty line.
LEAF = frozenset("address blockquote br dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li option p pre summary td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark a frame.
FRAME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo\w*|related|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>\"[^\"]*\"|'[^']*'|[^<>])*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_BLANK = re.compile(r"\s+")
#: Where an unclosed element ends at the latest: its closing tag is implied by these.
_CLOSED_BY = {"p": BLOCK - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}


def _frames(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in FRAME:
        # An article may have a header of its own, which holds its title.
        return not (tag == "header" and inside_article)
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    names = " ".join(m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes))
    return bool(names and FRAME_WORDS.search(names)) or bool(_HIDDEN.search(attributes))


class Line(NamedTuple):
    """A line of a page: its characters outside links, the number of its article (0: none), and where it stands."""

    text: str
    weight: int
    article: int
    main: bool
    heading: bool


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each opens a frame
    frames = articles = mains = links = linked = headings = number = 0
    at, size = 0, len(page)

    def add(part: str) -> None:
        nonlocal linked
        parts.append(part)
        linked += len(_BLANK.sub(" ", html.unescape(part))) if links else 0

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text and not frames:
                lines.append(Line(text, max(0, len(text) - linked), number if articles else 0, mains > 0, headings > 0))
            parts.clear()
            linked = 0

    def gap() -> None:
        if not frames:
            lines.append(Line("", 0, number if articles else 0, mains > 0, False))

    def close(depth: int) -> None:
        nonlocal frames, articles, mains, links, headings
        for name, framed in reversed(stack[depth:]):
            if framed:
                end_line()
            frames -= framed
            articles -= name == "article"
            mains -= name == "main"
            links -= name == "a"
            headings -= name in HEADING
            if framed or name in BLOCK - LEAF:
                gap()
        del stack[depth:]

    while at < size:
        m = _MARK.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            end_line()
        if m[1]:  # a closing tag; one that closes nothing is ignored
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
        elif tag in SILENT:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            if tag == "head":  # the rest of the head is read like other silent elements, but may lack its end
                end = end or re.compile(r"(?=<body)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            if stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
            framed = _frames(tag, m[3], articles > 0)
            if framed:
                end_line()
            elif tag in BLOCK - LEAF:
                gap()
            stack.append((tag, framed))
            frames += framed
            number += tag == "article" and not articles
            articles += tag == "article"
            mains += tag == "main"
            links += tag == "a"
            headings += tag in HEADING
    end_line()
    return lines


def runs(weights: np.ndarray, empty: np.ndarray, window: int = WINDOW, threshold: int = THRESHOLD, dive: int = DIVE) -> list[tuple[int, int]]:
    """First line and end of each stretch from a surge to its dive."""
    total = np.concatenate([[0], np.cumsum(weights), np.full(window - 1, weights.sum())])
    sums = total[window:] - total[: len(weights)]  # of each line and those after it
    surges, dives = np.flatnonzero(sums >= threshold), np.flatnonzero(empty & (sums < min(dive, threshold)))
    found, at = [], 0
    while (i := np.searchsorted(surges, at)) < len(surges):
        start = int(surges[i])
        j = np.searchsorted(dives, start)
        at = int(dives[j]) if j < len(dives) else len(weights)
        found.append((start, at))
    return found


def articles(lines: list[Line]) -> list[tuple[int, int]]:
    """First line and end of each marked article that has text."""
    bounds: dict[int, tuple[int, int]] = {}
    for i, x in enumerate(lines):
        if x.article and x.text:
            bounds[x.article] = (bounds.get(x.article, (i, i))[0], i + 1)
    return list(bounds.values())


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD, dive: int = DIVE, share: float = SHARE) -> str:
    lines = lines_of(page or "")
    found = articles(lines)
    if not found:
        if any(x.main and x.text for x in lines):
            lines = [x for x in lines if x.main]
        weights, empty = np.array([x.weight for x in lines], dtype=np.int64), np.array([not x.text for x in lines], dtype=bool)
        # Without a surge every stretch is a run.
        found = runs(weights, empty, window, threshold, dive) or runs(np.where(empty, 0, weights + 1), empty, window, 1, 1)
        for i, (start, end) in enumerate(found):  # a heading shortly before the surge is its title
            low = max(start - window, found[i - 1][1] if i else 0)
            found[i] = (next((at for at in range(low, start) if lines[at].heading), start), end)
    if not found:
        return ""
    sizes = [(sum(x.weight for x in lines[a:b]), sum(len(x.text) for x in lines[a:b])) for a, b in found]
    most = max(range(len(found)), key=lambda i: (*sizes[i], -i))
    kept = [run for i, run in enumerate(found) if i == most or sizes[i][0] >= max(threshold, 1, share * sizes[most][0])]
    return " ".join(x.text for a, b in kept for x in lines[a:b] if x.text)


def extract(pages: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD, dive: int = DIVE, share: float = SHARE) -> DataFrame:
    """Main text of every page; one pass without a shuffle."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x, window, threshold, dive, share) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    rows_in = pages.select(known_id("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return null_ids(rows_in.mapInPandas(rows, SCHEMA), "page_id")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
