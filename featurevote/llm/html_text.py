"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of the page, each with the length of its text. What
markup names as something else (menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts) and lines that are mostly links become gaps: empty lines as wide as a window. Lengths are
summed over a sliding window of lines. A surge is a line with text where the sum exceeds a threshold,
a dive the next point where the window has no text left. Everything between a surge and its dive
is kept, together with the lines that join onto it without a gap. Shorter stretches are kept if any
container around them, the page included, also holds such a region, as where an advert interrupts an
article.

A main element with text is the main region, to which everything is limited; otherwise the articles
are, if they hold at least as much text in surges as the rest. If they hold less, several of them are
repeated units such as comments and teasers, and left out. Inside a main region links are text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from featurevote.llm.common import map_texts

WINDOW = 3
SURGE = 80
LINK_SHARE = 0.5
MIN_LINK_CHARS = 1

# Comments, declarations, elements whose content is no text, and single tags. An unended comment,
# script or tag reaches to the end of the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|textarea|title|svg|math|iframe|object|select|canvas|audio|video|noembed|noframes|noscript)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
# Element names by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER = frozenset("nav header footer aside form button menu dialog fieldset head".split())
CONTAINERS = frozenset("article main section div td center blockquote".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
# Words of class and id attributes.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottombar "
    "sidebar aside widget widgets related recommended recommendations share sharing social newsletter subscribe "
    "subscription signup login cookie cookies consent notice notices popup modal overlay paywall "
    "comment comments commentlist reply replies disqus respond pagination pager toolbar search form copyright legal".split()
)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def is_other(tag: str, attributes: str) -> bool:
    """Whether an element's markup says that it is no part of the main text."""
    if tag in OTHER:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for found in NAMED.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in OTHER_ROLES:
            return True
        if name in ("class", "id") and any(w.lower() in OTHER_WORDS for w in WORD.findall(value)):
            return True
    return False


class Line(NamedTuple):
    text: str
    other: bool  # markup says that it is no main text
    by_links: bool
    containers: tuple[int, ...]  # all around it, outermost first, the page as 0
    region: tuple[str, int] | None  # tag and number of the outermost main or article around it


def page_lines(page: str) -> list[Line]:
    """The text of each block in page order, white space turned into single spaces, with its place.
    Blocks without text are left out."""
    lines: list[Line] = []
    open_containers: list[tuple[str, int]] = []
    n_containers = 0
    parts: list[str] = []
    linked = 0
    stack: list[str] = []  # open elements inside of the outermost one that is no main text
    inside_link = False
    main_depth, n_regions = 0, 0
    region: tuple[str, int] | None = None

    def end_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            by_links = linked >= MIN_LINK_CHARS and linked > LINK_SHARE * len(text)
            around = (0, *(number for _, number in open_containers))
            lines.append(Line(text, bool(stack), by_links, around, region if main_depth else None))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if inside_link:
            linked += len(text.strip())

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            if token[1] and token[1].lower() not in INLINE:
                end_block()
            continue
        closing = token[2] == "/"
        if tag == "a":
            inside_link = not closing
        if tag in INLINE and not stack and (closing or not is_other(tag, token[4])):
            continue
        if tag not in INLINE:
            end_block()
        if tag in VOID:
            continue
        if stack:
            if not closing:
                stack.append(tag)
            elif tag in stack:
                while stack.pop() != tag:
                    pass
            elif tag in ("article", "main", "body", "html"):
                stack.clear()
        elif not closing and is_other(tag, token[4]) and not (tag == "header" and main_depth):
            end_block()
            stack.append(tag)
        elif tag in CONTAINERS:
            if not closing:
                n_containers += 1
                open_containers.append((tag, n_containers))
            elif any(t == tag for t, _ in open_containers):
                while open_containers.pop()[0] != tag:
                    pass
        if tag in ("article", "main") and (closing or not stack):
            if main_depth == 0 and not closing:
                n_regions += 1
                region = (tag, n_regions)
            main_depth = max(0, main_depth + (-1 if closing else 1))
            inside_link = False
    if at < len(page):
        add(page[at:])
    end_block()
    return lines


def stretches(page: list[Line], may: Callable[[Line], bool], window: int) -> list[tuple[int, list[Line]]]:
    """The largest window sum and the lines of each stretch of lines that may be main text; others are gaps."""
    lines: list[Line | None] = []
    for line in page:
        if may(line):
            lines.append(line)
        elif lines and lines[-1]:
            lines += [None] * window
    lines += [None] * window
    sizes = [len(line.text) if line else 0 for line in lines]
    found: list[tuple[int, list[Line]]] = []
    start, high, total = None, 0, sum(sizes[:window])
    for k, size in enumerate(sizes):
        if start is None and size:
            start, high = k, 0
        if start is not None:
            high = max(high, total)
            if total == 0:  # a dive
                found.append((high, [line for line in lines[start:k] if line]))
                start = None
        total += (sizes[k + window] if k + window < len(sizes) else 0) - size
    if start is not None:
        found.append((high, [line for line in lines[start:] if line]))
    return found


def main_rule(page: list[Line], window: int, surge: int) -> Callable[[Line], bool]:
    """Which lines may be main text."""

    def inside(line: Line) -> bool:
        return not line.other and line.region is not None and line.region[0] in tags

    def outside(line: Line) -> bool:
        return not line.other and not line.by_links and line.region is None

    def anywhere(line: Line) -> bool:
        return not line.other and not line.by_links

    def surges(may: Callable[[Line], bool]) -> int:
        return sum(len(line.text) for high, part in stretches(page, may, window) if high >= surge for line in part)

    regions = {line.region for line in page if not line.other and line.region is not None}
    if not regions:
        return anywhere
    tags = {"main"} if any(tag == "main" for tag, _ in regions) else {"article"}
    if tags == {"main"} or surges(inside) >= surges(outside):
        return inside
    return outside if len(regions) > 1 else anywhere


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page, its blocks joined by spaces; empty for a missing or empty page."""
    if not page:
        return ""
    lines = page_lines(page)
    may = main_rule(lines, window, surge)
    found = stretches(lines, may, window)
    if not found:
        return ""
    kept = [part for high, part in found if high >= surge] or [max(found, key=lambda f: f[0])[1]]
    # A page that is the only container around both counts as well, but not around a main region.
    limited = {line.region for part in kept for line in part}
    around = {c for part in kept for line in part for c in line.containers}
    if None not in limited:
        around.discard(0)
    own = {id(part) for part in kept}
    joined = [p for _, p in found if id(p) in own or any(not around.isdisjoint(line.containers) for line in p)]
    return " ".join(line.text for part in joined for line in part)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", window: int = WINDOW, surge: int = SURGE
) -> DataFrame:
    """(id, text, n_chars) of every page; n_chars counts code points.

    A missing or empty page gives an empty text, and so does one without main text; where no region
    reaches the threshold, the one with the most text is kept. Pages are independent: repeated rows give
    repeated rows, an empty table an empty one, and other columns are left behind.
    """

    def start():
        def work(texts):
            found = [main_text(t, window, surge) for t in texts]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return work

    return map_texts(pages, id_col, html_col, [StructField("text", StringType()), StructField("n_chars", LongType())], start)
