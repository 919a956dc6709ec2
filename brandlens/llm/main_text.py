"""Main text of web pages by the distribution of text over lines.

Method. Markup is stripped: comments, raw-text elements and containers that are marked as
boilerplate (by element, role, class or id) go, and every block element begins a new line.
The lengths of the lines, without link text, are summed over a sliding window. The window
sums rise above a threshold at surge points and fall below it at dive points; the lines
between them are the bulk of the article. Surge and dive are then moved outwards: to the
bounds of the article or main element around most of the bulk, else of the innermost element
that holds every line of the bulk, so that headings and short paragraphs at its ends stay. If
that is the whole page, containers before the first surge and after the last dive go.
Character references are decoded, white space inside a block becomes one blank, and blocks are
joined by line ends.

A class or id marks boilerplate by a word in it, but an element that holds most of the page's
text is a wrapper, whatever its name: so is one with 80 % of the text (unless it is named for
comments), or with half of it and a heading, an article or a main element of its own.

Defined cases: null or empty html, and pages without text, give an empty text; an element
that is never closed ends where the next block (for p) or item (for li) begins, any other one
that is never closed is not taken for boilerplate; a `<` that begins no tag is text; rows are
handled one by one, so repeated rows and null columns pass through; other columns are ignored;
long pages are read whole, in time that grows with their length only.
"""

from __future__ import annotations

import bisect
import html
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, table

by_value(__name__)

WINDOW = 3
#: A window with this much text is part of the bulk, or with half of the page's largest sum.
SURGE = 90
#: Share of the bulk around which an article or main element is looked for.
HOLDS = 0.8
#: Shares of the page's text from which on a marked element is a wrapper.
WRAPS, WRAPS_HEADED = 0.8, 0.5

RAW = "script style noscript template iframe object svg math canvas audio video head".split()
BOILERPLATE = frozenset("nav footer aside form button select textarea dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu".split())
#: Words of a class or id that mark boilerplate.
MARKS = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations sidebar "
    "sidenav comment comments commentlist disqus replies respond menu menubar nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead pagination pager toolbar widget widgets hidden").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Holders inside each other that are told apart; deeper ones count as part of the last.
DEEPEST = 64
HOLDERS = frozenset("article main section div td body".split())
BLOCK = frozenset((
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p "
    "pre section summary table tbody td tfoot th thead title tr ul").split())

#: A quoted value may hold any sign; a tag never goes beyond another `<` outside of one.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in RAW}
COMMENT_MARKS = frozenset("comment comments commentlist disqus replies respond".split())
#: Decimal references that are beyond any character, and their leading zeros.
ZEROS, FAR = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_WORD = re.compile(r"[^a-z]+")


def decoded(text: str) -> str:
    """`text` with its character references decoded."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = FAR.sub("\ufffd", ZEROS.sub("&#", text))
    return html.unescape(text)


def marks(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its attributes, and whether it is however much it holds."""
    if not rest or rest == "/" or name in ("html", "body", "article", "main"):
        return False, False
    marked = False
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), (a or b or c).lower()
        if (key == "role" and value in ROLES or key == "hidden"
                or key == "style" and "display:none" in value.replace(" ", "")):
            return True, True
        if key in ("class", "id"):
            words = NOT_WORD.split(value)
            if not COMMENT_MARKS.isdisjoint(words):
                return True, True
            marked = marked or not MARKS.isdisjoint(words)
    return marked, False


def tags_of(page: str) -> list[tuple]:
    """(start, end, name, closing, rest) of every tag in order; name is "" for comments,
    declarations and raw-text elements. One pass, every sign looked at a bounded number of times."""
    found, at, last = [], 0, page.rfind(">")
    unclosed: set[str] = set()
    while True:
        start = page.find("<", at)
        if start < 0:
            return found
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            found.append((start, end, "", False, ""))
        elif start > last:
            return found
        elif page[start + 1:start + 2] in ("!", "?"):
            end = page.find(">", start) + 1
            found.append((start, end, "", False, ""))
        elif tag := TAG.match(page, start) or PLAIN_TAG.match(page, start):
            closing, name, rest = tag[1] == "/", tag[2].lower(), tag[3]
            end = tag.end()
            if not closing and name in RAW_END and name not in unclosed:
                closed = RAW_END[name].search(page, end)
                if closed:
                    end, name = closed.end(), ""
                else:
                    unclosed.add(name)
            found.append((start, end, name, closing, rest))
        else:
            end = start + 1
        at = end


def ends_of(tags: list[tuple]) -> dict[int, tuple[int, bool]]:
    """For each opening tag that ends: the number of the tag at its end, and whether that is its
    own closing tag. A p also ends where a block begins or its surroundings end, an li where the
    next item of its list begins or the list ends."""
    ends: dict[int, tuple[int, bool]] = {}
    open_of: dict[str, list[int]] = {}
    items: list[list[int]] = [[]]  # open li of each open list

    def imply(stack: list[int], number: int) -> None:
        if stack:
            ends[stack.pop()] = (number, False)

    for number, (_, _, name, closing, rest) in enumerate(tags):
        if not name:
            continue
        if name in BLOCK and not (closing and name == "p"):
            imply(open_of.setdefault("p", []), number)
        if name in ("ul", "ol"):
            if not closing:
                items.append([])
            elif len(items) > 1:
                imply(items.pop(), number)
        stack = items[-1] if name == "li" else open_of.setdefault(name, [])
        if closing:
            if stack:
                ends[stack.pop()] = (number, True)
        elif name not in VOID and not rest.endswith("/"):
            if name == "li":
                imply(stack, number)
            stack.append(number)
    return ends


def boilerplate(page: str, tags: list[tuple], ends: dict[int, tuple[int, bool]]) -> set[int]:
    """Numbers of the opening tags whose elements are no part of an article."""
    # text signs before each tag, a blank run counting as one
    before, total, at = [], 0, 0
    for start, end, *_ in tags:
        total += len(" ".join(page[at:start].split()))
        before.append(total)
        at = end
    total += len(" ".join(page[at:].split()))
    certain, likely, heads = [], [], []
    depth_in_article = 0
    for number, (_, _, name, closing, rest) in enumerate(tags):
        if name in ("article", "main"):
            depth_in_article = max(0, depth_in_article + (-1 if closing else 1))
        if closing or not name:
            continue
        if name in ("article", "main", "h1"):
            heads.append(number)
        if number not in ends:
            continue
        by_attribute, surely = marks(name, rest)
        if name in BOILERPLATE or (name == "header" and not depth_in_article) or surely:
            certain.append(number)
        elif by_attribute:
            likely.append(number)
    # signs outside of certain boilerplate, up to each tag
    gone, until, lost = [], -1, 0
    certain_at = set(certain)
    for number in range(len(tags)):
        gone.append(lost if number > until else lost - (before[until] - before[number]))
        if number in certain_at and number > until:
            until = ends[number][0]
            lost += before[until] - before[number]
    total -= lost
    out = set(certain)
    for number in likely:
        end = ends[number][0]
        held = (before[end] - gone[end]) - (before[number] - gone[number])
        first = bisect.bisect_right(heads, number)
        headed = first < len(heads) and heads[first] < end
        if held < (WRAPS_HEADED if headed else WRAPS) * total or not held:
            out.add(number)
    return out


def read_lines(page: str) -> tuple[list, list, list]:
    """Texts of the lines, their length without link text, and the holders of each (outermost
    first) as (number, name)."""
    tags = tags_of(page)
    ends = ends_of(tags)
    dropped = boilerplate(page, tags, ends)
    texts, plain, holders = [], [], []
    stack: list[tuple[int, str]] = []
    parts, linked, in_link = [], 0, False
    at, number = 0, 0

    def end_line() -> None:
        nonlocal linked
        text = " ".join(decoded("".join(parts)).split())
        if text:
            texts.append(text)
            plain.append(max(0, len(text) - linked))
            holders.append(tuple(stack))
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(" ".join(decoded(piece).split()))

    while number < len(tags):
        start, end, name, closing, rest = tags[number]
        add(page[at:start])
        at = end
        number += 1
        if not name:
            continue
        if name in BLOCK:
            end_line()
        if closing:
            if name == "a":
                in_link = False
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][1] == name:
                    del stack[depth:]
                    break
        elif name in VOID or rest.endswith("/"):
            continue
        elif number - 1 in dropped:
            end_line()
            number, own = ends[number - 1]
            at = tags[number][1] if own else tags[number][0]
            number += own
        elif name == "a":
            in_link = True
        elif name in HOLDERS and len(stack) < DEEPEST:
            stack.append((number - 1, name))
    add(page[at:])
    end_line()
    return texts, plain, holders


def bulk_lines(length: np.ndarray, window: int, surge: int) -> np.ndarray:
    """Which lines lie in a window between a surge and a dive point."""
    sums = np.convolve(length, np.ones(window))[window - 1:]  # from each line on
    high = np.flatnonzero(sums >= min(surge, max(1.0, sums.max() / 2)))
    bulk = np.zeros(len(length), bool)
    for k in range(window):
        bulk[np.minimum(high + k, len(length) - 1)] = True
    return bulk


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page."""
    texts, plain, holders = read_lines(page or "")
    if not texts:
        return ""
    length = np.array(plain, float)
    bulk = np.flatnonzero(bulk_lines(length, window, surge))
    if not len(bulk):
        return "\n".join(texts)
    # the article or main element around most of the bulk, else what holds all of it
    mass: dict[tuple, float] = {(): 0.0}
    for line in bulk.tolist():
        for depth in range(len(holders[line]) + 1):
            path = holders[line][:depth]
            mass[path] = mass.get(path, 0.0) + length[line]
    most = max((p for p in mass if mass[p] >= HOLDS * mass[()]), key=len)
    named = [d for kind in ("main", "article") for d in range(1, len(most) + 1) if most[d - 1][1] == kind]
    home = most[:named[-1]] if named else tuple(os.path.commonprefix([holders[k] for k in bulk.tolist()]))
    inside = [h[:len(home)] == home for h in holders]
    if not home or home[-1][1] == "body":
        # containers before the first surge and after the last dive go
        unit = [h[len(home)] if len(h) > len(home) else None for h in holders]
        first, last = unit.index(unit[bulk[0]], 0), len(unit) - 1 - unit[::-1].index(unit[bulk[-1]])
        first, last = min(first, bulk[0]), max(last, bulk[-1])
        inside = [own and (unit[k] is None or first <= k <= last) for k, own in enumerate(inside)]
    return "\n".join(t for t, own in zip(texts, inside, strict=True) if own)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of `pages`."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch["html"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], texts],
                                             ["page_id", "url", "text"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string")


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
