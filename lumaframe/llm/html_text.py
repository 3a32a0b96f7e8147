"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.memo import claim
from lumaframe.llm.shared import small_batches

WINDOW = 3
SURGE = 86
SHARE = 0.25
OUTSIDE = 0.35
SCHEMA = "page_id long, url string, text string"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

#: Element names of HTML by their part in a page.
RAW = frozenset("script style title textarea noscript iframe template svg math object canvas audio video select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav footer aside form button dialog menu head input label fieldset".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("body div section td center details".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article: of paragraphs those of ADS; those of MILD do not if a word of BODY is there too.
STRONG = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar sidebars ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond login signin search searchbox searchform pagination pager toolbar widget widgets banner masthead topbar skip copyright disclaimer".split())
ITEMS = frozenset("li dt dd".split())
ADS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr".split())
MILD = frozenset("header head meta byline tags form aside legal top bottom".split())
BODY = frozenset("article content main post entry story body text".split())
NOT = frozenset("no has with without is".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Line(NamedTuple):
    """A block of the page: its text, that text's length outside links, whether markup says that it isn't the article,
    the article or container that holds it, whether that is an article, whether the block is a paragraph or alike (of list items: not a link)."""

    text: str
    own: int
    chrome: bool
    group: int
    marked: bool
    paragraph: bool


def chrome(name: str, attributes: str) -> bool:
    """Whether the element holds what is not the article, by its name, role, class and id. Paragraphs and alike are
    only told by the words of ADS: an article may have its notes and alerts."""
    if name in CHROME:
        return True
    if not attributes or name in ("html", "body") or name in CONTENT:
        return False
    strong, mild = (ADS, frozenset()) if name in PARAGRAPHS else (STRONG, MILD)
    for key, *values in NAMES.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role":
            if value.lower().strip() in ROLES:
                return True
        elif key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in WORD.findall(one)]
                if words and words[0] in NOT:
                    continue
                if not strong.isdisjoint(words) or not mild.isdisjoint(words) and BODY.isdisjoint(words):
                    return True
    return False


def lines_of(html: str) -> list[Line]:
    """The page's blocks in order. Scripts, styles and other elements without page text are left out.

    An element ends with its end tag or with that of an element around it, a paragraph where a block begins; an end
    tag of nothing that is open does nothing. The time is linear in the tags.
    """
    out: list[Line] = []
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # name, chrome, group, inside an article
    opened: Counter = Counter()
    parts: list[str] = []
    linked = off = links = at = groups = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                name, _, group, marked = stack[-1]
                own = max(0, len(text) - linked)
                out.append(Line(text, own, off > 0, group, marked, name in PARAGRAPHS and (name not in ITEMS or 2 * own >= len(text))))
            parts.clear()
            linked = 0

    def leave() -> None:
        nonlocal off
        name, bad, _, _ = stack.pop()
        opened[name] -= 1
        off -= bad

    def say(raw: str) -> None:
        nonlocal linked
        raw = unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if links:
            linked += len(raw)

    while m := TOKEN.search(html, at):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if slash else 1
        elif slash:
            if name in BLOCKS or opened[name]:
                if name in BLOCKS or any(x[1] for x in stack[-1:]):
                    flush()
                if opened[name]:
                    while stack[-1][0] != name:
                        leave()
                    leave()
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else len(html)
        else:
            block = name in BLOCKS
            if block:
                flush()
                links = 0
                while stack[-1][0] == "p":
                    leave()
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
                    leave()
            elif not attributes and name not in CHROME:
                continue
            if name in VOID:
                continue
            bad = chrome(name, attributes) or name == "header" and not stack[-1][3]
            if block or bad:
                if bad and not block:
                    flush()
                _, _, group, marked = stack[-1]
                if name in CONTENT or not marked and name in CONTAINERS:
                    groups += 1
                    group = groups
                stack.append((name, bad, group, marked or name in CONTENT))
                opened[name] += 1
                off += bad
    if at < len(html):
        say(html[at:])
    flush()
    return out


def weights(lines: list[Line]) -> list[float]:
    """How much of the article a block may be: its text outside links; none of chrome, and less outside the articles of a page that has one."""
    marked = any(x.marked and not x.chrome for x in lines)
    return [0.0 if x.chrome else x.own * (1.0 if x.marked or not marked else OUTSIDE) for x in lines]


def regions_of(weight: list[float], threshold: float) -> list[tuple[int, int]]:
    """[surge, dive) pairs: a region begins with a window of WINDOW blocks over the threshold, and ends where one is empty."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    out, i = [], 0
    while i < len(sums):
        if sums[i] <= threshold:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] > 0:
            j += 1
        out.append((i, j))
        i = j
    return out


def main_text(html: str) -> str:
    """Text between the points where it surges and where it dives.

    Over windows of WINDOW blocks the weights are summed. A region begins with a window of more than SURGE characters
    (of a quarter of the highest window if that is less) and ends where a window is empty; a region with under SHARE of
    the largest one's weight isn't the article. The containers that hold the regions' text are the article's home: those with
    SHARE of what the largest holds, or, of elements named article or main, with text over the threshold. If
    the home is such elements, what stands elsewhere goes; otherwise only short blocks elsewhere at a region's ends do. Paragraphs
    and alike at home belong to the article wherever they stand, so that no short last paragraph is lost behind links.
    """
    lines = lines_of(html)
    weight = weights(lines)
    top = max((sum(weight[i : i + WINDOW]) for i in range(len(weight))), default=0)
    if not top:
        return "\n".join(x.text for x in lines if x.marked and not x.chrome)
    threshold = min(SURGE, top * SHARE)
    found = regions_of(weight, threshold)
    masses = [sum(weight[i:j]) for i, j in found]
    core = [r for r, mass in zip(found, masses, strict=True) if mass >= SHARE * max(masses)]
    held: dict[tuple[int, bool], float] = {}
    for i, j in core:
        for k in range(i, j):
            at = (lines[k].group, lines[k].marked)
            held[at] = held.get(at, 0) + weight[k]
    most, sure = max(held.values()), max(held, key=held.get)[1]
    homes = {group for (group, marked), mass in held.items() if mass >= SHARE * most or marked and sure and mass > threshold}
    keep = {k for k, x in enumerate(lines) if x.group in homes and x.paragraph}
    for i, j in core:
        while not weight[i]:  # a window reaches over blocks without text of their own
            i += 1
        while not weight[j - 1]:
            j -= 1
        if sure:
            keep.update(k for k in range(i, j) if lines[k].group in homes)
            continue
        foreign = lambda k: lines[k].group not in homes and weight[k] < threshold
        while i < j and foreign(i):
            i += 1
        while i < j and foreign(j - 1):
            j -= 1
        keep.update(range(i, j))
    return "\n".join(lines[k].text for k in sorted(keep) if not lines[k].chrome)


def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("")
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string())], schema=ARROW)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page, from its whole html (null: empty text).

    References are decoded, white space inside a block is one space, and the article's blocks are joined by line
    feeds. Rows are independent: repeated pages give repeated rows. One pass without a shuffle; other columns of
    pages are ignored.
    """
    small_batches(pages.sparkSession)
    small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return small.mapInArrow(extracted, SCHEMA)
