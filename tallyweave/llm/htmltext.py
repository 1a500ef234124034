"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of text; where containers end or begin, blank lines stand between
them. A line's length is the number of its characters outside links. Hints only weigh lines and move boundaries: a line
of a menu, header, footer, sidebar, notice, advert, form or comment weighs nothing, and an article's own marks widen a
region to the article's ends.

The lengths are summed over a sliding window of lines. A region surges where the sums leave zero, if its fullest window
is worth it, and dives where they are back at zero; the text between these points is kept. What stands outside is
dropped because of the sums, whatever its element is.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass

#: Lines in a window.
WINDOW = 3
#: A window with so many characters is a surge, or one with this share of the page's fullest window.
SURGE_CHARS = 80
SURGE_SHARE = 0.2
#: A line with more than this share of its characters inside links has no text length.
LINK_SHARE = 0.6

# fixed values: element names of HTML
BLOCKS = frozenset(
    """
    address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select
    summary table tbody td tfoot th thead title tr ul
    """.split()
)
CONTAINERS = frozenset("article aside body details dialog div dl fieldset footer form header main menu nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset(
    "aside button canvas dialog fieldset footer head header iframe label menu nav noscript object option select svg template title".split()
)
RAW = "script|style|noscript|template|iframe|textarea|svg|canvas|object|xmp"
#: Elements that a block cannot stand in, so their end tag never closes what stands around a boundary.
NARROW = frozenset("a b i li p span".split())
#: Elements that end where the next of their kind begins.
SELF_ENDING = frozenset("dd dt li option p td tr".split())

# fixed values: words of class names and ids, which are split at '-' and '_'
NAMES = frozenset(
    """
    adsense banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer form gdpr header legal login
    masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion search
    share sharing sidebar signup skip social subscribe toolbar topbar widget widgets
    """.split()
)
#: Of these, which may hold articles of their own, so that an article inside isn't the page's.
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement comment comments disqus recommended related replies reply respond responses sponsor sponsored".split()
)
#: From such a word on, a name tells what the page around is like.
ABOUT = frozenset("has with without no is not show hide".split())
#: Words before '-header' that name an article's own head.
OWN_HEAD = frozenset("article post entry story content page section".split())
ROLES = frozenset("alert banner complementary contentinfo dialog menu menubar navigation search".split())

#: Comments and raw elements, whichever begins first; only svg may close itself.
_CUT = re.compile(
    rf"(?P<comment><!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>)|<svg(?=[\s/>])[^>]*/>|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\2\s*>|\Z)", re.I | re.S,
)
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"
)
_ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: What an element does to the lines inside: nothing, weighs them zero for sure, or by its name alone, or marks the article.
PLAIN, ZERO, NAMED, MAIN = range(4)


@dataclass
class Line:
    text: str
    length: int  #: characters outside links, or 0 where links are most of them
    hard: bool  #: inside boilerplate whatever stands around it
    soft: bool  #: inside an element, around the article, that only a name tells
    article: int  #: number of the outermost article mark around it, or 0


def _named(label: str, inside: bool) -> int:
    """What a class attribute or an id says of an element."""
    found = PLAIN
    for name in label.lower().split():
        words = list(takewhile(lambda w: w not in ABOUT, filter(None, re.split(r"[-_]+", name))))
        if len(words) > 1 and words[-1] == "header" and (inside or words[0] in OWN_HEAD):
            continue
        if not OTHERS.isdisjoint(words):
            return ZERO
        if not NAMES.isdisjoint(words):
            found = NAMED
    return found


def _kind(name: str, attrs: str, inside: bool) -> int:
    """What an element is; inside says whether an article is open around it."""
    if name in ("article", "main"):
        return MAIN
    if name in BOILERPLATE:
        return PLAIN if name == "header" and inside else ZERO
    found = NAMED if name == "form" else PLAIN
    if not attrs or name in ("html", "body"):
        return found
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value == "articleBody":
            return MAIN
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _NO_DISPLAY.search(value):
            return ZERO
        if key == "role" and value.lower() in ROLES:
            return ZERO
        if key in ("class", "id"):
            found = found if (said := _named(value, inside)) == PLAIN else ZERO if ZERO in (said, found) else said
    return found


def lines(page: str) -> list[Line]:
    """Every block of text of the page in order, with blank lines (text '') where containers end or begin."""
    page = _CUT.sub(lambda m: "" if m["comment"] else " ", page)
    out: list[Line] = []
    stack: list[tuple[str, int, int]] = []  # name, kind, NAMED elements open outside of an article mark
    places: dict[str, list[int]] = {}  # where each name stands in the stack
    kinds: list[int] = []  # places in the stack that aren't PLAIN
    parts: list[str] = []
    linked = links = zeros = named = around = mains = articles = gap = start = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = entities.unescape(piece)
        parts.append(piece)
        linked += len("".join(piece.split())) if links else 0

    def close_line() -> None:
        nonlocal linked, gap
        words = "".join(parts).split()
        parts.clear()
        if words:
            text = " ".join(words)
            out.extend([Line("", 0, False, False, 0)] * min(gap, WINDOW))
            gap = 0
            length = 0 if linked > LINK_SHARE * sum(map(len, words)) else len(text)
            out.append(
                Line(text, length, zeros > 0 or (mains > 0 and named > 0), (around if mains else named) > 0, articles if mains else 0)
            )
        linked = 0

    for tag in _TAG.finditer(page):
        if tag.start() > start:
            add(page[start : tag.start()])
        start = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close_line()
        if tag[1] or tag[4]:
            if not (own := places.get(name)) or (name in NARROW and kinds and kinds[-1] > own[-1]):
                continue
            for _ in range(len(stack) - own[-1]):
                other, kind, held = stack.pop()
                places[other].pop()
                if kind != PLAIN:
                    kinds.pop()
                links -= other == "a"
                zeros -= kind == ZERO
                mains -= kind == MAIN
                if kind == MAIN and not mains:
                    named, around = held, 0
                named -= kind == NAMED
                gap += WINDOW if kind == MAIN else other in CONTAINERS
        elif name not in VOID:
            if name in SELF_ENDING and stack and stack[-1][0] == name and stack[-1][1] == PLAIN:
                stack.pop()
                places[name].pop()
            kind = _kind(name, tag[3] or tag[6] or "", mains > 0)
            places.setdefault(name, []).append(len(stack))
            if kind != PLAIN:
                kinds.append(len(stack))
            stack.append((name, kind, named))
            links += name == "a"
            zeros += kind == ZERO
            named += kind == NAMED
            if kind == MAIN:
                if not mains:
                    around, named, articles = named, 0, articles + 1
                mains += 1
            gap += WINDOW if kind == MAIN else name in CONTAINERS
    add(page[start:])
    close_line()
    return out


def _sums(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Of each line the summed lengths of the window that begins there."""
    ends = [0, *accumulate(lengths)]
    return [ends[min(i + window, len(lengths))] - ends[i] for i in range(len(lengths))]


def _surge(full: int) -> float:
    """The least sum that is a surge where the fullest window has `full` characters."""
    return min(SURGE_CHARS, SURGE_SHARE * full)


def weigh(found: list[Line]) -> tuple[list[int], list[bool]]:
    """(length that each line weighs, which lines an article mark holds).

    Names are only believed where what is left beside them is a surge: they don't weigh on an article that is marked
    nowhere else, nor on a page of which they hold the text.
    """
    plain = [not (x.hard or x.soft) for x in found]
    bare = [not x.hard for x in found]
    if not any(p and x.article for p, x in zip(plain, found, strict=True)):
        if any(b and x.article for b, x in zip(bare, found, strict=True)):
            plain = [b and (x.article > 0 or not x.soft) for b, x in zip(bare, found, strict=True)]
        else:
            left, all_ = (max(_sums([x.length * o for x, o in zip(found, some, strict=True)]), default=0) for some in (plain, bare))
            plain = plain if left >= _surge(all_) > 0 else bare
    return [x.length * p for x, p in zip(found, plain, strict=True)], [x.article > 0 and p for x, p in zip(found, plain, strict=True)]


def regions(lengths: list[int], marked: list[bool] | None = None, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) of each region, from its first line with length to its last one.

    A region is a longest run of windows whose sums aren't zero, if its fullest window has SURGE_CHARS or SURGE_SHARE of
    the page's fullest. Where some lines with length are marked, only windows that begin with such a line count.
    """
    sums = _sums(lengths, window)
    if marked and any(n and m for n, m in zip(lengths, marked, strict=True)):
        worth = [s if n and m else 0 for s, n, m in zip(sums, lengths, marked, strict=True)]
    else:
        worth = sums
    surge, found, i = _surge(max(worth, default=0)), [], 0
    while i < len(sums):
        end = i + 1
        if sums[i]:
            while end < len(sums) and sums[end]:
                end += 1
            if max(worth[i:end]) >= surge:
                first = next(k for k in range(i, end) if lengths[k])
                last = next(k for k in range(end - 1, i - 1, -1) if lengths[k])
                found.append((first, last + 1))
        i = end
    return found


def kept(found: list[Line]) -> list[int]:
    """Places of the lines between surge and dive; a region in a marked article reaches to that article's ends."""
    lengths, marked = weigh(found)
    spans = regions(lengths, marked)
    touched = {found[k].article for a, b in spans for k in range(a, b) if marked[k]}
    if touched:
        ends = {n: [k for k, x in enumerate(found) if marked[k] and x.article == n] for n in touched}
        spans = sorted((own[0], own[-1] + 1) for own in ends.values())
    return [k for a, b in spans for k in range(a, b) if found[k].text and (lengths[k] or not (found[k].hard or found[k].soft) or marked[k])]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by one space; '' for a null or empty page or one without text."""
    found = lines(page or "")
    return " ".join(found[k].text for k in kept(found))


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns, `text` and `n_chars` of every row. A null page gives an empty text; equal pages equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keys, "text", "n_chars"]
            )

    schema = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keys) + "text string, n_chars long"
    return arrow_pass(pages.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{html}`")), run, schema)
