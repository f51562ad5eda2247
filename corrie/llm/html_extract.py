"""Main text of HTML pages by line-block distribution.

Markup is stripped first: comments, scripts, styles and elements that are boilerplate by their name (menus, footers,
forms and so on) or by a whole name in their class, id or role go with what they hold; character references are decoded;
block elements part the text into blocks whose white space is one space. A block's weight is its length outside links.

Weights are summed over sliding windows of WINDOW blocks; the edge of a container (CONTAINERS) is WINDOW empty lines. A
run of blocks begins where the sum rises from 0 and ends at the dive point, where it has fallen to 0 again. A run surges
if its highest sum is at least RISE of the page's highest. Runs that surge are main text, and with them what can't be told
apart by lengths because it is too short:

- link-only headings and paragraphs next to the run, and a run of nothing but headings before it;
- what stands between two such runs that are neighbours in one container, or in containers side by side;
- every block of the <article> or <main> that the run lies in. An <article> or <main> without a surge is no main text.

Edge cases: a null or empty page and a page without text give an empty text; a page whose text is all in links gives an
empty text; unclosed elements end with what holds them, unclosed comments and scripts with the page; a page of any length
and nesting takes time in proportion to its length; rows are handled one by one, so repeated rows agree; an empty table
gives no rows; other columns pass (`main_text` is replaced).
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WINDOW = 3
RISE = 0.4

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp".split())
DROPPED = frozenset("head script style textarea title xmp noscript template iframe svg math canvas object embed audio video map form fieldset select button input datalist dialog nav aside footer menu".split())
CONTAINERS = frozenset("article aside body div fieldset footer form header html main nav section td".split())
CLOSED_BY_THEIR_LIKE = frozenset("p li dt dd tr td th option".split())
#: Words that mark boilerplate where a name of a class, id or role has no others than these and NEUTRAL ones.
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies disqus respond widget toolbar pagination pager complementary contentinfo".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
HEADER_MARKS = frozenset("header masthead topbar banner".split())
NEUTRAL = frozenset("area article bar block bottom box button buttons container content form group inner item items left links list main outer page panel post right section site slot thread top wrap wrapper".split())
# End of fixed values.

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def _marked(attrs: str, marks: frozenset[str]) -> bool:
    """Whether a name in a class, id or role has a word of `marks` and else only neutral ones."""
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            found = [w.lower() for w in _WORD.findall(name)]
            if any(w in marks for w in found) and all(w in marks or w in NEUTRAL for w in found):
                return True
    return False


class Block(NamedTuple):
    """A block's text, its length outside links, whether it is a heading, whether it stands in a paragraph or heading, the numbers of the container around it and of that one's own, and the number of the outermost <article> or <main>, or 0."""

    text: str
    weight: int
    heading: bool
    prose: bool
    place: tuple[int, int]
    article: int


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # open elements, whether each drops its text, and its number
    count: Counter[str] = Counter()  # of the open elements
    place, places = (0, 0), []
    dropped = number = article = 0
    void = 0  # the elements of the stack up to here no longer drop anything
    heading = prose = False
    begun = place, article

    def end() -> None:
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                free = len(text) - len(" ".join(htmllib.unescape("".join(linked)).split()))
                out.append(Block(text, max(free, 0), heading, prose, *begun))
            parts.clear()
            linked.clear()

    def say(text: str) -> None:
        nonlocal heading, prose, begun
        if text and not dropped:
            if not parts:
                heading = any(count[t] for t in HEADINGS)
                prose, begun = heading or count["p"] > 0, (place, article)
            parts.append(text)
            if count["a"]:
                linked.append(text)

    def close(tag: str) -> None:
        nonlocal dropped, article, place, void
        if not count[tag]:
            return
        while True:
            t, d, no = stack.pop()
            count[t] -= 1
            dropped -= d and len(stack) >= void
            void = min(void, len(stack))
            if t in CONTAINERS:
                place = places.pop()
            if no == article:
                article = 0
            if t == tag:
                return

    def open_(tag: str, attrs: str) -> None:
        nonlocal dropped, article, number, place, void
        if stack and stack[-1][0] == tag and tag in CLOSED_BY_THEIR_LIKE:
            close(tag)
        inside, number = count["article"] + count["main"], number + 1
        if tag in ("article", "main"):
            drop = _marked(attrs, COMMENTS)
            if dropped and not drop and not inside and not count["aside"] and not count["form"]:  # what is still open around it isn't boilerplate
                dropped, void = 0, len(stack)
            if not inside and not dropped and not drop:
                article = number
        elif tag in ("html", "body"):
            drop = False
        else:
            drop = tag in DROPPED or tag == "header" and not inside or "=" in attrs and (_marked(attrs, MARKS) or not inside and _marked(attrs, HEADER_MARKS))
        stack.append((tag, drop, number))
        count[tag] += 1
        dropped += drop
        if tag in CONTAINERS:
            places.append(place)
            place = place[1], number

    at, n, last = 0, len(page), page.rfind(">") + 1
    while at < n:
        m = _TOKEN.search(page, at, last)
        if not m:
            say(page[at:].split("<!--", 1)[0])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = n if stop < 0 else stop + 3
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "br":
            say(" ")
        elif tag not in INLINE:
            end()
        if m[1] or m[4]:
            close(tag)
        elif tag in RAW:
            stop = _ENDS[tag].search(page, at)
            at = stop.end() if stop else n
        elif tag not in VOID and not (attrs := m[3] or m[6] or "").endswith("/"):
            open_(tag, attrs)
    end()
    return out


class Run(NamedTuple):
    """Blocks first to last (exclusive) between a surge and a dive point, and the highest sum of a window."""

    first: int
    last: int
    peak: int


def runs(lines: list[Block]) -> list[Run]:
    out: list[Run] = []
    i = 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and lines[j].place == lines[i].place:
            j += 1
        first, last, total, peak = -1, -1, 0, 0
        for k in range(i, j):  # total: of the window that ends at k
            total += lines[k].weight - (lines[k - WINDOW].weight if k - WINDOW >= i else 0)
            if not total and first >= 0:
                out.append(Run(first, last + 1, peak))
                first, peak = -1, 0
            if lines[k].weight:
                first, last = k if first < 0 else first, k
            peak = max(peak, total)
        if first >= 0:
            out.append(Run(first, last + 1, peak))
        i = j
    return out


def _side_by_side(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether containers are one and the same, or side by side in one, or one in the other."""
    return a[0] == b[0] or a[0] == b[1] or a[1] == b[0]


def main_text(page: str | None) -> str:
    lines = blocks(page) if page else []
    found = runs(lines)
    if not found:
        return ""
    least = RISE * max(r.peak for r in found)
    surges = [r for r in found if r.peak >= least]
    keep = [False] * len(lines)
    articles = {lines[r.first].article for r in surges} - {0}
    before: Run | None = None
    for r in surges:
        first, last = r.first, r.last
        while first and not lines[first - 1].weight and lines[first - 1].prose and lines[first - 1].place == lines[r.first].place:
            first -= 1
        while last < len(lines) and not lines[last].weight and lines[last].prose and lines[last].place == lines[r.first].place:
            last += 1
        while first and lines[first - 1].heading:
            first -= 1
        if before and _side_by_side(lines[before.first].place, lines[r.first].place):
            first = min(first, before.last)
        keep[first:last] = [True] * (last - first)
        before = r
    return " ".join(b.text for b, k in zip(lines, keep, strict=True) if k or b.article in articles)


def extract(pages: DataFrame) -> DataFrame:
    """pages with main_text, from the column html."""
    small_batches(pages.sparkSession)
    cols = [c for c in pages.columns if c != "main_text"]
    pages = pages.select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())], [*cols, "main_text"])

    return pages.mapInArrow(run, pages.select("*", F.lit("").alias("main_text")).schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
