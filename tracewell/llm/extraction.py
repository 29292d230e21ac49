"""HTML extraction by line-block distribution.

Markup is stripped to lines, one per block element. A line's length counts its text outside links. Elements that the
contract names (menus, headers, footers, sidebars, notices, adverts, forms, readers' comments, by name or by a whole
token of class, id or role) give no lines; on a page without an article or main element no such element is left out that
holds more than half of the page's text outside links. Hidden elements (``hidden``, ``display: none``,
``aria-hidden="true"``) never count.

What is left is decided by the distribution of lengths alone. The length of a block is the sum over ``WINDOW`` lines from
a line on. Where it surges over ``SURGE`` (on a page of short lines: over half of the page's highest block) the main text
begins, with the short lines that lead up to it; at the last such line's dive to nothing it ends, and all lines between
are kept, short ones and lists of links among them. Lines before the surge and behind the dive go. The edges of article and
main elements part the lines into stretches that windows do not cross. Inside an article (inside main on a page without
one) any text is a surge, so only links at its ends go, however short it is; elsewhere a stretch beside the one with the
highest block has to reach ``SIDE_SHARE`` of it. A page without any text outside links keeps all lines.

Character references are decoded, white space inside a line (``<br>`` included) becomes one blank, lines are
trimmed, empty ones go, the rest is joined by one line feed. A quote opens a value only behind ``=``, as in browsers. The
time is linear in the page, unclosed and unopened tags included.

Defined results: null or empty html gives an empty text; unclosed elements and cut-off tags are read as browsers
do in the common cases; equal rows give equal rows; an empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
#: A stretch beside the one with the page's highest block surges at this share of that block.
SIDE_SHARE = 0.25
#: What stands between a tag's name and its end; quotes count behind an equals sign only.
INSIDE = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    rf"|<(?:svg|math)\b(?:=\s*(?:\"[^\"]*\"|'[^']*')|/(?!>)|[^>/])*+/>"
    rf"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|select|textarea|title)\b{INSIDE}>.*?(?:</(?P=raw)\s*>|$)"
    rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>{INSIDE})>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
CLOSED = re.compile(r"(?:-->|</(?:script|style|noscript|template|svg|math|iframe|object|select|textarea|title)\s*>)$", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
HINTS = frozenset(("class", "id", "role", "aria-label"))
MAY_HIDE = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPACE = re.compile(r"\s+")
#: Where a tag begins that the page's end cuts off.
CUT_OFF = re.compile(r"<[a-z/!]", re.I)
#: A slash that ends an unquoted value (href=/) belongs to the value.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
PARTS = re.compile(r"[-_]+")
#: Elements that end a line, that never hold an article, and that are never closed.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer aside form menu dialog button head label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark elements outside the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer header masthead comment comments disqus reply replies respond discussion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login complementary contentinfo form".split()
)
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion".split())
COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}


def hides(attributes: str) -> bool:
    """Whether the attributes make an element invisible."""
    if not MAY_HIDE.search(attributes):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "style" and NO_DISPLAY.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
    return False


def marks_of(attributes: str) -> set[str]:
    """Tokens of class, id, role and label; one made of MARKS alone (cookie-banner) counts as its words."""
    found: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        for token in "".join(values).lower().split() if name.lower() in HINTS else ():
            parts = set(PARTS.split(token)) - {""}
            found |= parts if parts <= MARKS else {token}
    return found


def lines_of(page: str) -> list[tuple[str, int, int, str]]:
    """(text, length outside links, stretch, article or main or neither) of every line outside elements that never hold an article."""
    lines, large, marked = _lines(page, frozenset())
    return _lines(page, large)[0] if large and not marked else lines


def _lines(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, int, int, str]], frozenset[int], bool]:
    """Lines as above, where elements left out but for those spared hold most text, and whether there is an article."""
    lines: list[tuple[str, int, int, str]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, outside, article, of readers' comments
    opened: Counter[str] = Counter()  # open elements by name
    outsides: list[int] = []  # places in the stack of elements left out
    article = articles = links = remarks = invisible = 0  # article counts main elements too
    visible = 0  # characters outside links so far
    starts: list[tuple[int, bool, bool]] = []  # of each open element: place, left out by its marks, hidden
    before: dict[int, int] = {}  # place of an element left out by its marks: characters before it, then inside it
    stretch = 0  # goes up where an article or main element begins or ends
    seen = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", references.unescape("".join(parts))).strip()
            if text:
                lines.append((text, max(0, len(text) - linked), stretch, "article" if articles else "main" if article else ""))
            parts.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal article, articles, links, remarks, invisible, stretch
        for place, out, hidden in starts[n:]:
            invisible -= hidden
            if out:
                before[place] = visible - before[place]
        del starts[n:]
        for tag, _, main, remark in stack[n:]:
            stretch += main
            opened[tag] -= 1
            article, articles, remarks, links = article - main, articles - (main and tag == "article"), remarks - remark, links - (tag == "a")
        del stack[n:]
        while outsides and outsides[-1] >= n:
            outsides.pop()

    def add(text: str) -> None:
        nonlocal linked, visible
        if text and not links and not invisible:
            visible += len(text.strip())
        if text and not outsides:
            parts.append(text)
            if links:
                linked += len(text.strip())

    last, end, cut = 0, page.rfind(">") + 1, False  # no tag ends behind the last bracket, so none is looked for there
    for token in TOKEN.finditer(page, 0, end):
        add(page[last : token.start()])
        last = token.end()
        tag = token["tag"]
        if not tag:
            cut = last == end and bool(token["raw"] or token.group().startswith("<!--")) and not CLOSED.search(page, max(token.start(), end - 99), end)
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" and not outsides else "")
            continue
        if tag in BLOCKS:
            flush()
        if token["close"]:
            if opened[tag]:
                pop(next(n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == tag))
            continue
        if tag == "body" and opened["head"]:
            for n, entry in enumerate(stack):
                if entry[0] == "head":
                    pop(n)
                    break
        if stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            pop(len(stack) - 1)
        attributes = token["attributes"]
        words = marks_of(attributes) if attributes else set()
        remark = bool(words & COMMENTS) and tag not in ("html", "body")
        main = tag in ("article", "main") and not remark and not remarks and not words & ADVERTS
        if main and outsides:
            # an article does not sit in a menu: what is still open was not closed
            pop(outsides[0])
        hidden = not main and tag not in ("html", "body") and hides(attributes)
        out = not main and tag not in ("html", "body") and (tag in NEVER or remark or (tag == "header" and not article))
        if not out and not main and tag in BLOCKS and tag not in ("html", "body", "h1") and words & MARKS:
            out = not (article and words <= {"header"})
        if tag in VOID or SELF_CLOSED.search(attributes):
            continue
        seen, stretch = seen or main, stretch + main
        left_out = out and not hidden
        if left_out:
            before[token.start()] = visible
        starts.append((token.start(), left_out, hidden))
        invisible += hidden
        if token.start() in spared:
            out = remark = False
        out = out or hidden
        if out:
            outsides.append(len(stack))
        stack.append((tag, out, main, remark))
        opened[tag] += 1
        article, articles, remarks, links = article + main, articles + (main and tag == "article"), remarks + remark, links + (tag == "a")
    rest = "" if cut else page[last:]
    add(CUT_OFF.split(rest, maxsplit=1)[0])
    flush()
    pop(0)
    return lines, frozenset(place for place, inside in before.items() if 2 * inside > visible), seen


def blocks_of(lengths: list[int]) -> list[int]:
    """The sum of each line's length and those of the next lines of its window."""
    return [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]


def kept_lines(lines: list[tuple[str, int, int, str]]) -> list[str]:
    """Of (text, length outside links, stretch, where): in each stretch, the lines from its first surge to its last dive."""
    stretches = [list(group) for _, group in groupby(lines, key=lambda line: line[2])]
    blocks = [blocks_of([length for _, length, *_ in stretch]) for stretch in stretches]
    peaks = [max(b, default=0) for b in blocks]
    highest = max(peaks, default=0)
    if not highest:
        return [text for text, *_ in lines]
    named = next((name for name in ("article", "main") if any(line[3] == name and line[1] for line in lines)), None)
    kept: list[str] = []
    for stretch, sums, peak in zip(stretches, blocks, peaks, strict=True):
        # in an article any text counts; else the stretch with the page's highest block sets the measure for the others
        surge = 0 if stretch[0][3] == named else min(SURGE, highest / 2) if peak == highest else max(SURGE, highest * SIDE_SHARE)
        inside = [i for i, (_, length, *_) in enumerate(stretch) if length and sums[i] >= surge]
        if inside:
            # from where the lengths rise out of nothing towards the first surge, to the dive behind the last one
            rise = next((i + 1 for i in range(inside[0] - 1, -1, -1) if not stretch[i][1]), 0)
            dive = next((i for i in range(inside[-1], len(stretch)) if not sums[i]), len(stretch))
            kept += [text for text, *_ in stretch[rise:dive]]
    return kept


def main_text(page: str | None) -> str:
    return "\n".join(kept_lines(lines_of(page or "")))


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each page."""
    kept = [f"`{c}`" for c in pages.columns if c != into]
    names = [c for c in pages.columns if c not in (html, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page) for page in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, into])

    shape = pages.select(*kept).drop(html).withColumn(into, F.lit("")).schema
    return pages.select(*kept).mapInArrow(run, shape)
