"""Page geometry: spans of text with their boxes become blocks in reading order, tables, headings and Markdown.

Spans (doc_id, page, x0, y0, x1, y1, size, bold, text, width, height) come from whatever reads the files. What one page looks like is
decided page by page, in tasks: rows of spans that share a gutter, a strip that none of them covers, are one region; a region whose
cells are filled is text in columns, and each column is cut again; one with narrow cells is a table. What spans pages is
relational: the size of body text (median, weighted by characters), heading sizes, lines that run along most pages.

Right-to-left text that was read in visual order is found by its words, turned into logical order once and judged again: documents are
``accepted``, ``retried`` or in ``quarantine``.

Defined results: spans without text, page or box are dropped; null sizes are body text; equal spans are all kept; a document without spans
has no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T

#: Headings by size and length, edges of a page, pages on which a running line stands, weights of a size, Arabic words.
HEADING_RATIO, HEADING_CHARS, BOLD_CHARS, LEVELS, DEEPEST, BOLD_LEVEL = 1.15, 160, 90, 4, 5, 4
EDGE, RUNNING_PAGES, RUNNING_SHARE, SIZE_WEIGHT, ARABIC_WORDS = 0.08, 3, 0.4, 50, 50
PAGE_NUMBER = r"^([-–—\s]*\d{1,4}[-–—\s]*|page \d+( of \d+)?)$"
NO_HEADING_END = r"[.:،؛]\s*$"
#: Layout: the narrowest gutter, in line heights; what share of a column its cells fill in running text; the gap inside a paragraph.
GUTTER, FILLED, PARAGRAPH_GAP, SAME_LINE = 0.8, 0.6, 0.7, 0.5
BLOCKS = "doc_id long, page int, block int, kind string, text string, size double, bold boolean, edge boolean, sizes map<double,long>"
ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿ]"


@dataclass
class Span:
    x0: float
    y0: float
    x1: float
    y1: float
    size: float
    bold: bool
    text: str

    @property
    def height(self) -> float:
        return max(self.y1 - self.y0, 1e-6)


Row = list[Span]


def page_spans(pages: pa.ListArray) -> Iterator[list[Span]]:
    """The spans of each page, read column by column: a dictionary for each span takes longer than its page's layout."""
    every = pages.flatten()
    columns = dict(zip((f.name for f in every.type), every.flatten(), strict=True))
    boxes = (columns[k].cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).tolist() for k in ("x0", "y0", "x1", "y1", "size"))
    spans = list(map(Span, *boxes, columns["bold"].to_pylist(), columns["text"].to_pylist()))
    bounds = (pages.offsets.to_numpy() - pages.offsets[0].as_py()).tolist()
    return (spans[a:b] for a, b in zip(bounds, bounds[1:], strict=False))


def rows_of(spans: list[Span], rtl: bool) -> list[Row]:
    """Spans side by side, from top to bottom: each overlaps the row's first by half of the lower one's height."""
    out: list[Row] = []
    for s in sorted(spans, key=lambda s: (s.y0, s.x0)):
        for row in reversed(out[-3:]):
            shared = min(s.y1, row[0].y1) - max(s.y0, row[0].y0)
            if shared >= SAME_LINE * min(s.height, row[0].height):
                row.append(s)
                break
        else:
            out.append([s])
    for row in out:
        row.sort(key=lambda s: -s.x1 if rtl else s.x0)
    return out


def _free(row: Row, left: float, right: float) -> list[tuple[float, float]]:
    """Strips between left and right that the row leaves free."""
    out, at = [], left
    for a, b in sorted((s.x0, s.x1) for s in row):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, right)] if at < right else out


def _common(a: list[tuple[float, float]], b: list[tuple[float, float]], least: float) -> list[tuple[float, float]]:
    both = ((max(p, r), min(q, s)) for p, q in a for r, s in b)
    return [(p, q) for p, q in both if q - p >= least]


def _regions(rows: list[Row]) -> Iterator[tuple[list[Row], list[tuple[float, float]]]]:
    """Runs of rows with the gutters that they share; a row without one alone."""
    left, right = min(s.x0 for r in rows for s in r), max(s.x1 for r in rows for s in r)
    run: list[Row] = []
    shared: list[tuple[float, float]] = []
    for row in rows:
        least = GUTTER * row[0].height
        free = [g for g in _free(row, left, right) if g[1] - g[0] >= least]
        now = _common(shared, free, least) if run else free
        # the gutters must keep text on both sides
        inner = [g for g in now if any(s.x1 <= g[0] for r in [*run, row] for s in r) and any(s.x0 >= g[1] for r in [*run, row] for s in r)]
        had = [g for g in shared if any(s.x1 <= g[0] for r in run for s in r) and any(s.x0 >= g[1] for r in run for s in r)]
        if run and (not now or (had and not inner)):
            yield run, had
            run, now = [], free
        run.append(row)
        shared = now
    if run:
        yield run, [g for g in shared if any(s.x1 <= g[0] for r in run for s in r) and any(s.x0 >= g[1] for r in run for s in r)]


def _columns(rows: list[Row], gutters: list[tuple[float, float]]) -> list[list[Row]]:
    edges = sorted((a + b) / 2 for a, b in gutters)
    out: list[list[Row]] = [[] for _ in range(len(edges) + 1)]
    for row in rows:
        cells: list[Row] = [[] for _ in out]
        for s in row:
            cells[sum((s.x0 + s.x1) / 2 > e for e in edges)].append(s)
        for column, cell in zip(out, cells, strict=True):
            column.append(cell)
    return out


def _is_table(columns: list[list[Row]]) -> bool:
    """Cells that leave much of their column free, in two rows at least that have two cells."""
    full = [sum(bool(c[k]) for c in columns) for k in range(len(columns[0]))]
    if sum(n >= 2 for n in full) < 2:
        return False
    shares = []
    for column in columns:
        cells = [c for c in column if c]
        left, right = min(s.x0 for c in cells for s in c), max(s.x1 for c in cells for s in c)
        shares += [(max(s.x1 for s in c) - min(s.x0 for s in c)) / max(right - left, 1e-6) for c in cells]
    shares.sort()
    return len(columns) > 2 or len(full) < 4 or shares[len(shares) // 2] < FILLED


def _said(row: Row) -> str:
    return " ".join(" ".join(s.text for s in row).split())


def _table(columns: list[list[Row]]) -> str:
    """Markdown; a row without a first cell goes on with the one above."""
    written: list[list[str]] = []
    for cells in zip(*columns, strict=True):
        said = [_said(c).replace("|", "\\|") for c in cells]
        if written and not said[0]:
            written[-1] = [f"{a} {b}".strip() for a, b in zip(written[-1], said, strict=True)]
        else:
            written.append(said)
    lines = [f"| {' | '.join(r)} |" for r in written]
    return "\n".join([lines[0], "|" + " --- |" * len(columns), *lines[1:]])


def flow(rows: list[Row], rtl: bool) -> Iterator[tuple[str, list[Row] | str]]:
    """Rows of a page or a column as lines in reading order and tables."""
    rows = [r for r in rows if r]
    if not rows:
        return
    for run, gutters in _regions(rows):
        columns = _columns(run, gutters) if gutters else []
        if columns and rtl:
            columns.reverse()
        if not columns:
            yield "lines", run
        elif _is_table(columns):
            yield "table", _table(columns)
        elif len(columns[0]) == 1:  # one row: a line with a wide blank
            yield "lines", run
        else:
            for column in columns:
                yield from flow(column, rtl)


def page_blocks(spans: list[Span], height: float, rtl: bool) -> Iterator[dict]:
    """Tables and paragraphs: lines of one size and weight without a wide gap between them."""
    held: list[Row] = []

    def paragraph() -> Iterator[dict]:
        if held:
            every = [s for r in held for s in r]
            top, bottom = min(s.y0 for s in every), max(s.y1 for s in every)
            sizes: dict[float, int] = {}
            for s in every:
                sizes[round(s.size, 1)] = sizes.get(round(s.size, 1), 0) + len(s.text)
            edge = bottom < EDGE * height or top > (1 - EDGE) * height
            yield {"kind": "text", "text": " ".join(map(_said, held)), "size": max(s.size for s in every), "bold": all(s.bold for s in every), "edge": edge, "sizes": sizes}
            held.clear()

    for kind, found in flow(rows_of(spans, rtl), rtl):
        if kind == "table":
            yield from paragraph()
            yield {"kind": "table", "text": found, "size": None, "bold": False, "edge": False, "sizes": {}}
            continue
        for row in found:
            like = held and round(held[-1][0].size, 1) == round(row[0].size, 1) and held[-1][0].bold == row[0].bold
            if not like or not -row[0].height <= row[0].y0 - held[-1][0].y1 <= PARAGRAPH_GAP * row[0].height:
                yield from paragraph()
            held.append(row)
    yield from paragraph()


def is_rtl(text: Column) -> Column:
    """Whether Arabic letters are more than three of ten letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    arabic = F.length(F.regexp_replace(text, rf"[^{ARABIC[1:-1]}]", ""))
    return F.coalesce(arabic > T.RTL_SHARE * letters, F.lit(False))


def blocks(spans: DataFrame) -> DataFrame:
    """Blocks of all pages in reading order: doc_id, page, block, kind, text, size, bold, edge, sizes."""
    boxed = spans.where("trim(text) <> '' and page is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    # how much of a page is Arabic decides its direction: sums over spans, before pages are put together
    arabic = F.length(F.regexp_replace("text", rf"[^{ARABIC[1:-1]}]", ""))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    one = F.struct("x0", "y0", "x1", "y1", F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), "text")
    rows = boxed.select("doc_id", F.col("page").cast("int").alias("page"), F.col("height").cast("double").alias("height"), one.alias("s"), arabic.alias("a"), letters.alias("l"))
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("s")).alias("spans"), F.max("height").alias("height"), (F.sum("a") > T.RTL_SHARE * F.sum("l")).alias("rtl"))

    kinds = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("size", pa.float64()), ("bold", pa.bool_()), ("edge", pa.bool_()), ("sizes", pa.map_(pa.float64(), pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, spans in zip(batch.drop_columns(["spans"]).to_pylist(), page_spans(batch.column("spans")), strict=True):
                height = r["height"] or max(s.y1 for s in spans)
                for k, b in enumerate(page_blocks(spans, height, bool(r["rtl"]))):
                    out.append(b | {"doc_id": r["doc_id"], "page": r["page"], "block": k, "sizes": list(b["sizes"].items())})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "spans", "height", "rtl").mapInArrow(run, BLOCKS)


def _edge_line() -> Column:
    """What a block at an edge says, whatever its digits; null elsewhere."""
    return F.when(F.col("edge"), T.line_fingerprint(F.col("text")))


def _is_page_number() -> Column:
    return F.rlike(F.lower("text"), F.lit(PAGE_NUMBER))


def _notes(found: DataFrame) -> DataFrame:
    """What blocks say of their document, read once and summed up; each row notes one of these:

    a page; a size ``at`` and its weight ``n``; what stands ``times`` at edges as ``line``, and the size of a possible ``heading`` with the largest
    size that rounds to it.
    """
    columns = {"page": "int", "at": "double", "n": "long", "line": "string", "heading": "double", "size": "double", "times": "long"}
    note = lambda **said: F.struct(*[said.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in columns.items()])
    may_head = (F.col("kind") == "text") & (F.length("text") <= HEADING_CHARS) & ~_is_page_number()
    shown = note(line=_edge_line(), heading=F.when(may_head, F.round("size", 1)), size=F.when(may_head, F.col("size")), times=F.lit(1))
    sizes = F.map_entries(F.coalesce("sizes", F.create_map().cast("map<double,long>")))
    every = F.concat(F.array(note(page=F.col("page")), shown), F.transform(sizes, lambda e: note(at=e["key"], n=e["value"])))
    return found.select("doc_id", F.inline(every)).groupBy("doc_id", "page", "at", "line", "heading").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.sum("times").alias("times"))


def body_sizes(notes: DataFrame) -> DataFrame:
    """Notes with their document's ``body``: the median size, each weighing as many as its characters up to 50; two middle ones are averaged."""
    of = Window.partitionBy("doc_id")
    n = F.when(F.col("at").isNotNull(), F.least("n", F.lit(SIZE_WEIGHT)))
    run = notes.withColumn("until", F.sum(n).over(of.orderBy("at", "line"))).withColumn("every", F.sum(n).over(of))
    low = F.min(F.when(F.col("until") * 2 >= F.col("every"), F.col("at")))
    high = F.min(F.when(F.col("until") * 2 > F.col("every"), F.col("at")))
    return run.withColumn("body", (low.over(of) + high.over(of)) / 2).drop("until", "every")


def about_documents(found: DataFrame) -> DataFrame:
    """(doc_id, running, headings): the lines at the edges that stand on most pages, and the largest sizes of headings, without those lines."""
    of = Window.partitionBy("doc_id")
    # a note has a size or a line, so one order serves both and notes are sorted once
    same_line = of.orderBy("at", "line").rangeBetween(Window.currentRow, Window.currentRow)
    noted = _notes(found).withColumn("often", F.sum("times").over(same_line)).withColumn("pages", F.count("page").over(of))
    most = F.greatest(F.lit(float(RUNNING_PAGES)), RUNNING_SHARE * F.col("pages"))
    runs = F.col("line").isNotNull() & (F.col("pages") >= RUNNING_PAGES) & (F.col("often") >= most)
    large = F.col("heading").isNotNull() & ~F.col("runs") & (F.col("size") >= HEADING_RATIO * F.col("body"))
    told = body_sizes(noted.withColumn("runs", runs)).groupBy("doc_id").agg(F.collect_set(F.when(F.col("runs"), F.col("line"))).alias("running"), F.collect_set(F.when(large, F.col("heading"))).alias("headings"))
    # collect_set keeps sizes apart that are no numbers
    return told.withColumn("headings", F.slice(F.sort_array(F.array_distinct("headings"), asc=False), 1, LEVELS))


def without_running(told: DataFrame) -> DataFrame:
    """Blocks, each with its document's running lines, without these and page numbers."""
    return told.where(~F.coalesce(F.array_contains("running", _edge_line()), F.lit(False))).where(~_is_page_number())


def structured(found: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block, level, markdown): headings by size, then by weight; bold labels; text; tables."""
    # blocks are read twice: for what their documents have in common, summed up, and joined with it
    left = without_running(found.join(about_documents(found), "doc_id", "left"))
    leveled = left.withColumn("rank", F.nullif(F.array_position("headings", F.round("size", 1)), F.lit(0)))
    by_size = F.when(F.col("rank").isNotNull() & (F.length("text") <= HEADING_CHARS), F.least(F.col("rank") + 1, F.lit(DEEPEST)))
    short = (F.col("kind") == "text") & F.col("bold") & (F.length("text") <= BOLD_CHARS) & ~F.rlike("text", F.lit(NO_HEADING_END))
    label = by_size.isNull() & short & T.is_sub_label(F.col("text"))
    level = F.when(F.col("kind") == "text", F.coalesce(by_size, F.when(short & ~label, F.lit(BOLD_LEVEL)))).cast("int")
    plain = F.when(F.col("text").startswith("#"), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    shown = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "text")).when(label, F.concat(F.lit("**"), "text", F.lit("**")))
    return leveled.select("doc_id", "page", "block", level.alias("level"), F.when(F.col("kind") == "table", F.col("text")).otherwise(F.coalesce(shown, plain)).alias("markdown"))


def markdown(made: DataFrame) -> DataFrame:
    """(doc_id, text, headings, pages): blocks of a document in order, a mark before each page's first."""
    one = F.struct("page", "block", "markdown")
    docs = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.count("level").alias("headings"), F.count_distinct("page").alias("pages"))
    mark = lambda x: F.concat(F.lit("<!-- page:"), x["page"].cast("string"), F.lit(" -->\n\n"), x["markdown"])
    first = lambda x, i: (i == 0) | (F.get("all", i - 1)["page"] != x["page"])
    parts = F.transform("all", lambda x, i: F.when(first(x, i), mark(x)).otherwise(x["markdown"]))
    return docs.select("doc_id", F.array_join(parts, "\n\n").alias("text"), "headings", "pages")


def logical_order(text: Column) -> Column:
    """Lines that were written as they are seen, from left to right, in the order in which they are read.

    A line with Arabic letters is turned round, then each run of other letters and digits in it is turned back; brackets change sides.
    """
    # inside a run of Latin letters and digits stand blanks and the signs of numbers and addresses
    run = r"[\p{IsLatin}\p{Nd}](?:[\p{IsLatin}\p{Nd}\p{M} .,:/@%+_-]*[\p{IsLatin}\p{Nd}])?"

    def turned(line: Column) -> Column:
        back = F.translate(F.reverse(line), "()[]{}<>", ")(][}{><")
        parts = F.regexp_extract_all(back, F.lit(rf"({run}|(?s:.))"), F.lit(1))
        return F.array_join(F.transform(parts, lambda p: F.reverse(p)), "")

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(F.rlike(x, F.lit(ARABIC)), turned(x)).otherwise(x)), "\n")


def _fails(text: Column) -> Column:
    words = F.size(F.regexp_extract_all(text, F.lit(f"({T.ARABIC_WORD})"), F.lit(1)))
    return ((words >= ARABIC_WORDS) | is_rtl(text)) & (T.visual_order_ratio(text) > T.VISUAL_ORDER_LIMIT)


def gate(docs: DataFrame) -> DataFrame:
    """(doc_id, route, text): accepted as it is, retried in logical order, or quarantine (the text as it was); null is empty."""
    given = F.coalesce("text", F.lit(""))
    tried = docs.select("doc_id", given.alias("text"), _fails(given).alias("_bad")).withColumn("_turned", F.when(F.col("_bad"), logical_order(F.col("text"))))
    route = F.when(~F.col("_bad"), "accepted").when(_fails(F.col("_turned")), "quarantine").otherwise("retried")
    return tried.withColumn("route", route).select("doc_id", "route", F.when(F.col("route") == "retried", F.col("_turned")).otherwise(F.col("text")).alias("text"))
