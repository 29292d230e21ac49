"""Pages of spans against the text that they show: columns, tables, headings, running lines, direction."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.scratch import Scratch
from tracewell.operators import pages

SPAN = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string, width double, height double"


def line(text, x, y, w, size=10.0, bold=False):
    return pages.Span(x, y, x + w, y + size, size, bold, text)


def column(words, x, y, w, size=10.0):
    return [line(t, x, y + 12 * k, w, size) for k, t in enumerate(words)]


def texts(spans, rtl=False, height=800):
    return [b["text"] for b in pages.page_blocks(spans, height, rtl)]


LEFT, RIGHT = [f"left {k}" for k in range(6)], [f"right {k}" for k in range(6)]


def test_columns_are_read_one_after_another():
    title = [line("A wide title over both", 40, 100, 500, 18.0)]
    both = [*column(LEFT, 40, 150, 230), *column(RIGHT, 300, 150, 230)]
    foot = [line("A line below that goes across the whole of the page", 40, 300, 490)]
    assert texts(title + both + foot) == ["A wide title over both", " ".join(LEFT), " ".join(RIGHT), foot[0].text]
    # short last lines, columns of unequal length, gaps at other heights, lines not quite level
    short = [*column(LEFT[:5], 40, 150, 230), line("left 5", 40, 210, 60), *column(RIGHT[:2], 300, 153, 230), line("right 2", 300, 200, 230)]
    assert texts(short) == [" ".join(LEFT), "right 0 right 1", "right 2"]
    assert texts(both, rtl=True) == [" ".join(RIGHT), " ".join(LEFT)]


def test_tables_are_found_by_edges():
    cells = [("Id", "Name", "Says"), ("1", "Gate", "opens at seven"), ("2", "Lamp | light", "is lit"), ("", "", "at dusk")]
    spans = [line(t, x, 100 + 14 * k, 6 * len(t)) for k, row in enumerate(cells) for x, t in zip((40, 120, 260), row, strict=True) if t]
    above, below = line("Some words before the table that go on for long", 40, 60, 480), line("And after it there are words that go on for long", 40, 200, 480)
    table = "| Id | Name | Says |\n| --- | --- | --- |\n| 1 | Gate | opens at seven |\n| 2 | Lamp \\| light | is lit at dusk |"
    assert texts([above, *spans, below]) == [above.text, table, below.text]
    # inside a column of text
    inner = [line(t, x, 250 + 14 * k, 30) for k, row in enumerate((("k", "v"), ("a", "b"))) for x, t in zip((300, 420), row, strict=True)]
    got = texts([*column(LEFT, 40, 150, 230), *column(RIGHT, 300, 150, 230), *[line(f"more {k}", 40, 222 + 12 * k, 230) for k in range(5)], *inner])
    assert got[-1] == "| k | v |\n| --- | --- |\n| a | b |" and got[0].startswith("left 0") and got[0].endswith("more 4")


def test_a_wide_blank_is_no_column():
    assert texts([line("Name:", 40, 100, 40), line("Gate", 300, 100, 40), line("Words that go on over all of the page and more", 40, 130, 500)]) == ["Name: Gate", "Words that go on over all of the page and more"]


def test_spans_are_read_by_column():
    """Each page has its own spans, whatever part of a batch is read."""
    page = lambda k, n: [{"x0": k, "y0": i, "x1": k + 1, "y1": i + 1, "size": 9.5, "bold": i == 1, "text": f"{k} {i}"} for i in range(n)]
    given = pa.array([page(0, 2), page(1, 0), page(2, 3), page(3, 1)])
    for part in (given, given.slice(1), given.slice(2, 1)):
        got = [[(s.x0, s.y0, s.x1, s.y1, s.size, s.bold, s.text) for s in spans] for spans in pages.page_spans(part)]
        assert got == [[tuple(s[k] for k in ("x0", "y0", "x1", "y1", "size", "bold", "text")) for s in spans] for spans in part.to_pylist()]


@pytest.fixture(scope="module")
def report(spark):
    rows = []
    for page in range(1, 5):
        rows += [(1, page, 40.0, 20.0, 200.0, 28.0, 8.0, False, f"Report of May, page {page}"), (1, page, 300.0, 780.0, 310.0, 788.0, 8.0, False, str(page))]
        rows += [(1, page, 40.0, 100.0 + 12 * k, 540.0, 110.0 + 12 * k, 10.0, False, f"Body line {k} of page {page} goes on and on") for k in range(8)]
    rows += [(1, 1, 40.0, 60.0, 300.0, 80.0, 20.0, True, "The Report"), (1, 2, 40.0, 60.0, 300.0, 74.0, 14.0, False, "A part"), (1, 3, 40.0, 60.0, 200.0, 70.0, 10.0, True, "Notes on it"), (1, 3, 40.0, 400.0, 200.0, 410.0, 10.0, True, "Ends here."), (1, 4, 40.0, 300.0, 200.0, 310.0, 10.0, True, "Acceptance Criteria"), (1, 4, 40.0, 400.0, 300.0, 410.0, 10.0, False, "# no heading")]
    rows += [(2, 1, 40.0, 20.0, 200.0, 28.0, 8.0, False, "Report of May, page 1"), (2, 1, 40.0, 100.0, 500.0, 110.0, 10.0, False, "Two pages are few, so that what stands at their edges stays in the text"), (2, 2, 40.0, 20.0, 200.0, 28.0, 8.0, False, "Report of May, page 2"), (2, 2, 40.0, 100.0, 500.0, 110.0, 10.0, False, None), (2, None, 0.0, 0.0, 1.0, 1.0, 10.0, False, "nowhere")]
    spans = spark.createDataFrame([(*r, 600.0, 800.0) for r in rows], SPAN).repartition(5)
    return {r.doc_id: r for r in pages.markdown(pages.structured(pages.blocks(spans))).collect()}


def test_structure(report):
    body = lambda p: " ".join(f"Body line {k} of page {p} goes on and on" for k in range(8))
    assert report[1].text == "\n\n".join([
        "<!-- page:1 -->", "## The Report", body(1), "<!-- page:2 -->", "### A part", body(2), "<!-- page:3 -->", "#### Notes on it", body(3), "Ends here.",
        "<!-- page:4 -->", body(4), "**Acceptance Criteria**", " # no heading",
    ])
    assert (report[1].headings, report[1].pages) == (3, 4)
    assert report[2].text == "<!-- page:1 -->\n\nReport of May, page 1\n\nTwo pages are few, so that what stands at their edges stays in the text\n\n<!-- page:2 -->\n\nReport of May, page 2"


def test_structure_reads_blocks_twice(spark):
    """Once for what a document's blocks have in common, once to join it; odd rows as before."""
    body = lambda doc, page, k, text, size=10.0, edge=False, kind="text", sizes=None: (doc, page, k, kind, text, size, False, edge, {size: 1} if sizes is None and size is not None else sizes)
    rows = [body(1, page, 0, f"Head {page}", 30.0, True) for page in (1, 2, 3)]  # a running line has no rank
    rows += [body(1, 1, k, f"Size {size}", size) for k, size in enumerate((24.0, 22.0, 20.0, 18.0, 16.0, 14.0), 1)]  # no more than four have
    rows += [body(1, 2, k, f"Text {k}", sizes={10.0: 50, 9.0: 900}) for k in range(1, 9)] + [body(1, 3, 1, "12", 40.0), body(1, 3, 2, None, 40.0, True), body(1, 3, 3, "| a |", None, kind="table", sizes={})]
    rows += [body(None, page, 0, "Null 1", 30.0, True) for page in (1, 2, 3)] + [body(2, 1, 0, "Twice"), body(2, 1, 0, "Twice"), body(3, 1, 0, "| b |", None, kind="table", sizes={})]
    rows += [body(4, 1, 0, f"Odd {k}", float("nan"), True, sizes={10.0: 9}) for k in "ab"] + [body(4, 1, 2, "Odd c", 20.0)]  # sizes that are no number are one size
    found = Scratch(spark, "t").save(spark.createDataFrame(rows, pages.BLOCKS).repartition(3), "blocks")
    made = pages.structured(found)
    levels = {(24.0, 2), (22.0, 3), (20.0, 4), (18.0, 5), (16.0, None), (14.0, None)}
    expected = [(1, 1, f"{'#' * (level or 0)} Size {size}".strip(), level) for size, level in levels] + [(1, 2, f"Text {k}", None) for k in range(1, 9)] + [(1, 3, "| a |", None)]
    expected += [(None, page, "Null 1", None) for page in (1, 2, 3)] + [(2, 1, "Twice", None)] * 2 + [(3, 1, "| b |", None)]
    expected += [(4, 1, "## Odd a", 2), (4, 1, "## Odd b", 2), (4, 1, "### Odd c", 3)]
    assert sorted(((r.doc_id, r.page, r.markdown, r.level) for r in made.collect()), key=str) == sorted(expected, key=str)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Join") == 1
    # sorted once for all that is known of a document, and on each side of the join
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 3


ARABIC = "يجب على النظام أن يسمح للمستخدم بإدارة الطلبات والمدفوعات من خلال اللوحة الرئيسية (FR-12) في 24.5 ثانية"


def test_gate(spark):
    """Turned lines come back, reversed ones that stay wrong wait, others go through as they are."""
    def seen(line):
        """As it is drawn from left to right: turned round, with Latin runs the right way."""
        run = r"[A-Za-z0-9](?:[A-Za-z0-9 .-]*[A-Za-z0-9])?"
        return "".join(p[::-1] for p in re.findall(f"{run}|.", line[::-1].translate(str.maketrans("()", ")("))))

    logical = "\n".join([ARABIC, "Plain English (with 12 words)", ARABIC] * 4)
    visual = "\n".join(seen(x) if "ي" in x else x for x in logical.split("\n"))
    hopeless = " ".join(["كتابلا", "الكتابلا"] * 40)
    rows = [(1, logical), (2, visual), (3, hopeless), (4, "Only English لا"), (5, None), (6, "")]
    got = {r.doc_id: (r.route, r.text) for r in pages.gate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("accepted", logical) and got[2] == ("retried", logical) and got[3][0] == "quarantine" and got[3][1] == hopeless
    assert got[4] == ("accepted", "Only English لا") and got[5] == got[6] == ("accepted", "")
    assert spark.createDataFrame([(visual,)], "t string").select(T.visual_order_ratio(F.col("t"))).first()[0] > T.VISUAL_ORDER_LIMIT
