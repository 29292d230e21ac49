"""Every registered query of the library itself against its SQL; those without SQL against plain Python."""

from __future__ import annotations

from collections import defaultdict

import compare
import pytest

import __spark_entry__
from tracewell.plans import edits, intake, pages, records, relational, retrieval, suites, trees, versions

SQL = {**retrieval.ORACLE, **records.ORACLE, **relational.ORACLE, **suites.ORACLE, **intake.ORACLE, **edits.ORACLE, **pages.ORACLE, **trees.ORACLE, **versions.ORACLE}
QUERIES = {**retrieval.QUERIES, **records.QUERIES, **relational.QUERIES, **suites.QUERIES, **intake.QUERIES, **edits.QUERIES, **pages.QUERIES, **trees.QUERIES, **versions.QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, con, name):
    compare.assert_same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", ["st_tumbling", "st_sessions", "st_first_seen", "st_latest"])
def test_streams_read_tables_of_several_parts(spark, sf_dir, con, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    compare.assert_same(QUERIES[name](spark, str(tmp_path)), con, SQL[name])


def test_entry_points(spark):
    assert set(SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_admitted(spark, sf_dir, con):
    hits = con.execute("select event_id, user_id, epoch_us(ts) from events order by user_id, ts, event_id").fetchall()
    admitted, expected = defaultdict(list), {}
    for event, user, at in hits:
        expected[event] = sum(at - x < 86_400_000_000 for x in admitted[user]) < 3
        if expected[event]:
            admitted[user].append(at)
    assert {r.event_id: r.admitted for r in QUERIES["w6_admitted"](spark, sf_dir).collect()} == expected


def test_last_turns(spark, sf_dir):
    got = {r.conv_id: r.history for r in QUERIES["q9_last_turns"](spark, sf_dir).collect()}
    by_conv = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by_conv[r.conv_id].append((r.turn, r.role))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        roles = [role for _, role in sorted(turns, key=lambda t: t[0])[-6:]]
        lines = got[conv].split("\n")
        assert len(lines) == len(roles) and all(x.startswith(role) for x, role in zip(lines, roles, strict=True))


@pytest.mark.parametrize("name", ["r10_max_passage", "a4_classify", "t3_sentence_windows", "t7_token_chunks", "s6_sections"])
def test_reruns_agree(spark, sf_dir, name):
    first, second = (compare.spark_rows(QUERIES[name](spark, sf_dir)) for _ in range(2))
    assert first == second and first[1]


def test_windows_lose_no_text(spark, sf_dir):
    """Whatever the windows, a document's words come back in order."""
    from tracewell.functions import chunking

    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect():
        pieces = [p for (p,) in chunking.sentence_windows(r.text)]
        assert "".join("".join(pieces).split()) == "".join(r.text.split())


def test_windows_keep_whole_sentences():
    from tracewell.functions import chunking

    text = "1. First item. It goes on, e.g. here.  Second one! Is it? " + "w " * 900 + "end. Last."
    assert chunking.sentences("3.\nExecution starts. A. B. Done") == ["3. Execution starts.", "A. B. Done"]
    pieces = [p for (p,) in chunking.sentence_windows(text, 100)]
    assert pieces[0] == "1. First item. It goes on, e.g. here. Second one! Is it?" and pieces[-1] == "Last."
    assert all(len(p) <= 100 for p in pieces) and " ".join(pieces).split() == text.split()
    assert list(chunking.sentence_windows("")) == [] and list(chunking.token_chunks(" \n\n ")) == []


def test_token_chunks_overlap():
    from tracewell.functions import chunking

    text = " ".join(f"w{i} x y z." for i in range(10))
    chunks = list(chunking.token_chunks(text, most=10, overlap=4))
    assert [n for _, n in chunks] == [8] * 9 and all(a[0].split()[4:] == b[0].split()[:4] for a, b in zip(chunks, chunks[1:], strict=False))
    assert [n for _, n in chunking.token_chunks("a b c d e f g", most=3, overlap=1)] == [3, 3, 1]


def test_window_speed():
    """100 KB in under 1.5 s, the figure to match."""
    import time

    from tracewell.functions import chunking

    text = "A sentence of some words that ends here. " * 2500
    began = time.perf_counter()
    assert sum(len(p) for (p,) in chunking.sentence_windows(text)) > 100_000 - 2600
    assert time.perf_counter() - began < 1.5


@pytest.mark.parametrize(
    ("a", "b", "change"),
    [
        ("passed", "failed", "regressed"), ("failed", "blocked", "still_failing"), ("not_tested", "failed", "new_failure"), (None, "failed", "new_failure"),
        ("failed", "passed", "fixed"), ("passed", "passed", "still_passing"), ("not_tested", "passed", "newly_passing"), ("passed", "not_tested", "not_rerun"),
        ("blocked", "in_progress", "not_rerun"), ("not_tested", "not_tested", "not_run"), (None, "in_progress", "not_run"), ("passed", None, "dropped"),
    ],
)
def test_run_changes(spark, a, b, change):
    from pyspark.sql import functions as F

    from tracewell.operators import timeline

    row = spark.createDataFrame([(a, b)], "a string, b string").select(timeline.run_change(F.col("a"), F.col("b")).alias("c")).first()
    assert row.c == change


def test_text_forms(spark):
    from pyspark.sql import functions as F

    from tracewell.functions import text as T

    def of(f, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]

    assert of(T.requirement_id, "FR 2", "REQ-12.3", "fr-2", "For 3 users", "ISO 9001", "FR3", "FR-3a", "UC-A-1") == ["FR-2", "REQ-12.3", None, None, None, "FR3", "FR-3a", "UC-A-1"]
    assert of(T.opening_id, "US-02: x", "FR-3 The system", "US-02 so that", "FR-4, FR-5 and FR-6", "Same as US-01") == ["US-02", "FR-3", None, None, None]
    assert of(T.heading_id, "3.2 FR-3 Login", "Login (FR-3)", "Functional Requirements (FR-1 to FR-20)") == ["FR-3", "FR-3", None]
    assert of(T.word_set, "snake_case a bb") == [["snake_case", "bb"]]
    assert of(T.row_text, "intro\nmore\n| h | k |\n| a | b |", "| h |\n|---|\n| a |", None) == ["| a | b |", "| h |\n|---|\n| a |", ""]
    assert of(T.visual_order_ratio, "إدارة المحافظ", "كتابلا") == [0.0, 1.0]


def test_amendments(spark):
    """Re-verdicts in reach fold; the last status that differed is remembered; another tester or a note begins anew."""
    from tracewell.operators import timeline

    rows = [(1, "u", 0, "t1", "status", "failed"), (2, "u", 100, "t1", "status", "passed"), (3, "u", 350, "t1", "status", "passed"), (4, "u", 400, "t2", "status", "failed"),
            (5, "u", 410, "t2", "note", "failed"), (6, "u", 420, "t2", "status", "blocked"), (7, "v", 0, "t1", "status", "passed"), (8, "v", 301, "t1", "status", "failed")]
    events = spark.createDataFrame(rows, "event_id long, uid string, s long, tester string, kind string, status string").selectExpr("*", "cast(timestamp_seconds(s) as timestamp_ntz) ts")
    got = {(r.event_id, r.status, r.amended_from, r.amendments) for r in timeline.amended(events, "uid", ["tester"]).collect()}
    assert got == {(1, "passed", "failed", 2), (4, "failed", None, 0), (5, "failed", None, 0), (6, "blocked", None, 0), (7, "passed", None, 0), (8, "failed", None, 0)}


def test_alignment_orders_by_the_uncapped_sum(spark):
    """Two rows of one section, one of them equal in words: the sum over one decides, and then is capped."""
    from tracewell.functions.scratch import Scratch
    from tracewell.operators import alignment

    rows = lambda x: spark.createDataFrame([(*r, f"h{r[0]}{r[1]}") for r in x], "idx long, text string, req_id string, section string, content_hash string")
    live = rows([(1, "alpha beta gamma delta", "", "s"), (2, "alpha beta gamma delta!", "", None), (3, "h | k\nrow | one", None, None)])
    new = rows([(11, "alpha, beta gamma delta", "", None), (12, "alpha; beta gamma delta", "", "s"), (13, "h | k\nother | thing", None, None)])
    got = {(r.live_idx, r.new_idx, r.similarity) for r in alignment.align(live, new, Scratch(spark, "t")).collect()}
    assert got == {(1, 12, 1.0), (2, 11, 1.0)}
    changes = {(r.change, r.live_idx, r.new_idx) for r in alignment.classify(live, new, alignment.align(live, new, Scratch(spark, "t"))).collect()}
    assert ("removed", 3, None) in changes and ("added", None, 13) in changes
