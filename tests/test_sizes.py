"""What only shows at size: limits, growth and uneven groups, on rows small enough to check."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch


def test_ancestors_have_no_row_limit(spark):
    """A recursive query of Spark stops at its row limit; a chain deeper than 100 and a node with two parents are walked too."""
    from tracewell.operators import trees

    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        links = [(k, k - 1 if k > 1 else None) for k in range(1, 131)] + [(200, 3), (200, 2)]
        found = trees.ancestors(spark.createDataFrame(links, "id long, parent long"), Scratch(spark, "t")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    expected = Counter((k, a) for k in range(1, 131) for a in range(1, k)) + Counter([(200, 3), (200, 2), (200, 1), (200, 2), (200, 1)])
    assert Counter(map(tuple, found)) == expected
    with pytest.raises(ValueError, match="cycle"):
        trees.ancestors(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long"), Scratch(spark, "t"))


def test_closure_has_no_row_limit(spark, sf_dir):
    from tracewell.plans import relational

    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        assert relational.QUERIES["j5_closure"](spark, sf_dir).count() > 50
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_written_files_are_read_again():
    """A text that repeats itself shrinks more than a reader allows; the reader's limit stays."""
    from tracewell.sources import docx

    for text in ("La " * 20_000, "La", "".join(chr(97 + k * k % 26) for k in range(50_000))):
        assert docx.docx_markdown(docx.PackageWriter().write([("title", "T"), ("text", text)])).blocks == ["# T", text.strip()]


def test_long_sections_take_no_square_of_time(spark):
    """A frame from a row to the section's end is made anew for every row: there is none."""
    from tracewell.operators import units

    text = "# T\n\n" + "\n\n".join(f"FR-{k} The user {k} pays." for k in range(2000))
    found = units.upload_chunks(units.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert "1, unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert sorted(map(tuple, found.select("ordinal", "req_id").collect())) == [(k, f"FR-{k}") for k in range(2000)]


def test_anchors_stand_where_a_pattern_finds_them():
    """Plain search against the pattern it replaces; no pattern is compiled for a row."""
    import random
    import re

    from tracewell.operators import rows

    assert not hasattr(rows, "re")
    pick = random.Random(3)
    for _ in range(3000):
        text = "".join(pick.choice("ab \n\u00a0|") for _ in range(pick.randint(0, 30)))
        words = [w for w in ("".join(pick.choice("ab|") for _ in range(pick.randint(1, 3))) for _ in range(pick.randint(1, 3)))]
        found = [m.span() for m in re.finditer(r"\s*".join(map(re.escape, words)), text)]
        assert list(rows._stands(text, words)) == found, (text, words)


def test_lines_of_a_table_are_split_once(spark):
    from pyspark.sql import functions as F

    from tracewell.functions import text as T

    plan = spark.range(1).select(T.table_pieces(F.col("id").cast("string")).alias("p"), T.looks_table(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 2
    texts = ["T\n| a |\n|---|\n| 1 |\n| 2 |", "plain", "| a |", "| a |\n|:-|", "", None, "x\n\n| a | b |\n| c |"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.table_pieces(F.col("t")).alias("p"), T.looks_table(F.col("t")).alias("x")).orderBy("i").collect()
    assert [(r.p, r.x) for r in df] == [
        (["T\n| a |\n| 1 |", "T\n| a |\n| 2 |"], True), (["plain"], False), (["| a |"], False), (["| a |\n|:-|"], True), ([""], False), ([None], None), (["x\n| a | b |\n| c |"], True),
    ]


def test_batches_send_no_text_to_python(spark):
    from pyspark.sql import functions as F

    from tracewell.operators import batches

    inputs = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("embed_hash"), F.repeat(F.col("id").cast("string"), 100).alias("text"))
    found = batches.token_batches(inputs, inputs.where("false"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "_fill(tokens#" in plan
    rows = found.collect()
    sizes = Counter(r.batch for r in rows)
    tokens = Counter()
    for r in rows:
        tokens[r.batch] += r.tokens
    assert len(rows) == 300 and len({r.embed_hash for r in rows}) == 300 and all(r.text for r in rows)
    assert all(n == 1 or (n <= 64 and tokens[b] <= 3500) for b, n in sizes.items())


def test_outcomes_need_no_ordinals(spark, monkeypatch):
    """Live rows are numbered only when they are asked for."""
    from tracewell.operators import edits

    monkeypatch.setattr(edits, "_numbered", lambda *_: 1 / 0)
    live = spark.createDataFrame([("a", 1, 0, None, "x")], "row_id string, doc_id long, ordinal long, req_id string, text string")
    log = spark.createDataFrame([("o", 1, None, "edit", "a", None, ["y"], None)], "op string, seq long, doc_id long, kind string, row_id string, expected string, pieces array<string>, req_ids array<string>")
    assert [r.outcome for r in edits.fold(live, log, Scratch(spark, "t"))["outcomes"].collect()] == ["applied"]


def test_similar_pairs_carry_no_words(spark, monkeypatch):
    """Word sets go to units of pairs, not to each pair; all pairs, as by brute force, in one unit or in many."""
    import random

    from tracewell.operators import alignment

    pick = random.Random(5)
    texts = [" ".join(f"w{min(pick.randrange(1, 60), pick.randrange(1, 60))}" for _ in range(pick.choice((1, 4, 12, 13, 30)))) for _ in range(120)] + ["", "a"]
    a, b = texts[:70], texts[50:]
    expected = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s, t = ({w for w in v.split() if len(w) > 1} for v in (x, y))
            if s and t and len(s & t) / len(s | t) >= 0.45:
                expected[i, j] = len(s & t) / len(s | t)
    live, new = (spark.createDataFrame(list(enumerate(v)), "idx long, text string") for v in (a, b))
    for limits in ({}, {"UNIT_PAIRS": 7, "UNIT_SETS": 9, "SLICE": 2}):
        for name, value in limits.items():
            monkeypatch.setattr(alignment, name, value)
        found = alignment.similar_pairs(live, new)
        assert {(r.live_idx, r.new_idx): r.similarity for r in found.collect()} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "CoGroups" in plan
    scoped = [v.withColumn("scope", F.col("idx") % 2) for v in (live, new)]
    found = alignment.similar_pairs(*scoped, by=("scope",)).collect()
    assert {(r.live_idx, r.new_idx) for r in found} == {k for k in expected if k[0] % 2 == k[1] % 2}
    assert alignment.similar_pairs(live.limit(0), new).count() == 0


def test_similar_pairs_write_no_candidates(spark, monkeypatch):
    """Sets that share rare words but are not similar: no table grows with the pairs of them."""
    from tracewell.operators import alignment

    rows, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    sets = [[" ".join(f"w{k:02}" for k in range(12) if k != i % 6 + shift) for i in range(100)] for shift in (0, 6)]
    live, new = (spark.createDataFrame(list(enumerate(v)), "idx long, text string") for v in sets)
    assert alignment.similar_pairs(live, new, least=0.9).count() == 0
    assert alignment.similar_pairs(live, new, least=0.8).count() == 10_000  # ten of twelve words each
    assert max(rows.values()) <= 100


def test_equal_rows_take_no_round_each(spark, monkeypatch):
    """Pairs of equal scores: the same pairs as in their order one by one, in rounds or in the last task."""
    import random

    from tracewell.operators import alignment

    pick, names, save = random.Random(3), [], Scratch.save
    ties = [(f"l{i:02}", f"n{j:02}", 0.5) for i in range(12) for j in range(12)]
    ties += [(f"m{pick.randrange(20)}", f"ö{pick.randrange(20)}", pick.choice((0.5, 0.6, 0.7))) for _ in range(60)]
    ties = list({(x, y): (x, y, s) for x, y, s in ties}.values())
    expected, live, new = set(), set(), set()
    for s, y, x in sorted(((s, y.encode(), x) for x, y, s in ties), reverse=True):
        if x not in live and y not in new:
            expected.add((x, y.decode(), s))
            live.add(x)
            new.add(y)
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    rows = spark.createDataFrame(ties, "live_idx string, new_idx string, score double")
    found = lambda: {tuple(r) for r in alignment.greedy_pairs(rows, Scratch(spark, "t")).collect()}
    assert found() == expected and not [n for n in names if n.startswith("taken")]
    monkeypatch.setattr(alignment, "LAST_PAIRS", 100)
    assert found() == expected and "taken1" in names and "taken9" not in names
    assert alignment.greedy_pairs(rows.limit(0), Scratch(spark, "t")).count() == 0
