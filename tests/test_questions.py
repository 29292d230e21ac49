"""Literal cases of question forms, span edits and token batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewell.functions import questions
from tracewell.operators import batches


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "verdict"), [("safe", True), ("Safe", False), ("User Safety: unsafe\n\nS1, S2", True), ("safe fares", False), ("", False), (None, False), ("S1\n" * 5, False)])
def test_verdicts(spark, text, verdict):
    assert value(spark, questions.is_verdict(F.lit(text).cast("string"))) is verdict


@pytest.mark.parametrize(
    ("rewrite", "question", "usable"),
    [("late payments", "Which payments are late?", True), ("unsafe", "unsafe payments", False), (None, "payments", False), ("payments " * 60, "payments", False),
     ("الدفع المتأخر", "Which payments are late?", True), ("roles", "Which payments?", False)],
)
def test_rewrites(spark, rewrite, question, usable):
    assert value(spark, questions.is_usable_rewrite(F.lit(rewrite).cast("string"), F.lit(question), F.lit(None).cast("string"))) is usable


@pytest.mark.parametrize(("text", "key"), [("What are the ROLES ?!", "what are the roles"), ("ما هي الأدوار؟", "ما هي الأدوار"), ("???", ""), (None, "")])
def test_keys(spark, text, key):
    assert value(spark, questions.question_key(F.lit(text).cast("string"))) == key


@pytest.mark.parametrize(
    ("text", "find", "by", "new"),
    [("a b c", "b", "x", "a x c"), ("a  b\nc", "b c", "x", "a  x"), ("a$1 b", "$1", r"\0", r"a\0 b"), ("a b", "", "x", None), ("a b", "b", "", None), ("a b", None, "x", None),
     (None, "a", "x", None), ("aXb", "a b", "x", None), ("ab", "a b", "x", "x")],
)
def test_edits(spark, text, find, by, new):
    text, find, by = (F.lit(x).cast("string") for x in (text, find, by))
    assert value(spark, questions.edited(text, find, by)) == new


def test_batches_hold_every_missing_text_once(spark):
    rows = [(f"h{k % 300}", "x" * (k % 300 * 100)) for k in range(600)] + [("none", None)]
    inputs = spark.createDataFrame(rows, "embed_hash string, text string").repartition(3)
    cache = spark.createDataFrame([("h1",), ("h299",)], "embed_hash string")
    found = batches.token_batches(inputs, cache).collect()
    assert sorted(r.embed_hash for r in found) == sorted({f"h{k}" for k in range(300)} - {"h1", "h299"})
    for batch in {r.batch for r in found}:
        mine = [r.tokens for r in found if r.batch == batch]
        assert len(mine) == 1 or (len(mine) <= batches.BATCH_TEXTS and sum(mine) <= batches.BATCH_TOKENS)
    assert batches.token_batches(inputs.limit(0), cache).count() == 0
