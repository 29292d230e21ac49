"""The vector index against exact search; rows cut at anchors against literal cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.operators import retrieval, rows, vector_index
from tracewell.plans.retrieval import QUERIES


def lists(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.score))
    return found


def test_recall_over_the_table(spark, sf_dir):
    recall = QUERIES["r1_index_recall"](spark, sf_dir).agg(F.sum("found").alias("f"), F.sum("exact").alias("e")).first()
    assert recall.f / recall.e >= 0.9


def test_index_against_exact_search(spark, monkeypatch):
    """Clusters and noise, one vector a third of all rows, small blocks: recall at least 0.9, and all lists probed give the exact ones."""
    monkeypatch.setattr(vector_index, "BLOCK", 200)
    random = np.random.default_rng(8)
    middles = random.normal(size=(40, 24))
    x = np.concatenate([middles[random.integers(0, 40, 2000)] + random.normal(size=(2000, 24)) * 0.4, random.normal(size=(400, 24)), np.repeat(middles[:1], 1200, axis=0)])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(6)
    queries = table.where("id % 40 = 0").selectExpr("id as query_id", "v as q")
    index = vector_index.VectorIndex(table, Scratch(spark, "t"))
    assert index.filed.count() == len(x) and index.blocks.agg(F.max("blocks")).first()[0] > 1
    exact, found = lists(retrieval.vector_topk(queries, table)), lists(index.topk(queries))
    assert exact.keys() == found.keys()
    # of equal scores any is right
    assert np.mean([sum(s >= exact[q][-1][1] for _, s in found[q]) / 20 for q in exact]) >= 0.9
    assert lists(index.topk(queries, probes=10_000)) == exact


def test_index_of_odd_vectors(spark):
    rows_ = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.1], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [float("nan"), 1.0], "x"), (6, [None, 1.0], "x"), (7, [1.0], "x"), (8, [], "x")]
    table = spark.createDataFrame(rows_, "id long, v array<float>, list string")
    index = vector_index.VectorIndex(table, Scratch(spark, "t"))
    assert {q: [i for i, _ in found] for q, found in lists(index.topk(table.selectExpr("id as query_id", "v as q"))).items()} == {1: [2], 2: [1]}
    none = vector_index.VectorIndex(table.limit(0), Scratch(spark, "t"))
    assert none.topk(table.selectExpr("id as query_id", "v as q")).collect() == []


@pytest.mark.parametrize(
    ("text", "anchors", "expected"),
    [
        ("Head | a | 1 | b | 2", ["a |", "b |"], ["Head | a | 1 |", "b | 2"]),  # what stands before stays with the first row
        ("x 1 y 2 x 3", ["x", "y", "x"], ["x 1", "y 2", "x 3"]),
        ("one two three four", ["three", "one", "two", "four"], ["one", "two three", "four"]),  # the longest chain, not the first anchor
        ("a b c", ["c", "nowhere", "a"], ["a b c"]),  # one after another only one stands
        ("FR-1  log\tin FR-2 out", ["FR-1 log in", "FR - 2\n out"], ["FR-1  log\tin", "FR-2 out"]),
        ("aa aa", ["aa", "aa", "aa"], ["aa", "aa"]),
        ("a(b) [c] a(b)", ["a(b)", "a(b)"], ["a(b) [c]", "a(b)"]),
        ("ab", ["ab", "b"], ["ab"]),  # anchors don't overlap
        ("  \t ", ["a"], []),
        ("plain", [], ["plain"]),
    ],
)
def test_rows_at_anchors(text, anchors, expected):
    assert rows.rows_at(text, anchors) == expected
    assert "".join("".join(expected).split()) == "".join(text.split())


def test_split_rows(spark):
    given = [(1, " a | 1 | b | 2 ", ["a", "b"]), (2, "a | b", None), (3, None, ["a"]), (4, "", ["a", "b"]), (5, "a b", [None, " ", "a", "b"]), (6, "a\nb | |", ["a", "b"])]
    got = spark.createDataFrame(given, "id int, t string, anchors array<string>").select("id", rows.split_rows(F.col("t"), F.col("anchors")).alias("r"), rows.looks_flattened(F.col("t")).alias("f"))
    assert {r.id: (r.r, r.f) for r in got.collect()} == {1: (["a | 1 |", "b | 2"], True), 2: (["a | b"], False), 3: ([], False), 4: ([], False), 5: (["a", "b"], False), 6: (["a", "b | |"], False)}
