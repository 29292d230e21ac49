"""Trees against a walk from the roots, drafts against literal cases."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.operators import trees

FOLDERS = "id long, parent long, name string, ordinal int"
CASES = "id long, folder_id long, ordinal int, name string"


def walk(folders, cases):
    """The tree as a reader goes through it."""
    ids, lines = {f[0] for f in folders}, []

    def order(row):
        return (row[-1] is None, row[-1] or 0, row[0])

    def visit(folder, path):
        at = len(lines)
        lines.append(None)
        n = 0
        for child in sorted((f for f in folders if f[1] == folder[0]), key=order):
            n += visit(child, [*path, child[2]])
        for case in sorted((c for c in cases if c[1] == folder[0]), key=lambda c: (c[2] is None, c[2] or 0, c[0])):
            lines.append(("case", case[0], folder[0], case[3], len(path) + 1, path, None))
            n += 1
        lines[at] = ("folder", folder[0], folder[1], folder[2], len(path), path, n)
        return n

    for root in sorted((f for f in folders if f[1] is None or f[1] not in ids), key=order):
        visit(root, [root[2]])
    return [(i, *line) for i, line in enumerate(lines)]


def test_tree_reads_as_a_walk(spark):
    pick = random.Random(5)
    folders = [(k, pick.choice([None, *range(k)]) if k else None, f"f{k % 9}", pick.choice([None, 0, 1, 2])) for k in range(60)]
    folders += [(k, k - 1 if k > 100 else 3, "deep", None) for k in range(100, 140)]  # a chain of 40
    folders += [(200, 202, "round", 0), (201, 200, "round", 0), (202, 201, "round", 0), (203, 203, "self", 0), (204, 201, "below a cycle", 0), (205, 999, "lost parent", 1), (206, 205, None, 1)]
    cases = [(k, pick.choice([None, 139, 206, 201, 888, *range(60)]), pick.choice([None, 1, 2]), f"c{k}") for k in range(300)]
    got = trees.tree(spark.createDataFrame(folders, FOLDERS), spark.createDataFrame(cases, CASES), Scratch(spark, "t"))
    got = sorted((r.position, r.kind, r.id, r.parent, r.name, r.depth, r.path, r.n_cases) for r in got.collect())
    assert got == walk(folders, cases)


def test_empty_trees(spark):
    none, cases = spark.createDataFrame([], FOLDERS), spark.createDataFrame([(1, 2, 3, "c")], CASES)
    assert trees.tree(none, cases, Scratch(spark, "t")).collect() == []
    only = trees.tree(spark.createDataFrame([(1, None, "a", None)], FOLDERS), cases.limit(0), Scratch(spark, "t")).collect()
    assert [(r.position, r.id, r.path, r.n_cases) for r in only] == [(0, 1, ["a"], 0)]
    assert trees.forest(spark.createDataFrame([(1, 2, "a", 0), (2, 1, "b", 0)], FOLDERS), Scratch(spark, "t")).collect() == []


def test_draft_rows(spark):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    cases = [
        (1, 0, 11, "d", ["7", "8", "7", "x", "07", "9", "1" * 30, "7\n", None], "Log in", None),
        (2, 1, 99, None, None, "Log out", "b"),
        (3, 2, None, "", [], None, None),
    ]
    schema = "uid long, ordinal int, folder_id long, def_hash string, citations array<string>, title string, kind string"
    req = "id long, req_id string, text string"
    live, archive = [(7, "FR-7", "now")], [(7, "FR-7", "then"), (8, None, "gone")]
    tables = [spark.createDataFrame(cases, schema), spark.createDataFrame([(10, None, "a", 0), (11, 10, "b", 0)], FOLDERS), spark.createDataFrame(live, req), spark.createDataFrame(archive, req)]
    got = {r.uid: r for r in trees.draft_rows(*tables, ["title", "kind"], Scratch(spark, "t")).collect()}
    assert got[1].folder_path == ["a", "b"] and got[2].folder_path == got[3].folder_path == []
    assert got[1].req_hashes == {"7": md5("now"), "8": md5("gone"), "9": None} and got[2].req_hashes == got[3].req_hashes == {}
    assert [tuple(r) for r in got[1].reqs] == [(md5("now"), "FR-7", "now"), (md5("gone"), None, "gone")]
    assert got[2].def_hash == "" and got[2].data.title == "Log out" and got[2].content_hash == md5("Log out\x1fb")
    assert got[1].basis_hash == md5(f"{got[1].content_hash}\x1f7:{md5('now')},8:{md5('gone')},9:null")
    assert got[3].content_hash == md5("[]") and got[3].basis_hash == md5(md5("[]") + "\x1f")
    assert trees.draft_rows(tables[0].limit(0), *tables[1:], ["title", "kind"], Scratch(spark, "t")).collect() == []


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """No task sorts a share of the rows that grows with them; places stay gapless."""
    monkeypatch.setattr(trees, "RANGE_ROWS", 10)
    keys = random.Random(5).sample(range(1000), 300)
    scratch = Scratch(spark, "test-ranges")
    rows = trees.numbered(spark.createDataFrame([([k // 7, k],) for k in keys], "key array<long>"), scratch)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and [(r.position, r.key[1]) for r in rows.orderBy("key").collect()] == list(enumerate(sorted(keys)))
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch.root}/position_ranges").groupBy(F.shiftright("_own", 33)).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 30
    assert trees.numbered(spark.createDataFrame([], "key array<long>"), Scratch(spark, "test-none")).count() == 0
