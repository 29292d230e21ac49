"""Publishing by literal cases."""

from __future__ import annotations

from tracewell.operators import versions

ROWS = "scope string, uid long, ordinal int, folder_path array<string>, def_hash string, content_hash string, basis_hash string, req_hashes map<string, string>, data struct<title string, expected_behaviour string>"


def row(scope, uid, ordinal=0, path=(), title="t", expected="e", req="r"):
    return (scope, uid, ordinal, list(path), f"d{expected}", f"c{title}{expected}", f"b{expected}{req}", {"7": req}, (title, expected))


def publish(spark, draft, latest, numbers=(), expected=()):
    frames = [spark.createDataFrame(rows, ROWS) for rows in (draft, latest)]
    rest = [spark.createDataFrame(list(numbers), "scope string, number long"), spark.createDataFrame(list(expected), "scope string, expect string")]
    return versions.publish(*frames, *rest, "scope", ["title", "expected_behaviour"])


def test_publish(spark):
    latest = [row("a", 1), row("a", 2), row("a", 3), row("a", 4), row("a", 5), row("b", 6), row("c", 7)]
    draft = [row("a", 1, 4), row("a", 2, 0, ["x"], "new", "new"), row("a", 3, 0, ["x"]), row("a", 4, req="other"), row("a", 9), row("b", 6), row("d", 10)]
    outcomes, members, audit = publish(spark, draft, latest, [("a", 1), ("a", 4), ("b", 2), ("c", 1)])
    got = {r.scope: r for r in outcomes.collect()}
    assert {s: (r.outcome, r.number) for s, r in got.items()} == {"a": ("published", 5), "b": ("unchanged", 2), "c": ("empty", 1), "d": ("published", 1)}
    assert [got["a"][c] for c in (*versions.CHANGES, "retest")] == [1, 1, 1, 1, 1, 1, 0, 2] and got["c"].removed == 1
    assert sorted((r.scope, r.number, r.uid) for r in members.collect()) == [("a", 5, 1), ("a", 5, 2), ("a", 5, 3), ("a", 5, 4), ("a", 5, 9), ("d", 1, 10)]
    assert {(r.uid, r.action, r.summary) for r in audit.collect()} == {
        (2, "version_modified", "Published in v5 — modified (title, expected behaviour), moved"),
        (3, "version_moved", "Published in v5 — moved"),
        (4, "version_requirement_changed", "Published in v5 — requirement changed"),
        (5, "version_removed", "Published in v5 — removed"),
        (9, "version_added", "Published in v5 — added"),
        (10, "version_added", "Published in v1 — added"),
    }


def test_only_what_was_reviewed(spark):
    seen = [row("a", 1, path=["x", "y"]), row("a", 2, None)]
    prints = lambda rows: versions.fingerprint(spark.createDataFrame(rows, ROWS), "scope").first().fingerprint
    shown = prints(seen)
    assert shown == prints(seen[::-1])
    others = [[seen[0]], [*seen, row("a", 3)], [seen[0], row("a", 2, 0)], [row("a", 1, path=["x,y"]), seen[1]], [row("a", 1, path=["x", "y"], req="z"), seen[1]], [seen[0], seen[0], seen[1]]]
    assert len({shown, *map(prints, others)}) == len(others) + 1
    for draft, outcome in ((seen, "published"), (others[3], "stale")):
        assert [r.outcome for r in publish(spark, draft, [], [], [("a", shown)])[0].collect()] == [outcome]
    assert publish(spark, [], [])[0].collect() == publish(spark, [], [])[2].collect() == []


def test_case_in_version_and_labels(spark):
    members = spark.createDataFrame([(1, 5, "c", ["x"], {"7": "h", "12": "g", "8": None}), (2, 6, "c", [], {})], "version long, uid long, content_hash string, folder_path array<string>, req_hashes map<string, string>")
    contents, texts = spark.createDataFrame([("c", "body")], "content_hash string, data string"), spark.createDataFrame([("h", "text")], "hash string, text string")
    asked = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (1, 6)], "version long, uid long")
    got = {(r.version, r.uid): r for r in versions.case_in_version(asked, members, contents, texts).collect()}
    assert [tuple(r) for r in got[1, 5].requirements] == [(7, "text"), (8, None), (12, None)] and got[1, 5].data == "body"
    assert got[2, 6].found and got[2, 6].requirements == [] and not got[1, 6].found and got[1, 6].requirements is None
    kept = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "version long, label string")
    labels = spark.createDataFrame([(1, "  " + "x" * 300), (2, "  ")], "version long, new_label string")
    assert {r.version: r.label for r in versions.set_label(kept, labels).collect()} == {1: "x" * 200, 2: None, 3: "old"}
