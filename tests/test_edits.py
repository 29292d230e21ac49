"""Logs of edits against a list that is edited one operation after another; undo against literal cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.operators import cycles, edits

LIVE = "row_id string, doc_id long, ordinal int, req_id string, text string"
LOG = "op string, seq long, doc_id long, kind string, row_id string, expected string, pieces array<string>, req_ids array<string>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def one_by_one(live, log):
    """Documents as lists of rows; the audit is searched backwards for what a revert brings back."""
    documents, archived, outcomes, audit = {}, [], [], []
    for row_id, doc, _, req, text in sorted(live, key=lambda r: (r[1], r[2])):
        documents.setdefault(doc, []).append({"id": row_id, "req": req, "text": text or ""})
    for op, seq, doc, kind, row_id, expected, pieces, req_ids in sorted(log, key=lambda o: o[1]):
        pieces = [x.strip() for x in pieces or [] if x and x.strip()]
        req_ids = list(req_ids or [])

        def say(outcome, op=op, seq=seq, row_id=row_id):
            outcomes.append((op, seq, row_id, outcome))

        found = next(((rows, k) for rows in documents.values() for k, r in enumerate(rows) if r["id"] == row_id), None)
        if row_id is None:
            if kind != "add" or not pieces:
                say("refused")
                continue
            rows = documents.setdefault(doc, [])
            rows += [{"id": f"{op}.{k}", "req": (req_ids + [None] * 9)[k], "text": x} for k, x in enumerate(pieces)]
            say("applied")
            continue
        if found is None:
            say("missing")
            continue
        rows, k = found
        row = rows[k]
        if kind not in ("edit", "split", "delete", "revert", "add") or (kind in ("edit", "add") and not pieces) or (kind == "split" and len(pieces) < 2):
            say("refused")
        elif kind != "add" and expected is not None and expected != sha(row["text"]):
            say("conflict")
        elif kind == "add":
            rows[k + 1 : k + 1] = [{"id": f"{op}.{i}", "req": (req_ids + [None] * 9)[i], "text": x} for i, x in enumerate(pieces)]
            say("applied")
        elif kind == "delete":
            audit.append((row_id, row["text"], kind, row["req"]))
            archived.append((row_id, row["req"], row["text"], seq))
            del rows[k]
            say("applied")
        else:
            last = next((a for a in reversed(audit) if a[0] == row_id and a[1]), None)
            new = (last and last[1]) if kind == "revert" else pieces[0]
            if kind in ("edit", "revert") and new in (None, row["text"]):
                say("unchanged")
                continue
            ids = [x or row["req"] for x in (req_ids + [None] * 9)[: len(pieces)]] if kind == "split" else [row["req"]] * max(1, len(pieces))
            audit.append((row_id, row["text"], kind, row["req"]))
            row["text"], row["req"] = new, last[3] if kind == "revert" and last[2] == "split" else ids[0]
            if kind != "revert":
                rows[k + 1 : k + 1] = [{"id": f"{op}.{i}", "req": ids[i], "text": x} for i, x in enumerate(pieces[1:], 1)]
            say("applied")
    final = {(doc, n, r["id"], r["req"], r["text"]) for doc, rows in documents.items() for n, r in enumerate(rows)}
    return final, set(archived), set(outcomes)


def outcome(spark, live, log):
    found = edits.fold(spark.createDataFrame(live, LIVE), spark.createDataFrame(log, LOG).repartition(3), Scratch(spark, "t"))
    rows = {(r.doc_id, r.ordinal, r.row_id, r.req_id, r.text) for r in found["live"].collect()}
    return rows, {(r.row_id, r.req_id, r.text, r.seq) for r in found["archived"].collect()}, {(r.op, r.seq, r.row_id, r.outcome) for r in found["outcomes"].collect()}


BASE = [("a", 1, 0, "FR-1", "one"), ("b", 1, 5, "FR-2", "two"), ("c", 2, 0, None, None)]


def test_an_operation_sees_what_those_before_it_left(spark):
    log = [
        ("e1", 1, None, "edit", "a", sha("one"), ["uno"], None), ("e2", 2, None, "edit", "a", sha("one"), ["une"], None),  # the second saw the first text
        ("s", 3, None, "split", "a", sha("uno"), ["u", "n", "o"], ["X-1", None, "X-3"]), ("r", 4, None, "revert", "a", None, None, None),
        ("n1", 5, None, "add", "s.1", None, ["after n"], ["N-1"]), ("n2", 6, None, "add", "s.1", None, ["right after n", " "], None), ("d", 7, None, "delete", "s.1", sha("n"), None, None),
        ("n3", 8, None, "add", "s.1", None, ["too late"], None), ("m", 9, None, "edit", "n1.0", sha("after n"), ["deep"], None), ("x", 10, None, "edit", "n3.0", None, ["never made"], None),
        ("end", 11, 1, "add", None, None, ["last", "very last"], None), ("new", 12, 9, "add", None, None, ["other document"], None), ("q", 13, None, "rename", "b", None, ["?"], None),
        ("u", 14, None, "edit", "b", None, ["two"], None), ("v", 15, None, "revert", "b", None, None, None), ("w", 16, None, "split", "b", None, ["alone"], None), ("early", 0, None, "edit", "end.0", None, ["before it is there"], None),
        ("l1", 17, None, "add", "l2.0", None, ["round"], None), ("l2", 18, None, "add", "l1.0", None, ["round"], None), ("f", 19, None, "edit", "c", sha(""), ["filled"], None), ("g", 20, None, "revert", "c", None, None, None),
    ]
    got, expected = outcome(spark, BASE, log), one_by_one(BASE, log)
    assert got == expected
    assert {o: r for o, _, _, r in got[2]} | {"e2": "conflict", "n3": "missing", "x": "missing", "early": "missing", "v": "unchanged", "q": "refused"} == {o: r for o, _, _, r in got[2]}
    assert outcome(spark, BASE, []) == one_by_one(BASE, []) and outcome(spark, [], log[:3])[0] == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    """Several documents, rows made of made rows, one row with most of the operations."""
    pick = random.Random(seed)
    live = [(f"r{i}", i % 3, i, f"FR-{i}", f"text {i}") for i in range(9)]
    ids, log = [r[0] for r in live], []
    for k in range(160):
        target = "r0" if pick.random() < 0.4 else pick.choice(ids)
        kind = pick.choice(["edit", "edit", "split", "delete", "revert", "add", "add"] if target != "r0" else ["edit", "edit", "split", "revert", "add"])
        pieces = [pick.choice(["x", "y", f"z{k}"]) for _ in range(pick.randint(1, 3))]
        expected = pick.choice([None, None, sha("x"), sha("y"), sha("text 0")])
        log.append((f"o{k}", k, k % 3, kind, None if kind == "add" and pick.random() < 0.2 else target, expected, pieces, [f"I-{k}"] if kind == "split" else None))
        ids += [f"o{k}.{i}" for i in range(len(pieces))]
    assert outcome(spark, live, log) == one_by_one(live, log)


def test_undo(spark):
    """An amended verdict turns back and stays, a fresh one goes; not another tester's, not an old one; notes keep the status."""
    rows = [
        ("fresh", 1, 0, "t", "status", "failed", None), ("fresh", 2, 90, "t", "status", "passed", None), ("amended", 3, 90, "t", "status", "passed", "failed"), ("first", 4, 95, "t", "status", "passed", None),
        ("other", 5, 95, "u", "status", "passed", "blocked"), ("old", 6, 10, "t", "status", "passed", "failed"), ("note", 7, 50, "t", "status", "failed", None), ("note", 8, 99, "t", "note", None, None),
        ("old note", 9, 5, "t", "status", "blocked", None), ("old note", 10, 6, "u", "note", None, None),
    ]
    entries = spark.createDataFrame(rows, "uid string, event_id long, s long, tester string, kind string, status string, amended_from string").selectExpr("*", "cast(timestamp_seconds(s) as timestamp_ntz) ts")
    requests = entries.select("uid").distinct().withColumn("by", F.lit("t"))
    got = {(r.uid, r.event_id, r.status, r.undone) for r in cycles.undo(entries, requests, "uid", F.timestamp_seconds(F.lit(100)), 30).collect()}
    assert got == {
        ("fresh", 2, "failed", "removed"), ("amended", 3, "failed", "reverted"), ("first", 4, "not_tested", "removed"), ("other", 5, "passed", "refused"), ("old", 6, "passed", "refused"),
        ("note", 8, "failed", "removed"), ("old note", 10, "blocked", "refused"),
    }
