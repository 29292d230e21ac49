"""Suites of cases: diff of versions, snapshots, restore, decisions, change sets, histories, folders.

A case row has uid, ordinal, folder_path, def_hash, content_hash, basis_hash, req_hashes (requirement to hash) and data (a
struct of its fields). Every operation is one join by key or one aggregate, so nothing is gathered on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch

#: Fixed value: a change set has at most this many operations.
MAX_OPERATIONS = 50


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def diff(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(uid, change, fields, requirements, moved, retest): one change per case, the most significant; unchanged cases too.

    A case needs a retest where its tested definition or a requirement it cites differs.
    """
    sides = [rows.select("uid", F.struct(*[c for c in rows.columns if c != "uid"]).alias(name)) for rows, name in ((old, "a"), (new, "b"))]
    both = sides[0].join(sides[1], "uid", "full")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    hashes = [F.coalesce(f"{side}.req_hashes", F.create_map().cast("map<string,string>")) for side in "ab"]
    cited = F.array_union(F.map_keys(hashes[0]), F.map_keys(hashes[1]))
    other = F.filter(cited, lambda k: ~F.try_element_at(hashes[0], k).eqNullSafe(F.try_element_at(hashes[1], k)))
    edited = F.array_compact(F.array(*[F.when(_differs(f"a.data.{f}", f"b.data.{f}"), F.lit(f)) for f in fields]))
    empty = F.array().cast("array<string>")
    rows = both.select(
        "*",
        F.when(paired, edited).otherwise(empty).alias("fields"),
        F.when(paired, F.array_sort(other)).otherwise(empty).alias("requirements"),
        (paired & _differs("a.folder_path", "b.folder_path")).alias("moved"),
    )
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(_differs("a.content_hash", "b.content_hash"), "modified")
        .when(_differs("a.basis_hash", "b.basis_hash"), "requirement_changed")
        .when(F.col("moved"), "moved")
        .when(_differs("a.ordinal", "b.ordinal"), "reordered")
        .otherwise("unchanged")
    )
    retest = paired & (_differs("a.def_hash", "b.def_hash") | (F.size("requirements") > 0))
    return rows.select("uid", change.alias("change"), "fields", "requirements", "moved", retest.alias("retest"))


def publish(draft: DataFrame, latest: DataFrame, contents: DataFrame, scope: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A new version of each scope's draft: (scopes with ``changed``, member rows to append, contents to append).

    A scope whose draft equals its latest version gets no version; a content hash that is stored already is not stored again.
    """
    same = ["uid", "content_hash", "ordinal"]
    sides = [rows.select(scope, *same, F.lit(n).alias("_side")) for rows, n in ((draft, 1), (latest, -1))]
    odd = sides[0].unionByName(sides[1]).groupBy(scope, *same).agg(F.sum("_side").alias("_n"))
    scopes = odd.groupBy(scope).agg(F.coalesce(F.bool_or(F.col("_n") != 0), F.lit(False)).alias("changed"))
    members = draft.join(scopes.where("changed").select(scope), scope, "left_semi").select(scope, *same)
    fresh = members.select("content_hash").distinct().join(contents, "content_hash", "left_anti")
    return scopes, members, fresh


def restore(draft: DataFrame, version: DataFrame) -> DataFrame:
    """What makes the draft equal to a version: (uid, action) of remove, update, reinsert or keep."""
    kept = ["content_hash", "folder_path", "ordinal"]
    a = draft.select("uid", F.struct(*kept).alias("_draft"))
    b = version.select("uid", F.struct(*kept).alias("_version"))
    action = F.when(F.col("_version").isNull(), "remove").when(F.col("_draft").isNull(), "reinsert").when(_differs("_draft", "_version"), "update").otherwise("keep")
    return a.join(b, "uid", "full").select("uid", action.alias("action"))


def basis_rollback(version: DataFrame, live: DataFrame) -> DataFrame:
    """Requirements that a restored version cites at another text than the live one: (req_id, hash, gone).

    Their basis goes back to the cited hash, so that the next update takes them for changed; a requirement that is gone has
    none to set back. Where cases cite one at several texts, the last case's counts.
    """
    cited = version.select("uid", F.explode("req_hashes").alias("req_id", "hash")).where("hash is not null")
    last = cited.groupBy("req_id").agg(F.max_by("hash", "uid").alias("hash"))
    now = live.select("req_id", F.col("hash").alias("_now"))
    return last.join(now, "req_id", "left").where(_differs("hash", "_now")).select("req_id", "hash", F.col("_now").isNull().alias("gone"))


def match_snapshot(snapshot: DataFrame, live: DataFrame, aligned: DataFrame, archive: DataFrame) -> DataFrame:
    """Which kept row each snapshot row becomes again: (snap_id, target_id, via), a target taken once, by this order.

    live: the live row of the same id; aligned: a pair (snap_id, live_id) of the alignment, where that live row is free;
    archived: the archived row of the same original id; content: an archived row of the same content; else new.
    """
    ids = snapshot.select("snap_id", "content_hash")
    via_id = ids.join(live.select(F.col("live_id").alias("snap_id")), "snap_id", "left_semi").select("snap_id", F.col("snap_id").alias("target_id"), F.lit("live").alias("via"))
    open_ = ids.join(via_id, "snap_id", "left_anti")
    free = aligned.join(via_id.select(F.col("target_id").alias("live_id")), "live_id", "left_anti")
    via_text = open_.join(free, "snap_id").select("snap_id", F.col("live_id").alias("target_id"), F.lit("aligned").alias("via"))
    open_ = open_.join(via_text, "snap_id", "left_anti")
    via_old = open_.join(archive.select(F.col("archived_id").alias("snap_id")), "snap_id", "left_semi").select("snap_id", F.col("snap_id").alias("target_id"), F.lit("archived").alias("via"))
    open_ = open_.join(via_old, "snap_id", "left_anti")
    rest = archive.join(via_old.select(F.col("target_id").alias("archived_id")), "archived_id", "left_anti")
    nth = lambda key: F.row_number().over(Window.partitionBy("content_hash").orderBy(key))
    pairs = open_.withColumn("n", nth("snap_id")).join(rest.select("archived_id", "content_hash", nth("archived_id").alias("n")), ["content_hash", "n"], "left")
    last = pairs.select("snap_id", F.col("archived_id").alias("target_id"), F.when(F.col("archived_id").isNotNull(), "content").otherwise("new").alias("via"))
    return reduce(DataFrame.unionByName, [via_id, via_text, via_old, last])


def apply_edits(edits: DataFrame, live: DataFrame) -> DataFrame:
    """Edits (op_id, set_id, req_id, expected) against live rows (req_id, hash): adds ``outcome`` applied, conflict or missing.

    An edit without a req_id adds a row and always applies; another applies only where the row still has the expected hash.
    """
    found = edits.join(live.select("req_id", F.col("hash").alias("_now")), "req_id", "left")
    outcome = F.when(F.col("req_id").isNull(), "applied").when(F.col("_now").isNull(), "missing").when(_differs("_now", "expected"), "conflict").otherwise("applied")
    return found.withColumn("outcome", outcome).drop("_now")


def apply_change_sets(edits: DataFrame, live: DataFrame, done: DataFrame, most: int = MAX_OPERATIONS) -> DataFrame:
    """(set_id, n_ops, result): all of a set applies or nothing; a set that is done already is replayed, not applied again."""
    sets = apply_edits(edits, live).groupBy("set_id").agg(F.count("*").alias("n_ops"), F.count_if(F.col("outcome") != "applied").alias("bad"))
    marked = sets.join(done.select("set_id", F.lit(True).alias("_done")), "set_id", "left")
    result = F.when(F.col("_done"), "replayed").when(F.col("n_ops") > most, "too_large").when(F.col("bad") > 0, "rejected").otherwise("applied")
    return marked.select("set_id", "n_ops", result.alias("result"))


def decide(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each affected card with its decision; none or an unknown one keeps the card."""
    made = decisions.groupBy("uid").agg(F.min_by("decision", "seq").alias("decision"))
    known = F.when(F.col("decision").isin("update", "remove"), F.col("decision")).otherwise("keep")
    return cards.select("uid").join(made, "uid", "left").select("uid", known.alias("decision"))


def new_titles(proposed: DataFrame, existing: DataFrame, scope: str) -> DataFrame:
    """The first proposed card (seq) of each title in its scope that no existing card has, whatever the case."""
    fold = F.lower(F.trim("title"))
    first = proposed.withColumn("_t", fold).groupBy(scope, "_t").agg(F.min_by(F.struct("seq", "title"), "seq").alias("c"))
    return first.join(existing.select(scope, fold.alias("_t")).distinct(), [scope, "_t"], "left_anti").select(scope, "c.*")


def keep_folders(folders: DataFrame, filled: DataFrame, scratch: Scratch) -> DataFrame:
    """Folders (id, parent) that hold a card somewhere below: those in ``filled`` and all above them, a level a round."""
    parents = folders.select("id", "parent")
    kept = scratch.save(folders.join(filled.select("id").distinct(), "id", "left_semi").select("id"), "kept0")
    level, turn = kept, 0
    while not level.isEmpty():
        turn += 1
        up = parents.join(level, "id", "left_semi").select(F.col("parent").alias("id")).where("id is not null").distinct()
        level = scratch.save(up.join(kept, "id", "left_anti"), f"level{turn}")
        kept = scratch.save(kept.unionByName(level), f"kept{turn}")
    return folders.join(kept, "id", "left_semi")


def history(records: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Records of each card numbered from 1, with the fields that changed since the record before (all of them in the first)."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = records.withColumn("version", F.row_number().over(w)).withColumn("_before", F.lag(F.struct(*fields)).over(w))
    changed = F.array_compact(F.array(*[F.when(F.col("_before").isNull() | _differs(f, f"_before.{f}"), F.lit(f)) for f in fields]))
    return rows.withColumn("changed", changed).drop("_before")


def trash(records: DataFrame, key: str, order: list[str], action: str, gone: str) -> DataFrame:
    """Cards whose last record deletes them: (key, order columns)."""
    last = records.groupBy(key).agg(F.max_by(F.struct(*order, action), F.struct(*order)).alias("_r"))
    return last.where(F.col(f"_r.{action}") == gone).select(key, *[f"_r.{c}" for c in order])


def supersede(revisions: DataFrame, scope: str) -> DataFrame:
    """Revisions with only the newest open one of each scope still open."""
    newest = revisions.where("status = 'open'").groupBy(scope).agg(F.max("revision_id").alias("_newest"))
    old = (F.col("status") == "open") & (F.col("revision_id") < F.col("_newest"))
    return revisions.join(newest, scope, "left").withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("_newest")


def choose_targets(items: DataFrame) -> DataFrame:
    """The rows that a staged revision leaves: items (change, skip, keep, live_text, new_text), each with its ``target``.

    A skipped modification keeps the live text, a skipped addition stays out, a removal that is kept stays.
    """
    change = F.col("change")
    live = (change == "same") | ((change == "modified") & F.col("skip")) | ((change == "removed") & F.col("keep"))
    new = ((change == "modified") | (change == "added")) & ~F.col("skip")
    return items.withColumn("target", F.when(live, F.col("live_text")).when(new, F.col("new_text"))).where(live | new)


def upsert(stored: DataFrame, incoming: DataFrame, scope: str) -> DataFrame:
    """What storing incoming rows (scope, ordinal, content_hash) does to each, beside stored ones with has_vector: embed, skip, keep or refused.

    Only a row of equal hash whose vector is stored is skipped; stored rows that nothing replaces are kept, as nothing is deleted here.
    A scope that would get fewer rows than it has is left as it is (refused); a scope without incoming rows is not touched.
    """
    size = incoming.groupBy(scope).agg(F.count("*").alias("_new")).join(stored.groupBy(scope).agg(F.count("*").alias("_old")), scope, "left")
    held = stored.select(scope, "ordinal", F.when(F.col("has_vector"), F.col("content_hash")).alias("_was"), F.lit(True).alias("_stored"))
    both = incoming.select(scope, "ordinal", F.col("content_hash").alias("_in"), F.lit(True).alias("_sent")).join(held, [scope, "ordinal"], "full")
    shrinks = F.coalesce(F.col("_old") > F.col("_new"), F.lit(False))
    action = F.when(shrinks, "refused").when(F.col("_sent").isNull(), "keep").when(F.col("_in") == F.col("_was"), "skip").otherwise("embed")
    return both.join(size, scope).select(scope, "ordinal", action.alias("action"))


def impact(items: DataFrame, links: DataFrame, scope: str) -> DataFrame:
    """Per scope, how many cases cite a row that a revision changes or removes."""
    touched = items.where(F.col("change").isin("modified", "removed")).select(scope, "req_id")
    cases = touched.join(links.select("req_id", "uid").distinct(), "req_id").groupBy(scope).agg(F.countDistinct("uid").alias("cases"))
    return items.select(scope).distinct().join(cases, scope, "left").select(scope, F.coalesce("cases", F.lit(0)).alias("cases"))
