"""Publishing drafts of suites as versions: only what was reviewed, one version a scope, with audit rows; reading a case as a version has it.

Draft and version rows are those of ``trees.draft_rows`` with a scope. Fingerprints are sums over the scope's rows, so they do
not depend on order and no scope is gathered in one task.

Defined results: a scope without draft rows publishes nothing (``empty``); a scope whose draft is not what was reviewed is
``stale``, before anything else is looked at; one that equals its latest version is ``unchanged``; the first version of a
scope adds all its cases. A null fingerprint checks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import suites as S

#: What can happen to a case between two versions.
CHANGES = ("added", "removed", "modified", "requirement_changed", "moved", "reordered", "unchanged")


def fingerprint(rows: DataFrame, scope: str) -> DataFrame:
    """(scope, fingerprint) of what would be published: cases, their bases, folders and places."""
    digest = F.md5(F.to_json(F.struct("uid", "basis_hash", "folder_path", "ordinal"), {"ignoreNullFields": "false"}))
    halves = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 17)]
    return rows.groupBy(scope).agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), *[h.cast("string") for h in halves])).alias("fingerprint"))


def review(draft: DataFrame, latest: DataFrame, scope: str, fields: list[str]) -> DataFrame:
    """(scope, uid, change, fields, requirements, moved, retest) of every case of a draft or of its scope's latest version."""
    changes = S.diff(latest.drop(scope), draft.drop(scope), fields)
    scopes = draft.select("uid", F.col(scope).alias("_new")).join(latest.select("uid", F.col(scope).alias("_old")), "uid", "full")
    return changes.join(scopes.select("uid", F.coalesce("_new", "_old").alias(scope)), "uid")


def publish(draft: DataFrame, latest: DataFrame, versions: DataFrame, expected: DataFrame, scope: str, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Freeze drafts that are what was reviewed: (outcome a scope, members of new versions, audit rows of their cases).

    versions: (scope, number) of all versions; expected: (scope, expect), the fingerprint that the review showed. A case
    that only moved its place among siblings gets no audit row.
    """
    changes = review(draft, latest, scope, fields)
    counted = changes.groupBy(scope).agg(*[F.count_if(F.col("change") == c).alias(c) for c in CHANGES], F.count_if("retest").alias("retest"))
    numbers = versions.groupBy(scope).agg(F.max("number").alias("number"))
    stale = F.col("expect").isNotNull() & ~F.col("expect").eqNullSafe(F.col("fingerprint"))
    differs = sum((F.col(c) for c in CHANGES[:-1]), F.lit(0)) > 0
    outcome = F.when(F.col("fingerprint").isNull(), "empty").when(stale, "stale").when(F.col("number").isNotNull() & ~differs, "unchanged").otherwise("published")
    outcomes = (
        numbers.join(fingerprint(draft, scope), scope, "full")
        .join(expected, scope, "left")
        .join(counted, scope, "left")
        .withColumn("outcome", outcome)
        .withColumn("number", F.when(F.col("outcome") == "published", F.coalesce("number", F.lit(0)) + 1).otherwise(F.col("number")))
        .select(scope, "outcome", "number", *CHANGES, "retest")
    )
    new = outcomes.where("outcome = 'published'").select(scope, "number")
    members = draft.join(new, scope).select(scope, "number", "uid", "ordinal", "folder_path", "content_hash", "basis_hash")
    names = F.array_join(F.transform("fields", lambda f: F.replace(f, F.lit("_"), F.lit(" "))), ", ")
    what = F.concat(
        F.replace("change", F.lit("_"), F.lit(" ")),
        F.when(F.size("fields") > 0, F.concat(F.lit(" ("), names, F.lit(")"))).otherwise(""),
        F.when(F.col("moved") & (F.col("change") != "moved"), ", moved").otherwise(""),
    )
    audit = (
        changes.where(~F.col("change").isin("reordered", "unchanged"))
        .join(new, scope)
        .select(scope, "uid", F.concat(F.lit("version_"), "change").alias("action"), F.concat(F.lit("Published in v"), F.col("number").cast("string"), F.lit(" — "), what).alias("summary"))
    )
    return outcomes, members, audit


def case_in_version(asked: DataFrame, members: DataFrame, contents: DataFrame, texts: DataFrame) -> DataFrame:
    """Cases as a version defines them: asked (version, uid) with ``found``, folder_path, data and requirements.

    members: version, uid, content_hash, folder_path, req_hashes (of that version); contents: content_hash, data; texts: hash, text.
    requirements is an array of (id, text) by id; a text that is not stored is null. A pair asked twice is answered once.
    """
    rows = asked.select("version", "uid").distinct().join(members, ["version", "uid"], "left")
    cited = rows.select("version", "uid", F.explode("req_hashes").alias("id", "hash")).join(texts, "hash", "left")
    texts_of = cited.groupBy("version", "uid").agg(F.array_sort(F.collect_list(F.struct(F.col("id").try_cast("long").alias("id"), "text"))).alias("requirements"))
    kept = rows.join(contents, "content_hash", "left").join(texts_of, ["version", "uid"], "left")
    none = F.array().cast(texts_of.schema["requirements"].dataType)
    return kept.select("version", "uid", F.col("content_hash").isNotNull().alias("found"), "folder_path", "data", F.when(F.col("content_hash").isNotNull(), F.coalesce("requirements", none)).alias("requirements"))


def set_label(versions: DataFrame, labels: DataFrame, longest: int = 200) -> DataFrame:
    """Versions with new labels (version, new_label): trimmed and cut at ``longest``, blank ones removed; the only thing that stays editable."""
    clean = F.nullif(F.substring(F.trim("new_label"), 1, longest), F.lit(""))
    given = labels.select("version", clean.alias("_label"), F.lit(True).alias("_given"))
    label = F.when(F.col("_given"), F.col("_label")).otherwise(F.col("label"))
    return versions.join(given, "version", "left").withColumn("label", label).drop("_label", "_given")
