"""Revisions of a document's rows: fingerprints, staged changes, reconciling with kept ids, archive and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this share of matched rows a replacement asks first, where so many rows are live.
GATE_RATIO, GATE_LIVE = 0.20, 5


def fingerprint(rows: DataFrame, key: str, scope: str) -> DataFrame:
    """One hash per scope of its (id, content_hash) rows, whatever their order: sums of row hashes, so nothing is gathered."""
    h = F.xxhash64(key, "content_hash").cast("decimal(38,0)")
    return rows.groupBy(scope).agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


def stale_scopes(staged: DataFrame, live: DataFrame, key: str, scope: str) -> DataFrame:
    """Scopes whose live rows are no longer those that were staged: (scope, stale)."""
    a, b = (fingerprint(x, key, scope).select(F.col(scope), F.struct("n", "digest").alias(name)) for x, name in ((staged, "was"), (live, "now")))
    return a.join(b, scope, "full").select(scope, (~F.col("was").eqNullSafe(F.col("now"))).alias("stale"))


def reconcile(targets: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """What happens to each row where the targets become the live rows: kept, updated, added, revived or archived.

    targets: key (null for a new row), ordinal, content_hash, archived (whether the key is one of the archive's).
    live: key, content_hash. A new row keeps a null key until the sink gives it one. One full outer join by key.
    """
    old = live.select(F.col(key).alias("_live"), F.col("content_hash").alias("_was"))
    both = targets.join(old, targets[key] == old["_live"], "full")
    action = (
        F.when(F.col("ordinal").isNull(), "archived")
        .when(F.coalesce("archived", F.lit(False)), "revived")
        .when(F.col("_live").isNull(), "added")
        .when(F.col("content_hash") == F.col("_was"), "kept")
        .otherwise("updated")
    )
    return both.select(F.coalesce(F.col(key), F.col("_live")).alias(key), "ordinal", F.coalesce("content_hash", "_was").alias("content_hash"), action.alias("action"))


def live_rows(reconciled: DataFrame) -> DataFrame:
    return reconciled.where("action <> 'archived'").drop("action")


def audit_rows(reconciled: DataFrame, key: str) -> DataFrame:
    """An entry for each row that changed."""
    entry = F.create_map(*[F.lit(x) for pair in (("added", "add"), ("revived", "add"), ("updated", "edit"), ("archived", "delete")) for x in pair])
    return reconciled.where("action <> 'kept'").select(key, F.element_at(entry, F.col("action")).alias("entry"))


def lookup(ids: DataFrame, live: DataFrame, archive: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows by id, the live one before the archived one: (key, columns, archived)."""
    both = live.select(key, *columns, F.lit(0).alias("_turn")).unionByName(archive.select(key, *columns, F.lit(1).alias("_turn")))
    found = both.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), "_turn").alias("_row"), (F.min("_turn") == 1).alias("archived"))
    return found.select(key, "_row.*", "archived")


def summary(changes: DataFrame, scope: str) -> DataFrame:
    """Rows of each change per scope."""
    return changes.groupBy(scope).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("same", "modified", "added", "removed")])


def replace_gate(summed: DataFrame, kept_removed: Column | None = None) -> DataFrame:
    """matched, live, ratio and whether the replacement needs confirmation, of rows with same, modified and removed."""
    stay = F.lit(0) if kept_removed is None else kept_removed
    matched, live, gone = F.col("same") + F.col("modified") + stay, F.col("same") + F.col("modified") + F.col("removed"), F.col("removed") - stay
    ratio = F.coalesce(matched / F.nullif(live, F.lit(0)), F.lit(1.0))
    needs = (live >= GATE_LIVE) & (gone > 0) & (ratio < GATE_RATIO)
    return summed.withColumns({"matched": matched, "live": live, "ratio": F.round(ratio, 4), "needs_confirmation": needs})


def publish_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """New chunks (chunk_id, embed_hash) with the vector that any earlier chunk of that hash has: (chunk_id, vector, missing)."""
    known = vectors.groupBy("embed_hash").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return chunks.join(known, "embed_hash", "left").select("chunk_id", "vector", F.col("vector").isNull().alias("missing"))
