"""Test cycles: pinned verdicts, undo, members' states, planning, reports and traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.timeline import DEFAULT_STATUS, DEFECTS, coverage, is_stale

SOURCES = ("all", "not_passed", "failed_blocked", "retest", "empty")


def pin(events: DataFrame, planned: DataFrame, draft: DataFrame) -> DataFrame:
    """Adds the hash a verdict is given against: that of the cycle's plan, else of the draft; notes have none."""
    in_cycle = planned.select("cycle_id", "uid", F.col("basis_hash").alias("_planned"))
    rows = events.join(in_cycle, ["cycle_id", "uid"], "left").join(draft.select("uid", F.col("basis_hash").alias("_draft")), "uid", "left")
    against = F.when(F.col("kind") == "status", F.coalesce("_planned", "_draft"))
    return rows.withColumn("tested_against_hash", against).drop("_planned", "_draft")


def undo(entries: DataFrame, requests: DataFrame, key: str, now: Column, seconds: int) -> DataFrame:
    """What taking back each key's newest entry does: (key, event_id, status, undone).

    ``entries`` are folded verdicts (``timeline.amended``: event_id, ts, tester, kind, status, amended_from), ``requests`` (key, by) who
    asks. Only the newest entry, its own tester's and young enough, is taken back (else ``refused``): an amended verdict
    turns back to what it replaced and stays (``reverted``), another entry goes (``removed``), and the newest status
    before it holds. Notes have no status. A key without entries has no row.
    """
    at = F.struct("ts", "event_id")
    top = entries.join(requests.select(key, "by"), key).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))))
    is_status = F.col("kind") == "status"
    both = top.groupBy(key, "by").agg(
        F.max(F.when(F.col("_n") == 1, F.struct("event_id", "ts", "tester", "kind", "status", "amended_from"))).alias("_1"),
        F.max_by(F.when(is_status, F.col("status")), F.when(is_status & (F.col("_n") > 1), at)).alias("_before"),
    )
    young = F.unix_micros(now) - F.unix_micros(F.col("_1.ts").cast("timestamp")) <= seconds * 1_000_000
    own = F.col("_1.tester").eqNullSafe(F.col("by"))
    undone = F.when(~(young & own), "refused").when(F.col("_1.amended_from").isNotNull(), "reverted").otherwise("removed")
    before = F.coalesce("_before", F.lit(DEFAULT_STATUS))
    stands = F.when(F.col("_1.kind") == "status", F.col("_1.status")).otherwise(before)
    status = F.when(undone == "reverted", F.col("_1.amended_from")).when(undone == "removed", before).otherwise(stands)
    return both.select(key, F.col("_1.event_id").alias("event_id"), status.alias("status"), undone.alias("undone"))


def member_states(members: DataFrame, events: DataFrame, draft: DataFrame) -> DataFrame:
    """Members (cycle_id, uid, basis_hash) with their last verdict in that cycle, staleness against the plan, and whether the
    draft's definition differs from the planned one (a case that is gone from the draft counts as different)."""
    at = F.struct("ts", "event_id")
    last = events.where("kind = 'status'").groupBy("cycle_id", "uid").agg(F.max_by(F.struct("status", "tested_against_hash", "carried_from"), at).alias("_e"))
    rows = members.join(last, ["cycle_id", "uid"], "left").join(draft.select("uid", F.col("basis_hash").alias("_draft")), "uid", "left")
    return rows.select(
        "cycle_id",
        "uid",
        F.coalesce("_e.status", F.lit(DEFAULT_STATUS)).alias("status"),
        is_stale(F.col("_e.status"), F.col("_e.tested_against_hash"), F.col("basis_hash")).alias("stale"),
        F.col("_e.carried_from").isNotNull().alias("carried"),
        (~F.col("basis_hash").eqNullSafe(F.col("_draft"))).alias("draft_differs"),
    )


def plan(cases: DataFrame, version: DataFrame, source: str, types: list[str] | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Members (uid, basis_hash) of a new cycle: in-scope cases (uid, status, tested_hash, case_type, in_scope) that are in
    the published version (uid, basis_hash), narrowed by source, by type and to the members (uid, status) of a prior cycle,
    whose verdicts then count. Retest goes by the overall verdict."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    rows = cases.where("in_scope").join(version.select("uid", "basis_hash"), "uid")
    rows = rows.withColumn("retest", is_stale(F.col("status"), F.col("tested_hash"), F.col("basis_hash")))
    if types:
        rows = rows.where(F.col("case_type").isin(types))
    if prior is not None:
        rows = rows.drop("status").join(prior.select("uid", F.coalesce("status", F.lit(DEFAULT_STATUS)).alias("status")), "uid")
    chosen = {
        "all": F.lit(True),
        "not_passed": F.col("status") != "passed",
        "failed_blocked": F.col("status").isin(*DEFECTS),
        "retest": F.col("retest"),
        "empty": F.lit(False),
    }[source]
    return rows.where(chosen).select("uid", "basis_hash")


def report(cases: DataFrame, links: DataFrame, version: DataFrame, live: DataFrame) -> DataFrame:
    """Coverage of each requirement of a version or of the live rows, and what became of it since the version.

    cases (uid, status, stale), links (uid, req_id), version and live (req_id, hash). Flags: changed, removed, added.
    """
    cited = links.select("uid", "req_id").distinct().join(cases, "uid")
    both = version.select("req_id", F.col("hash").alias("_v")).join(live.select("req_id", F.col("hash").alias("_l")), "req_id", "full")
    since = (
        F.when(F.col("_l").isNull(), "removed").when(F.col("_v").isNull(), "added").when(F.col("_v") != F.col("_l"), "changed").otherwise("same")
    )
    return coverage(cited, both).join(both.select("req_id", since.alias("since")), "req_id")


def traceability(requirements: DataFrame, links: DataFrame, cases: DataFrame) -> DataFrame:
    """A row for each requirement and case that cites it; an uncovered requirement keeps one row without a case."""
    cited = links.select("uid", "req_id").distinct().join(cases.select("uid", "status"), "uid")
    return requirements.select("req_id").join(cited, "req_id", "left").select("req_id", "uid", F.coalesce("status", F.lit("uncovered")).alias("status"))


def cycle_list(members: DataFrame, events: DataFrame) -> DataFrame:
    """Cycles with their size, first and last verdict, testers, and whether every member has a verdict."""
    seen = events.where("kind = 'status'").groupBy("cycle_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last_activity"), F.countDistinct("uid").alias("executed"))
    size = members.groupBy("cycle_id").agg(F.count("*").alias("members"))
    n = F.coalesce("executed", F.lit(0))
    return size.join(seen, "cycle_id", "left").select("cycle_id", "members", n.alias("executed"), "started", "last_activity", (n >= F.col("members")).alias("complete"))


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables (rows, column of the key) without the rows of the keys in ``gone``."""
    return {name: rows.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti") for name, (rows, column) in tables.items()}
