"""Queries on suites of cases, test cycles, answers and chunks, with the SQL that they are compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import questions as N
from tracewell.functions import text as T
from tracewell.functions.scratch import Scratch
from tracewell.operators import answers as A
from tracewell.operators import batches as B
from tracewell.operators import cycles as C
from tracewell.operators import rows as W
from tracewell.operators import suites as S
from tracewell.operators import units as U
from tracewell.plans.records import _CASE, _events, w4_amend
from tracewell.plans.records import ORACLE as RECORDS
from tracewell.plans.retrieval import table

QUERIES: dict = {}
ORACLE: dict = {}
NOW = "2024-01-30 00:00:00"
W4 = RECORDS["w4_amend"]


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _text(*parts):
    """The parts as one string, columns by name and everything else as it is."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


# --- suites: orders are cases, the parts of their lines are the requirements they cite


def _suite(spark, sf_dir, edited: bool):
    mark = F.when((F.col("l_partkey") % 10 == 0) & F.lit(edited), "!").otherwise("")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_partkey").cast("string").alias("k"), F.md5(F.concat(_text("p", "$l_partkey"), mark)).alias("h")).alias("e"))
    cited = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(F.array_sort(F.collect_set("e"))).alias("req_hashes"))
    rows = table(spark, sf_dir, "orders").join(cited, "o_orderkey", "left")
    key = F.col("o_orderkey")
    when = lambda n, value, other: F.when((key % n == 0) & F.lit(edited), value).otherwise(other)
    if edited:
        rows = rows.where(key % 13 != 0)
    rows = rows.select(
        when(17, -key, key).alias("uid"),
        when(3, key + 1, key).alias("ordinal"),
        F.array(when(5, F.lit("moved"), F.col("o_orderpriority"))).alias("folder_path"),
        F.struct(when(7, F.lit("edited"), F.col("o_orderstatus")).alias("title"), when(11, F.lit("edited"), F.col("o_custkey").cast("string")).alias("steps")).alias("data"),
        "req_hashes",
    )
    rows = rows.withColumn("def_hash", F.md5("data.steps")).withColumn("content_hash", F.md5(F.concat_ws("\x1f", "data.title", "data.steps")))
    return rows.withColumn("basis_hash", F.md5(F.concat_ws("\x1f", "content_hash", F.to_json("req_hashes"))))


@query("""with c as (select l_orderkey, list_sort(list(distinct l_partkey::varchar)) as r from lineitem where l_partkey % 10 = 0 group by 1),
  o as (select o_orderkey as k, coalesce(r, []) as r from orders left join c on l_orderkey = o_orderkey)
  select k as uid, case when k % 13 = 0 or k % 17 = 0 then 'removed' when k % 7 = 0 or k % 11 = 0 then 'modified' when len(r) > 0 then 'requirement_changed' when k % 5 = 0 then 'moved' when k % 3 = 0 then 'reordered' else 'unchanged' end as change,
    case when k % 13 = 0 or k % 17 = 0 then '' else concat_ws(',', case when k % 7 = 0 then 'title' end, case when k % 11 = 0 then 'steps' end) end as fields,
    case when k % 13 = 0 or k % 17 = 0 then '' else array_to_string(r, ',') end as requirements, k % 13 <> 0 and k % 17 <> 0 and k % 5 = 0 as moved,
    k % 13 <> 0 and k % 17 <> 0 and (k % 11 = 0 or len(r) > 0) as retest from o
  union all select -k, 'added', '', '', false, false from o where k % 17 = 0 and k % 13 <> 0""")
def a16_suite_diff(spark, sf_dir):
    """Title edits need no retest, edits of steps and of cited requirements do."""
    found = S.diff(_suite(spark, sf_dir, False), _suite(spark, sf_dir, True), ["title", "steps"])
    return found.select("uid", "change", F.array_join("fields", ",").alias("fields"), F.array_join("requirements", ",").alias("requirements"), "moved", "retest")


_H = "md5(c_mktsegment || '|' || c_nationkey || '|' || c_custkey % 50)"


def _published(spark, sf_dir):
    h = F.md5(F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 50).cast("string")))
    draft = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("uid"), h.alias("content_hash"), (F.col("c_custkey") % 9).alias("ordinal"))
    old = (F.col("c_nationkey") % 3 != 0) & (F.col("uid") % 5 == 0)
    latest = draft.withColumn("content_hash", F.when(old, F.md5(F.concat(F.lit("old"), "content_hash"))).otherwise(F.col("content_hash")))
    return S.publish(draft, latest, draft.where("uid % 2 = 0").select("content_hash").distinct(), "c_nationkey")


@query("""select c_nationkey, bool_or(c_nationkey % 3 <> 0 and c_custkey % 5 = 0) as changed,
  case when bool_or(c_nationkey % 3 <> 0 and c_custkey % 5 = 0) then count(*) else 0 end as members from customer group by 1""")
def a15_publish(spark, sf_dir):
    scopes, members, _ = _published(spark, sf_dir)
    sizes = members.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return scopes.join(sizes, "c_nationkey", "left").select("c_nationkey", "changed", F.coalesce("n", F.lit(0)).alias("members"))


@query(f"""select distinct {_H} as content_hash from customer where c_nationkey in (select c_nationkey from customer where c_nationkey % 3 <> 0 and c_custkey % 5 = 0)
  and {_H} not in (select {_H} from customer where c_custkey % 2 = 0)""")
def a15_contents(spark, sf_dir):
    return _published(spark, sf_dir)[2]


@query("select case when o_orderkey % 17 = 0 and side = 1 then -o_orderkey else o_orderkey end as uid, case when side = 1 then 'remove' when o_orderkey % 13 = 0 or o_orderkey % 17 = 0 then 'reinsert' when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then 'update' else 'keep' end as action from orders, (select unnest([0, 1]) as side) s where side = 0 or (o_orderkey % 17 = 0 and o_orderkey % 13 <> 0)")
def a18_restore(spark, sf_dir):
    return S.restore(_suite(spark, sf_dir, True), _suite(spark, sf_dir, False))


@query("select distinct l_partkey::varchar as req_id, md5('p' || l_partkey) as hash, l_partkey % 23 = 0 as gone from lineitem where l_partkey % 10 = 0 or l_partkey % 23 = 0")
def a18_basis_rollback(spark, sf_dir):
    mark = F.when(F.col("p_partkey") % 10 == 0, "!").otherwise("")
    live = table(spark, sf_dir, "part").where("p_partkey % 23 <> 0").select(F.col("p_partkey").cast("string").alias("req_id"), F.md5(F.concat(_text("p", "$p_partkey"), mark)).alias("hash"))
    return S.basis_rollback(_suite(spark, sf_dir, False), live)


@query("""with s as (select p_partkey as k, p_brand as h, case when p_partkey % 2 = 0 then 'live' when p_partkey % 5 = 0 then 'aligned' when p_partkey % 3 = 0 then 'archived' end as via from part),
  o as (select k, h, row_number() over (partition by h order by k) as n from s where via is null),
  r as (select id, h, row_number() over (partition by h order by id) as n from (select k as id, h from s where via = 'aligned' and k % 3 = 0 union all select k + 2000000000, h from s where k % 7 = 0) a)
  select k as snap_id, case via when 'aligned' then k + 1000000000 else k end as target_id, via from s where via is not null
  union all select k, id, case when id is null then 'new' else 'content' end from o left join r using (h, n)""")
def a11_match_snapshot(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("content_hash"))
    live = part.where("k % 2 = 0").select(F.col("k").alias("live_id")).union(part.where("k % 5 = 0").select(F.col("k") + 1000000000))
    aligned = part.where("k % 5 = 0").select(F.col("k").alias("snap_id"), (F.col("k") + 1000000000).alias("live_id"))
    archive = part.where("k % 2 = 1 and k % 3 = 0").union(part.where("k % 7 = 0").select(F.col("k") + 2000000000, "content_hash")).toDF("archived_id", "content_hash")
    return S.match_snapshot(part.withColumnRenamed("k", "snap_id"), live, aligned, archive)


def _edits(spark, sf_dir):
    expected = F.when(F.col("l_suppkey") % 37 == 0, "other").otherwise(F.md5(_text("p", "$l_partkey")))
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("op_id"), F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("req_id"), expected.alias("expected"))
    live = table(spark, sf_dir, "part").where("p_partkey % 101 <> 0").select(F.col("p_partkey").alias("req_id"), F.md5(_text("p", "$p_partkey")).alias("hash"))
    return edits, live


_OUTCOME = "case when l_returnflag = 'A' then 'applied' when l_partkey % 101 = 0 then 'missing' when l_suppkey % 37 = 0 then 'conflict' else 'applied' end"


@query(f"select l_orderkey as set_id, l_linenumber as op_id, case when l_returnflag <> 'A' then l_partkey end as req_id, {_OUTCOME} as outcome from lineitem")
def a12_edits(spark, sf_dir):
    return S.apply_edits(*_edits(spark, sf_dir)).select("set_id", "op_id", "req_id", "outcome")


@query(f"""select l_orderkey as set_id, count(*) as n_ops, case when l_orderkey % 9 = 0 then 'replayed' when count(*) > 5 then 'too_large' when bool_or({_OUTCOME} <> 'applied') then 'rejected' else 'applied' end as result from lineitem group by 1""")
def a13_change_sets(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("set_id"))
    return S.apply_change_sets(*_edits(spark, sf_dir), done, 5)


@query("""with d as (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as n from lineitem)
  select o_orderkey as uid, case l_returnflag when 'R' then 'update' when 'A' then 'remove' else 'keep' end as decision from orders left join d on l_orderkey = o_orderkey and n = 1""")
def a22_decide(spark, sf_dir):
    said = F.create_map(F.lit("R"), F.lit("update"), F.lit("A"), F.lit("remove"), F.lit("N"), F.lit("whatever"))[F.col("l_returnflag")]
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("seq"), said.alias("decision"))
    return S.decide(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid")), made)


@query("""with p as (select c_nationkey as nation, min(c_custkey) as seq from customer group by c_nationkey, c_custkey % 40),
  t as (select nation, seq, 'Title ' || seq % 40 as title from p)
  select nation, seq, title from t where not exists (select 1 from supplier where s_nationkey = nation and 'title ' || s_suppkey % 40 = lower(t.title))""")
def a24_new_titles(spark, sf_dir):
    proposed = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("seq"), F.concat(F.lit("Title "), (F.col("c_custkey") % 40).cast("string")).alias("title"))
    existing = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.concat(F.lit(" TITLE "), (F.col("s_suppkey") % 40).cast("string")).alias("title"))
    return S.new_titles(proposed, existing, "nation")


@query("""with f as (select distinct s_nationkey as n from supplier where s_acctbal > 8000)
  select 'n' || n_nationkey as id, 'r' || n_regionkey as parent from nation where n_nationkey in (select n from f)
  union all select 'r' || r_regionkey, null from region where r_regionkey in (select n_regionkey from nation where n_nationkey in (select n from f))""")
def a24_keep_folders(spark, sf_dir):
    folders = table(spark, sf_dir, "nation").select(_text("n", "$n_nationkey").alias("id"), _text("r", "$n_regionkey").alias("parent"))
    folders = folders.unionByName(table(spark, sf_dir, "region").select(_text("r", "$r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")))
    filled = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(_text("n", "$s_nationkey").alias("id"))
    return S.keep_folders(folders, filled, Scratch(spark, "folders"))


@query("""with h as (select *, row_number() over w as version, lag(event_type) over w as t, lag(value) over w as v, lag(props) over w as p from events window w as (partition by user_id order by ts, event_id))
  select event_id, version, concat_ws(',', case when version = 1 or event_type is distinct from t then 'event_type' end, case when version = 1 or value is distinct from v then 'value' end, case when version = 1 or props is distinct from p then 'props' end) as changed from h""")
def a19_history(spark, sf_dir):
    rows = S.history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "props"])
    return rows.select("event_id", "version", F.array_join("changed", ",").alias("changed"))


@query("select user_id, ts, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) e where n = 1 and event_type in ('error')")
def a19_trash(spark, sf_dir):
    return S.trash(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "error")


@query("""with r as (select user_id, event_id, case when event_type in ('view', 'click') then 'open' else 'applied' end as status from events)
  select event_id as revision_id, case when status = 'open' and event_id < max(case when status = 'open' then event_id end) over (partition by user_id) then 'superseded' else status end as status from r""")
def a6_supersede(spark, sf_dir):
    status = F.when(F.col("event_type").isin("view", "click"), "open").otherwise("applied")
    return S.supersede(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("revision_id"), status.alias("status")), "user_id").select("revision_id", "status")


@query("""select p_brand, count(distinct case when p_partkey % 4 in (1, 3) then l_orderkey end) as cases from part left join lineitem on l_partkey = p_partkey group by 1""")
def a7_impact(spark, sf_dir):
    change = F.element_at(F.array(*map(F.lit, ("same", "modified", "added", "removed"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    items = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("req_id"), change.alias("change"))
    return S.impact(items, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("req_id"), F.col("l_orderkey").alias("uid")), "p_brand")


@query("""select p_partkey, case p_partkey % 4 when 0 then p_name when 3 then p_name when 1 then case when p_partkey % 3 = 0 then p_name else upper(p_name) end else upper(p_name) end as target from part
  where p_partkey % 4 in (0, 1) or (p_partkey % 4 = 2 and p_partkey % 3 <> 0) or (p_partkey % 4 = 3 and p_partkey % 5 = 0)""")
def a8_targets(spark, sf_dir):
    change = F.element_at(F.array(*map(F.lit, ("same", "modified", "added", "removed"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    key = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select("p_partkey", change.alias("change"), (key % 3 == 0).alias("skip"), (key % 5 == 0).alias("keep"), F.col("p_name").alias("live_text"), F.upper("p_name").alias("new_text"))
    return S.choose_targets(items).select("p_partkey", "target")


@query("""with n as (select user_id, count(*) as c, count(*) filter (event_id % 11 <> 0) as kept from events group by 1),
  e as (select user_id, event_id, event_id % 11 <> 0 as stays, kept = c or user_id % 2 = 1 as whole from events join n using (user_id) where kept > 0 or user_id % 2 = 1)
  select user_id, event_id as ordinal, case when not whole then 'refused' when not stays then 'keep' when event_id % 5 = 0 or event_id % 13 = 0 then 'embed' else 'skip' end as action from e
  union all select user_id, -event_id - 1, 'embed' from e where user_id % 2 = 1""")
def s12_upsert(spark, sf_dir):
    """Odd users send each row anew beside their old ones, even users lost some: those scopes are refused. Some rows have no vector."""
    stored = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ordinal"), F.col("props").alias("content_hash"))
    stored = stored.withColumn("has_vector", F.col("ordinal") % 13 != 0)
    sent = stored.where("ordinal % 11 <> 0").withColumn("content_hash", F.when(F.col("ordinal") % 5 == 0, "edited").otherwise(F.col("content_hash")))
    return S.upsert(stored, sent.unionByName(stored.where("user_id % 2 = 1").withColumn("ordinal", -F.col("ordinal") - 1)).drop("has_vector"), "user_id")


# --- cycles: users are cases, events their verdicts (sign-ups are notes), event ids modulo 4 their cycles

_V = f"""e as (select *, user_id as uid, nullif(event_id % 4, 0) as cycle_id, {_CASE} as status, case event_type when 'signup' then 'note' else 'status' end as kind from events),
  u as (select distinct user_id as uid from events), m as (select uid, c as cycle_id, 'v' || uid || '-' || c as basis_hash from u, (select unnest([1, 2, 3]) as c) s where (uid + c) % 3 <> 0)"""


def _verdicts(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "note").otherwise("status")
    return _events(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("uid"), F.nullif(F.col("event_id") % 4, F.lit(0)).alias("cycle_id"), kind.alias("kind"), "status")


def _members(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("uid")).distinct().select("uid", F.explode(F.array(*[F.lit(c).cast("long") for c in (1, 2, 3)])).alias("cycle_id"))
    return rows.where("(uid + cycle_id) % 3 <> 0").withColumn("basis_hash", _text("v", "$uid", "-", "$cycle_id"))


def _drafts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("uid")).distinct().where("uid % 7 <> 0").withColumn("basis_hash", _text("v", "$uid", "-1"))


@query(f"""with {_V} select event_id, case when kind = 'status' then coalesce(m.basis_hash, case when e.uid % 7 <> 0 then 'v' || e.uid || '-1' end) end as against from e left join m on m.uid = e.uid and m.cycle_id = e.cycle_id""")
def e3_pin(spark, sf_dir):
    rows = C.pin(_verdicts(spark, sf_dir), _members(spark, sf_dir), _drafts(spark, sf_dir))
    return rows.select("event_id", F.col("tested_against_hash").alias("against"))


@query(f"""with a as ({W4}), r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from a),
  t as (select * from r where n = 1), b as (select user_id, max_by(status, (ts, event_id)) as before from r where n > 1 and kind = 'status' group by 1),
  d as (select *, case when ts < timestamp '{NOW}' - interval 5 day or tester <> user_id % 2 then 'refused' when amended_from is not null then 'reverted' else 'removed' end as undone, coalesce(before, 'not_tested') as held from t left join b using (user_id))
  select user_id, event_id, case when undone = 'reverted' then amended_from when undone = 'removed' or kind <> 'status' then held else status end as status, undone from d""")
def e4_undo(spark, sf_dir):
    """Folded verdicts, the newest of each user taken back by one of two testers."""
    entries = w4_amend(spark, sf_dir)
    requests = entries.select("user_id").distinct().withColumn("by", (F.col("user_id") % 2).cast("int"))
    return C.undo(entries, requests, "user_id", F.lit(NOW).cast("timestamp"), 5 * 86_400)


@query(f"""with {_V}, r as (select *, case when event_id % 5 = 0 then 'old' else 'v' || uid || '-' || cycle_id end as against, row_number() over (partition by uid, cycle_id order by ts desc, event_id desc) as n from e where kind = 'status' and cycle_id is not null)
  select m.cycle_id, m.uid, coalesce(r.status, 'not_tested') as status, coalesce(r.status in ('passed', 'failed', 'blocked') and against <> basis_hash, false) as stale, coalesce(event_id % 6 = 0, false) as carried,
    m.uid % 7 = 0 or m.cycle_id <> 1 as draft_differs from m left join r on r.uid = m.uid and r.cycle_id = m.cycle_id and n = 1""")
def e6_member_states(spark, sf_dir):
    against = F.when(F.col("event_id") % 5 == 0, "old").otherwise(_text("v", "$uid", "-", "$cycle_id"))
    events = _verdicts(spark, sf_dir).withColumn("tested_against_hash", against).withColumn("carried_from", F.when(F.col("event_id") % 6 == 0, F.col("event_id")))
    return C.member_states(_members(spark, sf_dir), events, _drafts(spark, sf_dir))


_PLAN = f"""with {_V}, r as (select *, row_number() over (partition by uid order by ts desc, event_id desc) as n from e),
  c as (select uid, status, event_id % 3 = 0 and status in ('passed', 'failed', 'blocked') as retest, case when uid % 4 = 0 then 'negative' else 'functional' end as case_type from r where n = 1 and uid % 6 <> 0 and uid % 5 <> 0),
  s as (select unnest(['all', 'not_passed', 'failed_blocked', 'retest']) as source)"""


@query(f"""{_PLAN} select source, uid from c, s where source = 'all' or (source = 'not_passed' and status <> 'passed') or (source = 'failed_blocked' and status in ('failed', 'blocked')) or (source = 'retest' and retest)
  union all select 'prior', uid from c where uid % 2 = 0 and case_type = 'functional' and uid % 8 <> 2""")
def e7_plan(spark, sf_dir):
    """Members by each source; then the cases of one type that a prior cycle has not passed."""
    last = F.max_by(F.struct("status", "event_id"), F.struct("ts", "event_id")).alias("e")
    cases = _verdicts(spark, sf_dir).groupBy("uid").agg(last).select(
        "uid", "e.status", F.when(F.col("e.event_id") % 3 == 0, "old").otherwise("new").alias("tested_hash"),
        F.when(F.col("uid") % 4 == 0, "negative").otherwise("functional").alias("case_type"), (F.col("uid") % 6 != 0).alias("in_scope"),
    )
    version = cases.where("uid % 5 <> 0").select("uid", F.lit("new").alias("basis_hash"))
    prior = cases.where("uid % 2 = 0").select("uid", F.when(F.col("uid") % 8 == 2, "passed").alias("status"))
    plans = [C.plan(cases, version, source).select(F.lit(source).alias("source"), "uid") for source in C.SOURCES]
    plans.append(C.plan(cases, version, "not_passed", ["functional"], prior).select(F.lit("prior").alias("source"), "uid"))
    return reduce(DataFrame.unionByName, plans)


def _report(spark, sf_dir):
    status = F.create_map(F.lit("F"), F.lit("failed"), F.lit("O"), F.lit("passed"), F.lit("P"), F.lit("not_tested"))[F.col("o_orderstatus")]
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), status.alias("status"), (F.col("o_orderkey") % 4 == 0).alias("stale"))
    links = table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("req_id"))
    return cases, links, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("req_id"), "p_name")


_CITED = """c as (select distinct l_partkey as req_id, o_orderkey as uid, case o_orderstatus when 'F' then 'failed' when 'O' then 'passed' else 'not_tested' end as status from lineitem join orders on o_orderkey = l_orderkey where l_partkey % 3 <> 0)"""


@query(f"""with {_CITED}, t as (select p_partkey as k, count(uid) as n, count(*) filter (status = 'failed') as f, count(*) filter (status = 'passed') as p, count(*) filter (status = 'passed' and uid % 4 = 0) as st from part left join c on req_id = p_partkey where not (p_partkey % 29 = 0 and p_partkey % 31 = 0) group by 1)
  select k as req_id, n as n_cases, case when n = 0 then 'uncovered' when f > 0 then 'failed' when p = n and st > 0 then 'retest' when p = n then 'passed' when p = 0 then 'not_run' else 'partial' end as state,
    case when k % 29 = 0 then 'removed' when k % 31 = 0 then 'added' when k % 10 = 0 then 'changed' else 'same' end as since from t""")
def e9_report(spark, sf_dir):
    cases, links, part = _report(spark, sf_dir)
    version = part.where("req_id % 31 <> 0").select("req_id", F.md5("p_name").alias("hash"))
    live = part.where("req_id % 29 <> 0").select("req_id", F.md5(F.when(F.col("req_id") % 10 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("hash"))
    return C.report(cases, links, version, live)


@query(f"with {_CITED} select p_partkey as req_id, uid, coalesce(status, 'uncovered') as status from part left join c on req_id = p_partkey")
def s16_traceability(spark, sf_dir):
    cases, links, part = _report(spark, sf_dir)
    return C.traceability(part, links, cases)


@query(f"""with {_V}, s as (select cycle_id, min(ts) as started, max(ts) as last_activity, count(distinct uid) as executed from e where kind = 'status' group by 1)
  select m.cycle_id, count(*) as members, coalesce(any_value(executed), 0) as executed, any_value(started) as started, any_value(last_activity) as last_activity, coalesce(any_value(executed), 0) >= count(*) as complete from m left join s using (cycle_id) group by 1""")
def e11_cycle_list(spark, sf_dir):
    return C.cycle_list(_members(spark, sf_dir), _verdicts(spark, sf_dir))


@query("""select 'customer' as name, count(*) as n from customer where c_nationkey <> 5 union all select 'supplier', count(*) from supplier where s_nationkey <> 5
  union all select 'nation', count(*) from nation where n_nationkey <> 5""")
def e13_purge(spark, sf_dir):
    """What is left of each table when a project (a nation) goes."""
    named = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey"}
    gone = table(spark, sf_dir, "nation").where("n_nationkey = 5").select("n_nationkey")
    left = C.purge({name: (table(spark, sf_dir, name), column) for name, column in named.items()}, gone, "n_nationkey")
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()])


# --- chunks: documents made from tables, so that SQL knows what they hold


@query("""with c as (select n_nationkey as doc_id, trim(n_name) as section, c_custkey, 'FR-' || c_custkey || ' The ' || trim(c_name) || ' pays.' as text, count(*) over (partition by n_nationkey) as n from customer join nation on n_nationkey = c_nationkey)
  select doc_id, row_number() over (partition by doc_id order by c_custkey) - 1 as ordinal, section, 'Bank / ' || section || case when n > 1 then ' / ' || text else '' end as section_path, 'FR-' || c_custkey as req_id, text, sha256(text) as content_hash from c""")
def t6_upload_chunks(spark, sf_dir):
    """Nations as documents, their customers as requirements in running text."""
    pays = F.struct("c_custkey", F.concat(_text("FR-", "$c_custkey", " The "), F.trim("c_name"), F.lit(" pays.")).alias("t"))
    bodies = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pays)), lambda r: r["t"]), "\n\n").alias("body"))
    docs = bodies.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = docs.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("# Bank\n\n## "), F.trim("n_name"), F.lit("\n\n"), F.col("body")).alias("text"))
    return U.upload_chunks(U.sections(docs), Scratch(spark, "chunks")).select("doc_id", "ordinal", "section", "section_path", "req_id", "text", "content_hash")


@query("""select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) - 1 as ordinal, '| part | flag | | ' || l_partkey || ' | ' || l_returnflag || ' |' as label,
  '| part | flag |' || chr(10) || '| ' || l_partkey || ' | ' || l_returnflag || ' |' as text from lineitem""")
def t5_markdown_chunks(spark, sf_dir):
    """Orders as documents with a table of their lines."""
    row = F.struct("l_linenumber", "l_partkey", "l_returnflag", _text("| ", "$l_partkey", " | ", "$l_returnflag", " |").alias("t"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n")
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("## Lines\n\n| part | flag |\n| --- | --- |\n"), rows).alias("text"))
    return U.markdown_chunks(U.sections(docs)).select("doc_id", "ordinal", "label", "text")


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'Business Value' when 1 then 'Reporting Module' when 2 then null else 'Audit' end as title, o_orderkey % 4 = 0 as part, case o_orderkey % 4 when 0 then 'FR-1' when 1 then 'BR-' || o_orderkey when 3 then 'US-9' end as row_id from orders")
def f12_f14_titles_and_row_ids(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    pick = lambda *forms: F.element_at(F.array(*[f if not isinstance(f, str) else F.lit(f) for f in forms]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = pick("Business Value", "Reporting Module", "the users may go on", "**Audit**:")
    row = pick("| FR 1 | see BR-2 |", F.concat(F.lit("| Login | BR-"), key, F.lit(" |")), "| Both | FR-1, FR-2 |", "| x | FR-1, FR-2 |")
    owner = F.when(F.col("o_orderkey") % 4 == 3, "US-9")
    title = F.coalesce(T.title_like(line), F.when(T.is_sub_label(line), line))
    return table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), T.is_part_label(line).alias("part"), T.row_id(row, owner).alias("row_id"))


# --- answers and text


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}]{{4,}}'), lambda w: not list_contains(['" + "','".join(T.FILLER.split()) + "'], w)))"


@query(f"""with s as (select conv_id as id, turn + 1 as n, {_WORDS.format("text")} as v from conversations where role = 'user' and text is not null),
  a as (select conv_id * 1000 + turn as id, conv_id, text, {_WORDS.format("split_part(text, E'\\n', 1)")} as w from conversations where text is not null and not contains(text, E'\\n') and not contains(text, '[')),
  r as (select a.id, n, row_number() over (partition by a.id order by len(list_intersect(w, v)) desc, n desc) as k from a join s on s.id = a.conv_id where len(w) >= 3 and len(list_intersect(w, v)) >= 0.7 * len(w))
  select a.id, rtrim(a.text, ' ') || coalesce(' [' || n || ']', '') || substr(a.text, length(rtrim(a.text, ' ')) + 1) as text from a left join r on r.id = a.id and k = 1""")
def f22_attach_citations(spark, sf_dir):
    """One-line turns as answers, the user turns of their conversation as sources."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    turns = c.where(~F.contains("text", F.lit("\n")) & ~F.contains("text", F.lit("["))).select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    users = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("n"), F.col("text").alias("source"))
    sources = turns.select("conv_id", "id").join(users, "conv_id").select("id", "n", F.col("source").alias("text"))
    return A.attach_citations(turns.select("id", "text"), sources)


@query("""select role, count(*) as n, round(avg((turn % 4 in (0, 1) or (turn % 4 = 2 and conv_id between 1 and 8))::int::double), 6) as grounded,
  round(avg(case when conv_id % 3 <> 0 then (turn % 4 = 2 and conv_id in (1, 2, 4, 8))::int::double end), 6) as citation_hit, round(avg(((turn % 4 = 1) = (conv_id % 3 = 0))::int::double), 6) as abstention from conversations group by 1""")
def v7_answer_figures(spark, sf_dir):
    forms = [F.lit("  "), F.concat(F.lit("Sorry. "), F.lit(T.ABSTAIN)), F.concat(F.lit("It does ["), F.col("conv_id").cast("string"), F.lit("].")), F.lit("It does not say.")]
    expected = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, (1, 2, 4, 8))))
    rows = table(spark, sf_dir, "conversations").select("role", F.element_at(F.array(*forms), (F.col("turn") % 4 + 1).cast("int")).alias("text"), F.lit(8).alias("n_sources"), expected.alias("expected"))
    return A.answer_figures(rows, "role")


@query("""select o_orderkey, 'Order of ' || o_custkey as title, case when o_orderstatus = 'F' then 'negative' else 'functional' end as case_type, n as n_sources from orders join (select l_orderkey, count(distinct l_partkey) as n from lineitem where l_partkey % 2 = 0 and l_partkey <= 1000 group by 1) l on l_orderkey = o_orderkey where o_orderkey % 5 <> 0""")
def f27_clean_cards(spark, sf_dir):
    sources = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("sources"))
    title = F.when(F.col("o_orderkey") % 5 == 0, " \n ").otherwise(_text("  Order \n of ", "$o_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", " Negative ").otherwise("whatever")
    cards = table(spark, sf_dir, "orders").join(sources, "o_orderkey").select("o_orderkey", title.alias("title"), kind.alias("case_type"), "sources")
    found = A.clean_cards(cards, F.sequence(F.lit(0).cast("long"), F.lit(1000).cast("long"), F.lit(2).cast("long")))
    return found.select("o_orderkey", "title", "case_type", F.size("sources").cast("long").alias("n_sources"))


@query("select doc_id, true as whole, coalesce(length(regexp_replace(text, '\\s', '', 'g')) = 0, false) as short from documents where text is not null")
def f25_conserved(spark, sf_dir):
    """Lines put together again hold all of a text; with a line too many they do only where nothing is added."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.split("text", "\n")
    return docs.select("doc_id", T.conserved(F.col("text"), lines).alias("whole"), T.conserved(F.col("text"), F.array_append(lines, F.col("text"))).alias("short"))


@query("""
with l as (select l_orderkey, 'part ' || l_partkey || ' | ' || l_returnflag || ' |' as t, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as n, count(*) over (partition by l_orderkey) as c from lineitem)
select l_orderkey, list(case when n = 1 then 'Lines: ' || t else t end order by n) as rows, true as whole, bool_or(c >= 1) as flat from l group by l_orderkey
""")
def f25_split_rows(spark, sf_dir):
    """Lines of an order run together, cut again where their parts stand; one anchor stands nowhere, one only at the end."""
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", _text("part ", "$l_partkey", " | ", "$l_returnflag", " |").alias("t"), _text("part  ", "$l_partkey", "\n|").alias("anchor"))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    text = F.concat(F.lit("  Lines: "), F.array_join(F.transform("l", lambda x: x["t"]), " "), F.lit(" "))
    anchors = F.concat(F.array(F.lit("nowhere")), F.transform("l", lambda x: x["anchor"]), F.array(F.lit("Lines:")))
    rows = o.select("l_orderkey", text.alias("text"), W.split_rows(text, anchors).alias("rows"))
    return rows.select("l_orderkey", "rows", T.conserved(F.col("text"), F.col("rows")).alias("whole"), W.looks_flattened(F.col("text")).alias("flat"))


@query("select o_orderkey, 'order ' || o_orderkey || '.docx' as name, case when o_orderkey % 2 = 0 then 'text/plain' else 'application/octet-stream' end as mime, o_orderkey % 3 = 0 as link from orders")
def f28_clean_names(spark, sf_dir):
    name = F.concat(_text("C:\\in/../ .order ", "$o_orderkey"), F.lit('?".docx. '))
    mime = F.when(F.col("o_orderkey") % 2 == 0, "Text/Plain; charset=utf-8").otherwise("nonsense")
    link = F.element_at(F.array(F.lit("https://a.example/x?y"), F.lit("javascript:alert(1)"), F.lit("http:// a")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clean_filename(name).alias("name"), T.clean_mime(mime).alias("mime"), T.valid_link(link).alias("link"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_brand || ' / ' || p_name || chr(10) || 'A part.' else ' ' || p_name || ': a part.' end as passage from part")
def r8_rerank_text(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, "A part.").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(": a part.")))
    return table(spark, sf_dir, "part").select("p_partkey", T.rerank_text(F.concat_ws(" / ", "p_brand", "p_name"), text).alias("passage"))


@query("select vec_id from embeddings where not exists (select 1 from labels where labels.doc_id = vec_id)")
def q7_orphans(spark, sf_dir):
    """Vectors that no row refers to."""
    return table(spark, sf_dir, "embeddings").select("vec_id").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


# --- forms of questions, edits of a span, batches to embed


@query("select o_orderkey, 'fi ' || o_orderkey || chr(10) || ' kg' as text, 'strasse ' || o_orderkey || ' fi' as key from orders")
def f4_f5_compatible_forms(spark, sf_dir):
    text = _text("\ufb01\u200b\t ", "$o_orderkey", "\x01\n\u00a0\u338f")
    question = _text("\u3000Stra\u00dfe  ", "$o_orderkey", " \ufb01 ?!\u061f ")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.extracted_text(text).alias("text"), N.question_key(question).alias("key"))


@query("""select conv_id, turn, turn % 4 = 0 as smalltalk, turn % 4 = 1 as back, turn % 4 = 2 as usable from conversations""")
def f23_question_forms(spark, sf_dir):
    forms = ["  Hello, order", "Hither and what of its price", "payments for order", "Let me see the payments for order"]
    question = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("turn") % 4 + 1).cast("int")), F.lit(" "), F.col("conv_id").cast("string"))
    usable = N.is_usable_rewrite(question, F.lit("Which payments are late?"), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.is_smalltalk(question).alias("smalltalk"), N.points_back(question).alias("back"), usable.alias("usable"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'Pay (' || o_orderkey || ') now.' when 1 then 'Pay ('  || o_orderkey || ')' || chr(10) || ' in [a\\E.b]' end as text from orders""")
def f24_span_edits(spark, sf_dir):
    """A span as it stands, one with other white space and pattern characters, one that is missing, one replaced by itself."""
    kind = (F.col("o_orderkey") % 4 + 1).cast("int")
    pick = lambda *forms: F.element_at(F.array(*map(F.lit, forms)), kind)
    text = F.concat(_text("Pay (", "$o_orderkey", ")"), pick(" later.", "\n on  [a\\E.b]", " soon", " soon"))
    find = pick("later.", "on [a\\E.b]", "never", "soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.edited(text, find, pick("now.", "in [a\\E.b]", "x", "soon")).alias("text"))


@query("""with t as (select distinct sha256(text) as embed_hash, text from documents where text is not null)
  select embed_hash, greatest(1, length(text) // 4)::int as tokens, true as fits from t where embed_hash not in (select sha256(text) from documents where text is not null and doc_id % 3 = 0)""")
def q4_token_batches(spark, sf_dir):
    """Distinct texts that no document with an id divisible by 3 has, and whether each batch keeps its bounds."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("embed_hash"), "text")
    batched = Scratch(spark, "batches").save(B.token_batches(texts, texts.where("doc_id % 3 = 0")).select("embed_hash", "tokens", "batch"), "rows")
    fits = (F.count("*") == 1) | ((F.count("*") <= B.BATCH_TEXTS) & (F.sum("tokens") <= B.BATCH_TOKENS))
    return batched.join(batched.groupBy("batch").agg(fits.alias("fits")), "batch").select("embed_hash", "tokens", "fits")
