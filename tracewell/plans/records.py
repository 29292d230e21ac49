"""Queries on versions, timelines, joins, aggregates and text, with the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import chunking as C
from tracewell.functions import text as T
from tracewell.functions.scratch import Scratch
from tracewell.operators import alignment as A
from tracewell.operators import timeline as L
from tracewell.plans.retrieval import table
from tracewell.streaming import events as S

#: How the event types of the test data stand for verdicts.
STATUS = {"purchase": "passed", "error": "failed", "click": "blocked", "view": "not_tested", "signup": "in_progress"}
_CASE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATUS.items()) + " end"
HALF = "2024-01-16"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("event_type")]
    return e.withColumn("status", status).withColumn("tested_hash", F.get_json_object("props", "$.k"))


def w1_lag(spark, sf_dir):
    return L.with_previous(_events(spark, sf_dir), "user_id", "status", ["ts", "event_id"]).select("event_id", "user_id", "status", "previous")


def w3_latest(spark, sf_dir):
    return L.latest(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "status", "tested_hash")


def w4_amend(spark, sf_dir):
    """Users as cases, sign-ups as notes; testers change by hour of the day and cycles by week."""
    e = _events(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "signup", "note").otherwise("status"))
    e = e.withColumn("tester", (F.hour("ts") / 12).cast("int")).withColumn("cycle", (F.dayofmonth("ts") / 8).cast("int"))
    found = L.amended(e, "user_id", ["tester", "cycle"], seconds=86_400)
    return found.select("user_id", "event_id", "ts", "tester", "cycle", "kind", "status", "amended_from", "amendments")


def w5_timeline(spark, sf_dir):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return L.timeline_flags(_events(spark, sf_dir), "user_id", now, 86_400).select("event_id", "latest", "undoable")


def w6_sliding_count(spark, sf_dir):
    return L.sliding_count(_events(spark, sf_dir), "user_id").select("event_id", "in_window")


def w6_admitted(spark, sf_dir):
    return L.admitted(_events(spark, sf_dir), "user_id", 3, 86_400)


def _states(spark, sf_dir):
    last = L.latest(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "status", "tested_hash")
    current = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.get_json_object("props", "$.k")).alias("current_hash"))
    return last.join(current, "user_id").withColumn("stale", L.is_stale(F.col("status"), F.col("tested_hash"), F.col("current_hash")))


def e2_state(spark, sf_dir):
    return _states(spark, sf_dir).select("user_id", "status", "tested_hash", "current_hash", "stale")


def g9_cycle_stats(spark, sf_dir):
    s = _states(spark, sf_dir)
    return s.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") != L.DEFAULT_STATUS).alias("executed"),
        F.count_if("stale").alias("needs_retest"),
        *[F.count_if(F.col("status") == v).alias(v) for v in STATUS.values()],
    )


def g10_report(spark, sf_dir):
    s = _states(spark, sf_dir).withColumn("case_type", F.col("user_id") % 3)
    executed = F.count_if(F.col("status") != L.DEFAULT_STATUS)
    return s.groupBy("case_type").agg(
        F.count("*").alias("total"),
        executed.alias("executed"),
        F.round(F.try_divide(F.count_if(F.col("status") == "passed"), executed), 6).alias("pass_rate"),
        F.round(F.try_divide(executed, F.count("*")), 6).alias("progress"),
    )


def g11_coverage(spark, sf_dir):
    cases = _states(spark, sf_dir).select((F.col("user_id") % 25).cast("int").alias("req_id"), "status", "stale")
    return L.coverage(cases, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("req_id")))


def _halves(spark, sf_dir):
    e = _events(spark, sf_dir)
    cut = F.lit(HALF).cast("timestamp_ntz")
    return [L.latest(e.where(c), "user_id", ["ts", "event_id"], "status", "tested_hash") for c in (F.col("ts") < cut, F.col("ts") >= cut)]


def e8_carry(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return L.carry_passes(a.select("user_id", "status", "tested_hash"), b.select("user_id", F.col("tested_hash").alias("basis_hash")), "user_id")


def e10_run_compare(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return L.compare_runs(a, b, "user_id").select("user_id", "a", "b", "change")


def _aligned(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    return [x.withColumn("content_hash", F.sha2("text", 256)) for x in (bench, docs)]


def h1_content_hash_dups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _versions(spark, sf_dir):
    """All documents, and the same after a fixed edit rule: some lose their text's tail, some get a heading, some go."""
    docs = table(spark, sf_dir, "documents")
    live = docs.select(F.col("doc_id").alias("idx"), "text", F.concat_ws("-", F.upper("lang"), F.col("doc_id").cast("string")).alias("req_id"), F.col("source").alias("section"))
    edited = F.when(F.col("idx") % 5 == 0, F.concat(F.lit("Revised. "), F.col("text"))).otherwise(F.col("text"))
    new = live.where(F.col("idx") % 11 != 0).select("idx", edited.alias("text"), F.when(F.col("idx") % 2 == 0, F.col("req_id")).alias("req_id"), "section")
    return [x.withColumn("content_hash", F.sha2("text", 256)) for x in (live, new)]


def a1_exact_matches(spark, sf_dir):
    return A.exact_matches(*_versions(spark, sf_dir))


def a2_unique_ids(spark, sf_dir):
    return A.unique_id_matches(*_versions(spark, sf_dir))


def a3_similar_pairs(spark, sf_dir):
    pairs = A.similar_pairs(*_aligned(spark, sf_dir), least=0.2)
    return pairs.select("live_idx", "new_idx", F.round("similarity", 6).alias("similarity"))


def a4_classify(spark, sf_dir):
    live, new = _versions(spark, sf_dir)
    return A.classify(live, new, A.align(live, new, Scratch(spark, "a4")))


def _customers(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    new = old.where(F.col("c_custkey") % 13 != 0).select(
        F.when(F.col("c_custkey") % 17 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"),
        "c_name",
        F.when(F.col("c_custkey") % 7 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")).cast("int").alias("c_nationkey"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 3 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return old.select(*new.columns), new


def a16_diff(spark, sf_dir):
    return A.diff(*_customers(spark, sf_dir), "c_custkey", ["c_name", "c_acctbal"], "c_mktsegment", "c_nationkey")


def u3_symdiff(spark, sf_dir):
    return A.symmetric_difference(*_customers(spark, sf_dir)).groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _part_hashes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    basis = part.where(F.col("p_partkey") % 19 != 0).select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("hash"))
    live = part.where(F.col("p_partkey") % 23 != 0).select(F.col("p_partkey").alias("id"), F.md5(F.when(F.col("p_partkey") % 10 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("hash"))
    return basis, live


def a20_plan(spark, sf_dir):
    return A.plan_changes(*_part_hashes(spark, sf_dir))


def a20_affected(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(F.collect_set("l_partkey").alias("sources"))
    return A.affected_cards(items, A.plan_changes(*_part_hashes(spark, sf_dir)))


def a21_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("scope"))
    return A.work_units(docs, "scope", F.col("doc_id"))


def j4_tree(spark, sf_dir):
    """Paths of the region, nation, customer tree, by a recursive query over one parent table."""
    for name in ("region", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"j4_{name}")
    return spark.sql("""
with recursive node as (
  select concat('r', r_regionkey) as id, cast(null as string) as parent, trim(r_name) as name from j4_region
  union all select concat('n', n_nationkey), concat('r', n_regionkey), trim(n_name) from j4_nation
  union all select concat('c', c_custkey), concat('n', c_nationkey), trim(c_name) from j4_customer),
tree as (
  select id, name as path, 1 as depth from node where parent is null
  union all select n.id, concat(t.path, ' / ', n.name), t.depth + 1 from tree t join node n on n.parent = t.id)
select id, path, depth from tree""")


def j10_semi(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    late = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(late, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


def j11_anti(spark, sf_dir):
    """Parts that no large order line names."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(large, "p_partkey", "left_anti").select("p_partkey", "p_name")


def j12_scalar(spark, sf_dir):
    """Counts and last dates of a customer's orders: aggregated first, then joined."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))
    joined = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


def j14_preference(spark, sf_dir):
    """Current text of a part, else the archived one: lowest priority wins."""
    part = table(spark, sf_dir, "part")
    live = part.where("p_size > 10").select("p_partkey", F.lit(0).alias("pri"), F.col("p_name").alias("text"))
    archive = part.select("p_partkey", F.lit(1).alias("pri"), F.upper("p_name").alias("text"))
    return live.unionByName(archive).groupBy("p_partkey").agg(F.min_by("text", "pri").alias("text"), (F.min("pri") == 1).alias("archived"))


def g1_filtered(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = F.count_if(F.col("o_orderstatus") == "F")
    return o.groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), done.alias("done"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"),
        F.when(done == F.count("*"), "ready").when(done > 0, "processing").otherwise("queued").alias("state"),
    )


def g3_pivot(spark, sf_dir):
    kinds = ["signup", "purchase", "view", "click", "error"]
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


def g5_listagg(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("names"))


def g6_mapagg(spark, sf_dir):
    """Map aggregate as sorted entries, and its hash."""
    n = table(spark, sf_dir, "nation")
    entries = F.array_sort(F.collect_list(F.struct("n_nationkey", F.md5("n_name").alias("h"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["n_nationkey"].cast("string"), F.lit(":"), e["h"])), ",")
    return n.groupBy("n_regionkey").agg(text.alias("entries")).withColumn("basis", F.md5("entries"))


def g14_mode_median(spark, sf_dir):
    """Most frequent size of a brand, and the median price weighted by size."""
    p = table(spark, sf_dir, "part")
    counted = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    mode = counted.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", "p_size")).alias("mode_size"))
    order = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    run = p.select("p_brand", "p_retailprice", F.sum("p_size").over(order).alias("until"), F.sum("p_size").over(Window.partitionBy("p_brand")).alias("all"))
    return mode.join(run.where("until * 2 >= all").groupBy("p_brand").agg(F.min("p_retailprice").alias("weighted_median")), "p_brand")


def o2_keyset(spark, sf_dir):
    """A page of the newest orders below a key: filter, order, limit (the page size is the feature)."""
    return table(spark, sf_dir, "orders").where("o_orderkey < 10000").orderBy(F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_custkey")


def u5_expectations(spark, sf_dir):
    """Expected ids as live, archived or missing."""
    expected = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    live = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit(True).alias("is_live"))
    archived = table(spark, sf_dir, "part").where("p_size between 6 and 10").select(F.col("p_partkey").alias("id"), F.lit(True).alias("is_archived"))
    state = F.when(F.col("is_live"), "live").when(F.col("is_archived"), "archived").otherwise("missing")
    return expected.join(live, "id", "left").join(archived, "id", "left").select("id", state.alias("state"))


def f1_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize(F.col("text"))).alias("folded"), F.size(T.word_set(F.col("text"))).alias("n_words"))


def f7_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


def f9_requirement_ids(spark, sf_dir):
    """Ids at the head of order notes written in several forms; some are no ids."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    forms = [
        F.concat(F.lit("FR "), key), F.concat(F.lit("see REQ-"), key, F.lit(".2")), F.concat(F.lit("for "), key), F.concat(F.lit("ISO "), key),
        F.concat(F.lit("NFR"), key, F.lit("a")), F.concat(F.lit("fr-"), key), F.concat(F.lit("UC-A"), key, F.lit("-B")), F.concat(F.repeat(F.lit("x "), 100), F.lit("FR-1")),
    ]
    note = F.concat(F.element_at(F.array(*forms), (k % 8 + 1).cast("int")), F.lit(" shall ship"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.requirement_id(note).alias("req_id"))


def f17_embed_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    given = T.embed_input(F.col("lang"), F.col("source"), F.col("text"))
    return d.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.embed_hash("model-1", given).alias("embed_hash"))


def f20_citations(spark, sf_dir):
    """Citations parsed from answers that cite their turn and conversation numbers."""
    c = table(spark, sf_dir, "conversations")
    answer = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] [3] ["), F.col("conv_id").cast("string"), F.lit("] [0] [3]"))
    return c.select("conv_id", "turn", F.array_join(T.citations(answer, F.lit(8)), ",").alias("cited"))


def q9_last_turns(spark, sf_dir):
    """The last six turns of each conversation as one text."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 6")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", T.snippet(F.col("text"), 240)).alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def t3_sentence_windows(spark, sf_dir):
    return C.per_document(table(spark, sf_dir, "documents"), C.sentence_windows, "piece string")


def t7_token_chunks(spark, sf_dir):
    return C.per_document(table(spark, sf_dir, "documents"), C.token_chunks, "piece string, tokens int")


def s6_sections(spark, sf_dir):
    """Documents as Markdown: each source a chapter, the first line a heading."""
    d = table(spark, sf_dir, "documents")
    md = F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n## "), F.regexp_replace("text", "\n", "\n\n"))
    return C.per_document(d.select("doc_id", md.alias("text")), C.markdown_sections, "title string, section string, section_path string, page int, body string")


def st_tumbling(spark, sf_dir):
    stream = S.tumbling_counts(S.read_events(spark, sf_dir))
    counts = S.run_to_table(stream, Scratch(spark, "st"), "tumbling", "complete")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


def st_sessions(spark, sf_dir):
    found = S.run_to_table(S.sessions(S.read_events(spark, sf_dir)), Scratch(spark, "st"), "sessions", "complete")
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


def st_first_seen(spark, sf_dir):
    seen = S.first_seen(S.read_events(spark, sf_dir), "event_id").select("event_id", "event_type")
    return S.run_to_table(seen, Scratch(spark, "st"), "seen")


def st_latest(spark, sf_dir):
    found = S.run_to_table(S.latest_state(S.read_events(spark, sf_dir), "user_id"), Scratch(spark, "st"), "latest", "complete")
    return found.select("user_id", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        w1_lag, w3_latest, w4_amend, w5_timeline, w6_sliding_count, w6_admitted, e2_state, g9_cycle_stats, g10_report, g11_coverage, e8_carry, e10_run_compare,
        h1_content_hash_dups, a1_exact_matches, a2_unique_ids, a3_similar_pairs, a4_classify, a16_diff, u3_symdiff, a20_plan, a20_affected, a21_units,
        j4_tree, j10_semi, j11_anti, j12_scalar, j14_preference, g1_filtered, g3_pivot, g5_listagg, g6_mapagg, g14_mode_median, o2_keyset, u5_expectations,
        f1_normalize, f7_slug, f9_requirement_ids, f17_embed_hash, f20_citations, q9_last_turns, t3_sentence_windows, t7_token_chunks, s6_sections,
        st_tumbling, st_sessions, st_first_seen, st_latest,
    )
}

_E = f"ev as (select *, {_CASE} as status, json_extract_string(props, '$.k') as tested_hash from events)"
_LAST = "(select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from ev {})"
_STATE = f"""with {_E},
st as (select l.user_id, l.status, l.tested_hash, c.current_hash,
         coalesce(l.status in ('blocked', 'failed', 'passed') and l.tested_hash <> c.current_hash, false) as stale
       from {_LAST.format('')} l join (select user_id, min(tested_hash) as current_hash from ev group by 1) c using (user_id) where l.k = 1)"""
_HALVES = f"""with {_E},
a as (select * from {_LAST.format(f"where ts < timestamp '{HALF}'")} where k = 1),
b as (select * from {_LAST.format(f"where ts >= timestamp '{HALF}'")} where k = 1)"""
_NEW = """
old as (select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer),
new as (select case when c_custkey % 17 = 0 then -c_custkey else c_custkey end as c_custkey, c_name,
          (case when c_custkey % 7 = 0 then (c_nationkey + 1) % 25 else c_nationkey end)::int as c_nationkey,
          case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal,
          case when c_custkey % 3 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment
        from customer where c_custkey % 13 <> 0)"""
_PLAN = """with basis as (select p_partkey as id, md5(p_name) as h from part where p_partkey % 19 <> 0),
live as (select p_partkey as id, md5(case when p_partkey % 10 = 0 then upper(p_name) else p_name end) as h from part where p_partkey % 23 <> 0),
planned as (select coalesce(b.id, l.id) as id, case when b.id is null then 'new' when l.id is null then 'removed' when b.h <> l.h then 'changed' else 'same' end as state
            from basis b full join live l on b.id = l.id)"""
_VERSIONS = """with live as (select doc_id as idx, sha256(text) as h, upper(lang) || '-' || doc_id as req_id from documents),
new as (select doc_id as idx, sha256(case when doc_id % 5 = 0 then 'Revised. ' || text else text end) as h,
          case when doc_id % 2 = 0 then upper(lang) || '-' || doc_id end as req_id from documents where doc_id % 11 <> 0)"""
_FOLD = r"lower(translate(regexp_replace(text, '[ً-ْٰـ]', '', 'g'), 'أإآٱىة', 'اااايه'))"
_WORDS = rf"list_distinct(list_filter(regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2))"

ORACLE = {
    "w1_lag": f"with {_E} select event_id, user_id, status, coalesce(lag(status) over (partition by user_id order by ts, event_id), 'not_tested') as previous from ev",
    "w3_latest": f"with {_E} select user_id, ts, event_id, status, tested_hash from {_LAST.format('')} where k = 1",
    "w4_amend": f"""with {_E},
e as (select *, case when event_type = 'signup' then 'note' else 'status' end as kind, (hour(ts) // 12)::int as tester, (day(ts) // 8)::int as cycle from ev),
l as (select *, lag(ts) over w as ts0, lag(kind) over w as kind0, lag(tester) over w as tester0, lag(cycle) over w as cycle0, lag(status) over w as status0
      from e window w as (partition by user_id order by ts, event_id)),
f as (select *, case when kind = 'status' and kind0 = 'status' and tester = tester0 and cycle = cycle0 and epoch_us(ts) - epoch_us(ts0) <= 86400000000 then 0 else 1 end as fresh from l),
c as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as entry from f)
select user_id, min(event_id) as event_id, min(ts) as ts, min(tester) as tester, min(cycle) as cycle, min(kind) as kind, arg_max(status, (epoch_us(ts), event_id)) as status,
       arg_max(status0, (epoch_us(ts), event_id)) filter (fresh = 0 and status0 <> status) as amended_from, count(*) - 1 as amendments
from c group by user_id, entry""",
    "w5_timeline": """
select event_id, k = 1 as latest, k = 1 and epoch_us(timestamp '2024-01-30') - epoch_us(ts) <= 86400000000 as undoable
from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)""",
    "w6_sliding_count": "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as in_window from events",
    "e2_state": _STATE + " select * from st",
    "g9_cycle_stats": _STATE + " select count(*) as total, count(*) filter (status <> 'not_tested') as executed, count(*) filter (stale) as needs_retest, " + ", ".join(f"count(*) filter (status = '{v}') as {v}" for v in STATUS.values()) + " from st",
    "g10_report": _STATE + """ select user_id % 3 as case_type, count(*) as total, count(*) filter (status <> 'not_tested') as executed,
  round(count(*) filter (status = 'passed') / nullif(count(*) filter (status <> 'not_tested'), 0), 6) as pass_rate,
  round(count(*) filter (status <> 'not_tested') / count(*), 6) as progress from st group by 1""",
    "g11_coverage": _STATE + """, t as (select user_id % 25 as req_id, count(*) as n, count(*) filter (status = 'failed') as f, count(*) filter (status = 'blocked') as b,
    count(*) filter (status = 'passed') as p, count(*) filter (status = 'not_tested') as u, count(*) filter (stale) as s from st group by 1)
select n_nationkey as req_id, coalesce(n, 0) as n_cases, case when n is null then 'uncovered' when f > 0 then 'failed' when b > 0 then 'blocked'
  when p = n and s > 0 then 'retest' when p = n then 'passed' when u = n then 'not_run' else 'partial' end as state from nation left join t on n_nationkey = req_id""",
    "e8_carry": _HALVES + """ select b.user_id, coalesce(a.status = 'passed' and a.tested_hash = b.tested_hash, false) as carried,
  case when coalesce(a.status = 'passed' and a.tested_hash = b.tested_hash, false) then 'passed' else 'not_tested' end as status from b left join a using (user_id)""",
    "e10_run_compare": _HALVES + """ select coalesce(a.user_id, b.user_id) as user_id, a.status as a, b.status as b,
  case when b.status is null then 'dropped' when b.status in ('failed', 'blocked') and a.status = 'passed' then 'regressed'
    when b.status in ('failed', 'blocked') and a.status in ('failed', 'blocked') then 'still_failing' when b.status in ('failed', 'blocked') then 'new_failure'
    when b.status = 'passed' and a.status in ('failed', 'blocked') then 'fixed' when b.status = 'passed' and a.status = 'passed' then 'still_passing'
    when b.status = 'passed' then 'newly_passing' when a.status in ('passed', 'failed', 'blocked') then 'not_rerun' else 'not_run' end as change
  from a full join b on a.user_id = b.user_id""",
    "h1_content_hash_dups": "select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "a1_exact_matches": _VERSIONS + """ select l.idx as live_idx, n.idx as new_idx from (select *, row_number() over (partition by h order by idx) as k from live) l
  join (select *, row_number() over (partition by h order by idx) as k from new) n using (h, k)""",
    "a2_unique_ids": _VERSIONS + """ select l.i as live_idx, n.i as new_idx from (select req_id, min(idx) as i from live group by 1 having count(*) = 1) l
  join (select req_id, min(idx) as i from new where req_id is not null group by 1 having count(*) = 1) n using (req_id)""",
    "a3_similar_pairs": f"""with l as (select item_id as i, {_WORDS} as w from benchmark), n as (select doc_id as j, {_WORDS} as w from documents),
p as (select i, j, len(list_intersect(l.w, n.w)) as c, len(l.w) as a, len(n.w) as b from l, n)
select i as live_idx, j as new_idx, round(c / (a + b - c), 6) as similarity from p where c / (a + b - c) >= 0.2""",
    "a16_diff": "with" + _NEW + """ select coalesce(o.c_custkey, n.c_custkey) as c_custkey,
  case when o.c_custkey is null then 'added' when n.c_custkey is null then 'removed'
    when o.c_name is distinct from n.c_name or o.c_acctbal is distinct from n.c_acctbal then 'modified'
    when o.c_mktsegment is distinct from n.c_mktsegment then 'moved' when o.c_nationkey is distinct from n.c_nationkey then 'reordered' else 'unchanged' end as change,
  case when o.c_custkey is null or n.c_custkey is null then '' else concat_ws(',', case when o.c_name is distinct from n.c_name then 'c_name' end,
    case when o.c_acctbal is distinct from n.c_acctbal then 'c_acctbal' end) end as fields
  from old o full join new n on o.c_custkey = n.c_custkey""",
    "u3_symdiff": "with" + _NEW + """ select side, count(*) as n, round(sum(c_acctbal), 2) as balance from (
  select *, 'old' as side from (select * from old except all select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from new)
  union all select *, 'new' from (select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from new except all select * from old)) group by 1""",
    "a20_plan": _PLAN + " select id, state from planned",
    "a20_affected": _PLAN + """, c as (select distinct l_orderkey as card_id, l_partkey as id from lineitem),
  x as (select card_id, bool_and(coalesce(state = 'removed', false)) as orphan, bool_or(coalesce(state in ('new', 'changed', 'removed'), false)) as t from c left join planned using (id) group by 1)
  select card_id, orphan, t and not orphan as affected from x""",
    "a21_units": "select doc_id, concat_ws('/', lang, source) as scope, ((row_number() over (partition by concat_ws('/', lang, source) order by doc_id) - 1) // 15)::int as unit from documents",
    "j4_tree": """with recursive node as (
  select 'r' || r_regionkey as id, null::varchar as parent, trim(r_name) as name from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, trim(n_name) from nation union all select 'c' || c_custkey, 'n' || c_nationkey, trim(c_name) from customer),
tree as (select id, name as path, 1 as depth from node where parent is null union all select n.id, t.path || ' / ' || n.name, t.depth + 1 from tree t join node n on n.parent = t.id)
select id, path, depth from tree""",
    "j10_semi": "select o_orderpriority, count(*) as orders from orders o where exists (select 1 from lineitem where l_orderkey = o.o_orderkey and l_returnflag = 'R') group by 1",
    "j11_anti": "select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)",
    "j12_scalar": "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select max(o_orderkey) from orders where o_custkey = c_custkey) as last_order from customer",
    "j14_preference": "select p_partkey, case when p_size > 10 then p_name else upper(p_name) end as text, not (p_size > 10) as archived from part",
    "g1_filtered": """select o_orderpriority, count(*) as total, count(*) filter (o_orderstatus = 'F') as done, min(o_orderdate) as first_at, max(o_orderdate) as last_at,
  case when count(*) filter (o_orderstatus = 'F') = count(*) then 'ready' when count(*) filter (o_orderstatus = 'F') > 0 then 'processing' else 'queued' end as state from orders group by 1""",
    "g3_pivot": "select user_id, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in STATUS) + " from events group by 1",
    "g5_listagg": "select n_regionkey, string_agg(distinct n_name, '|' order by n_name) as names from nation group by 1",
    "g6_mapagg": "select *, md5(entries) as basis from (select n_regionkey, string_agg(n_nationkey || ':' || md5(n_name), ',' order by n_nationkey) as entries from nation group by 1)",
    "g14_mode_median": """with c as (select p_brand, p_size, count(*) as n from part group by all),
m as (select p_brand, arg_max(p_size, (n, p_size)) as mode_size from c group by 1),
r as (select p_brand, p_retailprice, sum(p_size) over (partition by p_brand order by p_retailprice, p_partkey) as until, sum(p_size) over (partition by p_brand) as all_ from part)
select p_brand, mode_size, min(p_retailprice) as weighted_median from m join r using (p_brand) where until * 2 >= all_ group by all""",
    "o2_keyset": "select o_orderkey, o_custkey from orders where o_orderkey < 10000 order by o_orderkey desc limit 50",
    "u5_expectations": """select id, case when p_size > 10 then 'live' when p_size between 6 and 10 then 'archived' else 'missing' end as state
  from (select distinct l_partkey as id from lineitem) left join part on p_partkey = id""",
    "f1_normalize": f"select doc_id, md5({_FOLD}) as folded, len({_WORDS}) as n_words from documents",
    "f7_slug": r"""select p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^\p{L}\p{N}_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 80), '^[-_]+|[-_]+$', '', 'g') as slug from part""",
    "f9_requirement_ids": """select o_orderkey, case o_orderkey % 8 when 0 then 'FR-' || o_orderkey when 1 then 'REQ-' || o_orderkey || '.2'
  when 4 then 'NFR' || o_orderkey || 'a' when 6 then 'UC-A' || o_orderkey || '-B' end as req_id from orders""",
    "f17_embed_hash": """select doc_id, greatest(1, round_even(length(text) / 4, 0)::int) as tokens,
  sha256('model-1' || chr(0) || concat_ws(' › ', lang, source) || chr(10) || chr(10) || text) as embed_hash from documents""",
    "f20_citations": """select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_transform(regexp_extract_all(text, '\\[([0-9]{1,9})\\]', 1), lambda x: x::bigint),
  [turn, 3, conv_id]), lambda x: x between 1 and 8))), ',') as cited from conversations""",
    "st_tumbling": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
    "st_sessions": """
with g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 1800000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
c as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as chain from g)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from c group by user_id, chain""",
    "st_latest": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1",
    "st_first_seen": "select distinct event_id, event_type from events",
}
