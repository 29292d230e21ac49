"""Predicates, joins, aggregates, ordering, sets, text and hash forms over whole tables, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.scratch import Scratch
from tracewell.operators import revisions as V
from tracewell.operators import trees as R
from tracewell.plans.retrieval import table

QUERIES: dict = {}
ORACLE: dict = {}
NOW = "2024-01-20 00:00:00"


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


# --- filters and projections


@query("select c_custkey, c_acctbal from customer where c_nationkey = 5 and c_mktsegment = 'BUILDING'")
def p1_tenant(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_nationkey = 5 and c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")


@query("""select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate, o_orderkey) - 1 as ordinal
  from customer join orders on o_custkey = c_custkey where c_mktsegment = 'MACHINERY'""")
def p2_ordered_list(spark, sf_dir):
    owned = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    rows = owned.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return rows.select("c_custkey", "o_orderkey", place.alias("ordinal"))


@query("select p_partkey, p_size from part where p_size in (1, 5, 9, 33)")
def p3_membership(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size").isin(1, 5, 9, 33)).select("p_partkey", "p_size")


@query("select doc_id, source is not distinct from nullif(source, 'src1') as same, nullif(source, 'src1') is not distinct from null as gone from documents")
def p4_null_safe(spark, sf_dir):
    other = F.nullif(F.col("source"), F.lit("src1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").eqNullSafe(other).alias("same"), other.eqNullSafe(F.lit(None)).alias("gone"))


@query("select p_partkey, count(distinct l_orderkey) as cards from part left join lineitem on l_partkey = p_partkey group by 1")
def p5_containment(spark, sf_dir):
    """How many orders' part arrays contain each part: the arrays are unnested and joined by id, not searched for each part."""
    cards = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("sources"))
    cited = cards.select(F.explode("sources").alias("p_partkey")).groupBy("p_partkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").join(cited, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("cards"))


@query(r"""select event_id, regexp_matches(props, '^\{"k": [0-9]+\}$') as plain, try_cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events""")
def p6_regex(spark, sf_dir):
    number = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.rlike("props", F.lit(r'^\{"k": [0-9]+\}$')).alias("plain"), number.alias("k"))


@query("""with taken as (select distinct p_brand as base, p_size as n from part where p_size % 7 <> 0),
  bounds as (select base, count(*) as m from taken group by 1),
  free as (select base, n from (select base, unnest(generate_series(2, m + 2)) as n from bounds) c where not exists (select 1 from taken t where t.base = c.base and t.n = c.n))
  select base, base || '-' || min(n) as project from free group by 1""")
def p7_free_suffix(spark, sf_dir):
    """The smallest free suffix of 2 or more for each base name: candidates without the taken ones."""
    taken = table(spark, sf_dir, "part").where("p_size % 7 <> 0").select(F.col("p_brand").alias("base"), F.col("p_size").cast("long").alias("n")).distinct()
    candidates = taken.groupBy("base").agg(F.count("*").alias("m")).select("base", F.explode(F.sequence(F.lit(2).cast("long"), F.col("m") + 2)).alias("n"))
    free = candidates.join(taken, ["base", "n"], "left_anti")
    return free.groupBy("base").agg(F.min("n").alias("n")).select("base", F.concat_ws("-", "base", F.col("n").cast("string")).alias("project"))


@query(f"select event_id from events where ts < timestamp '{NOW}' - interval 10 days")
def p8_age(spark, sf_dir):
    old = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(10))
    return table(spark, sf_dir, "events").where(F.col("ts") < old).select("event_id")


@query("select event_id, json_extract_string(props, '$.k')::int as k, json_extract_string(props, '$.none') as none from events")
def p10_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("""select o_orderkey, '{"id":' || o_orderkey || case when o_orderstatus <> 'F' then ',"status":"' || o_orderstatus || '"' else '' end || '}' as data from orders""")
def p11_json_object(spark, sf_dir):
    entry = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.nullif("o_orderstatus", F.lit("F")).alias("status")))
    return table(spark, sf_dir, "orders").select("o_orderkey", entry.alias("data"))


@query("select doc_id, case when length(t) > 44 then rtrim(substr(t, 1, 44)) || '…' else t end as label from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents)")
def p12_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), 44).alias("label"))


@query("select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment from customer")
def p13_case(spark, sf_dir):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return table(spark, sf_dir, "customer").select("c_custkey", band.alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"))


@query("""with r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, count(*) over (partition by c_nationkey) as n from customer),
  s as (select *, (n - 4) / 12.0::double as step from r)
  select c_nationkey, c_custkey from s where n <= 16 or i < 4 or (i - 4) in (select floor(k * step)::bigint from range(12) t(k))""")
def p15_head_and_stride(spark, sf_dir):
    """Sixteen of each group (the sample size is the feature): the first four, then an even stride over the rest."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", place.alias("i"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("n"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.floor(k * (F.col("n") - 4) / F.lit(12.0)))
    return rows.where((F.col("n") <= 16) | (F.col("i") < 4) | F.array_contains(steps, F.col("i").cast("long") - 4)).select("c_nationkey", "c_custkey")


# --- joins


@query("select o_orderkey, c_name, n_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def j1_three_way(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def j2_left_outer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


_TREE = """node as (select 'r' || r_regionkey as id, null::varchar as parent, trim(r_name) as name from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, trim(n_name) from nation union all select 'c' || c_custkey, 'n' || c_nationkey, trim(c_name) from customer)"""


def _tree(spark, sf_dir):
    level = lambda name, mark, key, parent, label: table(spark, sf_dir, name).select(
        F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), parent.cast("string").alias("parent"), F.trim(label).alias("name")
    )
    up = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    rows = level("region", "r", "r_regionkey", F.lit(None), "r_name").unionByName(level("nation", "n", "n_nationkey", up("r", "n_regionkey"), "n_name"))
    return rows.unionByName(level("customer", "c", "c_custkey", up("n", "c_nationkey"), "c_name"))


@query(f"with {_TREE} select c.id, c.name, p.name as parent_name from node c left join node p on p.id = c.parent")
def j3_self_join(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    parents = nodes.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return nodes.join(parents, "parent", "left").select("id", "name", "parent_name")


@query(f"with recursive {_TREE}, up as (select id, parent as ancestor from node where parent is not null union all select u.id, n.parent from up u join node n on n.id = u.ancestor where n.parent is not null) select id, ancestor from up")
def j5_closure(spark, sf_dir):
    """Every node with each of its ancestors (read the other way: its descendants)."""
    return R.ancestors(_tree(spark, sf_dir).select("id", "parent"), Scratch(spark, "closure"))


@query("select c_custkey, o_orderkey as last_order, o_totalprice from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) on o_custkey = c_custkey and k = 1")
def j6_top_one(spark, sf_dir):
    last = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("last")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(last)
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select("c_custkey", F.col("last.o_orderkey").alias("last_order"), "last.o_totalprice")


@query("select o_orderkey, (select md5(c_name) from customer where c_custkey = o_custkey and c_acctbal > 0) as basis from orders")
def j7_scalar_basis(spark, sf_dir):
    basis = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.md5("c_name").alias("basis"))
    return table(spark, sf_dir, "orders").join(basis, "o_custkey", "left").select("o_orderkey", "basis")


@query("select l_orderkey, l_partkey as source, count(*) as n from lineitem group by all")
def j8_unnest_json(spark, sf_dir):
    """Sources kept as JSON arrays, unnested."""
    cards = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("data"))
    return cards.select("l_orderkey", F.explode(F.from_json("data", "array<bigint>")).alias("source")).groupBy("l_orderkey", "source").agg(F.count("*").alias("n"))


@query("select id, count(l_orderkey) as cited, count(l_orderkey) filter (l_returnflag = 'R') as tested from range(1, 301) t(id) left join lineitem on l_partkey = id group by 1")
def j9_g4_ids_left_join(spark, sf_dir):
    """A list of ids against a table: how often each is cited, and how often tested."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("cited"), F.count_if(F.col("l_returnflag") == "R").alias("tested"))
    return spark.range(1, 301).join(items, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cited", "tested")])


@query("with h as (select doc_id, sha256(text) as h from documents), f as (select h, min(doc_id) as owner from h group by 1) select doc_id, owner from h join f using (h)")
def j13_hash_join(spark, sf_dir):
    """Vectors by content address: each row gets what the first row of its hash has."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("embed_hash"))
    known = docs.select("chunk_id", "embed_hash", F.col("chunk_id").alias("vector"))
    return V.publish_vectors(docs, known).where("not missing").select(F.col("chunk_id").alias("doc_id"), F.col("vector").alias("owner"))


_CHANGED = "(select c_custkey, c_name, case when c_custkey % 4 = 0 then null else c_acctbal end as b, case when c_custkey % 6 = 0 then 'X' else c_mktsegment end as s from customer)"


@query(f"select o.c_custkey, (o.c_name, o.c_acctbal, o.c_mktsegment) is distinct from (n.c_name, n.b, n.s) as changed from customer o join {_CHANGED} n using (c_custkey)")
def j17_row_comparison(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    new = old.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 6 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    row = lambda name: F.struct("c_name", "c_acctbal", "c_mktsegment").alias(name)
    both = old.select("c_custkey", row("a")).join(new.select("c_custkey", row("b")), "c_custkey")
    return both.select("c_custkey", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


# --- aggregates, windows, order, sets


@query("select event_type as category, count(*) as n from events group by 1")
def g2_by_category(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))


@query("""select l_orderkey, string_agg('{"part":' || l_partkey || ',"line":' || l_linenumber || '}', ',' order by l_linenumber, l_partkey) as items from lineitem group by 1""")
def g7_object_list(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    text = F.transform(rows, lambda r: F.to_json(F.struct(r["l_partkey"].alias("part"), r["l_linenumber"].alias("line"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(text, ",").alias("items"))


@query("""with o as (select o_custkey as c_custkey, o_orderkey as n from orders union all select c_custkey, c_custkey from customer where c_custkey % 5 = 0)
  select c_custkey, coalesce(max(n), -1) + 1 as next from customer left join o using (c_custkey) group by 1""")
def g8_next_number(spark, sf_dir):
    """The next number of each owner over live and archived ones."""
    live = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("n"))
    owners = table(spark, sf_dir, "customer").select("c_custkey")
    used = live.unionByName(owners.where("c_custkey % 5 = 0").select("c_custkey", F.col("c_custkey").alias("n"))).groupBy("c_custkey").agg(F.max("n").alias("n"))
    return owners.join(used, "c_custkey", "left").select("c_custkey", (F.coalesce("n", F.lit(-1)) + 1).alias("next"))


_REVISED = """old as (select p_partkey as id, p_brand as doc, md5(p_name) as h from part where p_partkey % 19 <> 0),
  new as (select p_partkey as id, p_brand as doc, md5(case when p_partkey % 10 = 0 then upper(p_name) else p_name end) as h from part where p_partkey % 23 <> 0 and (p_brand not like '%1' or p_partkey % 8 = 0)),
  changes as (select coalesce(o.id, n.id) as id, coalesce(o.doc, n.doc) as doc, o.h as was, n.h as now, case when n.id is null then 'removed' when o.id is null then 'added' when o.h = n.h then 'same' else 'modified' end as change
           from old o full join new n on o.id = n.id)"""


def _revised(spark, sf_dir):
    """Parts as a document's rows before and after: (id, doc, content_hash) of either side."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.where(key % 19 != 0).select(key.alias("id"), F.col("p_brand").alias("doc"), F.md5("p_name").alias("content_hash"))
    stays = (key % 23 != 0) & (~F.col("p_brand").endswith("1") | (key % 8 == 0))
    new = p.where(stays).select(key.alias("id"), F.col("p_brand").alias("doc"), F.md5(F.when(key % 10 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("content_hash"))
    return old, new


@query(f"""with {_REVISED}, s as (select doc, count(*) filter (change = 'same') as same, count(*) filter (change = 'modified') as modified, count(*) filter (change = 'added') as added,
    count(*) filter (change = 'removed') as removed from changes group by 1)
  select *, same + modified as matched, same + modified + removed as live, round((same + modified) / (same + modified + removed), 4) as ratio,
    same + modified + removed >= 5 and removed > 0 and (same + modified) / (same + modified + removed) < 0.2 as needs_confirmation from s""")
def g12_g13_revision_gate(spark, sf_dir):
    """What a revision would do to each document, and whether it has to ask."""
    old, new = _revised(spark, sf_dir)
    both = old.select("id", F.col("doc").alias("doc0"), F.col("content_hash").alias("was")).join(new.select("id", "doc", F.col("content_hash").alias("now")), "id", "full")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "same").otherwise("modified")
    return V.replace_gate(V.summary(both.select(F.coalesce("doc", "doc0").alias("doc"), change.alias("change")), "doc"))


@query(f"with {_REVISED} select doc, bool_or(change <> 'same') as stale from changes group by 1")
def a5_staleness(spark, sf_dir):
    return V.stale_scopes(*_revised(spark, sf_dir), "id", "doc")


@query(f"""with {_REVISED} select id, case when now is not null then id end as ordinal, coalesce(now, was) as content_hash,
  case when now is null then 'archived' when was is null and id % 38 = 0 then 'revived' when was is null then 'added' when was = now then 'kept' else 'updated' end as action from changes""")
def a9_reconcile(spark, sf_dir):
    """Rows keep their ids: kept, updated, added, revived (even ids that were in the archive) or archived."""
    old, new = _revised(spark, sf_dir)
    targets = new.select("id", F.col("id").alias("ordinal"), "content_hash", (F.col("id") % 38 == 0).alias("archived"))
    return V.reconcile(targets, old.select("id", "content_hash"), "id")


@query(f"with {_REVISED} select id, case when change in ('added') then 'add' when change = 'modified' then 'edit' else 'delete' end as entry from changes where change <> 'same'")
def a9_e12_audit(spark, sf_dir):
    old, new = _revised(spark, sf_dir)
    done = V.reconcile(new.select("id", F.col("id").alias("ordinal"), "content_hash", F.lit(False).alias("archived")), old.select("id", "content_hash"), "id")
    return V.audit_rows(done, "id")


@query("""select l_partkey as id, coalesce(max(case when p_size > 10 then p_name end), max(upper(p_name))) as text, not bool_or(p_size > 10) as archived
  from lineitem join part on p_partkey = l_partkey where l_orderkey % 7 = 0 group by 1""")
def a10_lookup(spark, sf_dir):
    """Cited ids, from the live rows or else from the archive."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), "p_size")
    ids = table(spark, sf_dir, "lineitem").where("l_orderkey % 7 = 0").select(F.col("l_partkey").alias("id"))
    return V.lookup(ids, part.where("p_size > 10"), part.select("id", F.upper("text").alias("text")), "id", "text")


@query("""with f as (select conv_id, role, min(turn) as t from conversations group by all) select conv_id, string_agg(role, ',' order by t, role) as roles from f group by 1""")
def g15_distinct_in_order(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(roles), ",").alias("roles"))


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1")
def w2_distinct_on(spark, sf_dir):
    newest = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(newest).select("o_custkey", "o.*")


@query("""select o_orderkey, row_number() over (partition by o_custkey order by (o_orderstatus = 'O') desc, nullif(o_orderpriority, '5-LOW') asc nulls first, o_orderkey) as place from orders""")
def o3_sort_by_expression(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "O").desc(), F.nullif("o_orderpriority", F.lit("5-LOW")).asc_nulls_first(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("select lang, source, min(doc_id) as first_seen, count(*) as n, row_number() over (partition by lang order by min(doc_id)) as place from documents group by 1, 2")
def o4_first_seen_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("first_seen")))


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, unnest(generate_series(0, case when l_linenumber = 1 then 1 else 0 end)) as piece from lineitem where l_linenumber <> 2)
  select l_orderkey, l_linenumber, l_partkey, piece, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, piece) - 1 as ordinal from p""")
def o5_ordinal_shift(spark, sf_dir):
    """Lines after one is split in two and another is gone: ordinals from (old ordinal, piece)."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <> 2")
    pieces = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.sequence(F.lit(0), F.when(F.col("l_linenumber") == 1, 1).otherwise(0))).alias("piece"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "piece")
    return pieces.withColumn("ordinal", F.row_number().over(w) - 1)


@query("""with t as (select *, l_returnflag = 'R' as removed, case when l_returnflag <> 'R' then (l_linenumber * 5) % 11 end as target from lineitem),
  k as (select *, case when removed then coalesce(max(target) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), -1) else target end as after from t)
  select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by after, removed, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as ordinal from k""")
def o6_reinsert(spark, sf_dir):
    """Removed lines that stay go behind the furthest target of the lines that stood before them."""
    removed = F.col("l_returnflag") == "R"
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "lineitem").withColumn("removed", removed).withColumn("target", F.when(~removed, (F.col("l_linenumber") * 5) % 11))
    rows = rows.withColumn("after", F.when(F.col("removed"), F.coalesce(F.max("target").over(before), F.lit(-1))).otherwise(F.col("target")))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("after", "removed", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", place.alias("ordinal"))


@query("select md5(p_name) as h from part union select md5(p_brand) from part union select md5(c_mktsegment) from customer")
def u1_union_distinct(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    names = part.select(F.md5("p_name").alias("h")).union(part.select(F.md5("p_brand"))).union(customer.select(F.md5("c_mktsegment")))
    return names.distinct()


@query("select p_partkey, p_name, false as archived from part where p_size > 10 union all select p_partkey, upper(p_name), true from part where p_size <= 20")
def u2_union_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    live = part.where("p_size > 10").select("p_partkey", "p_name", F.lit(False).alias("archived"))
    return live.unionByName(part.where("p_size <= 20").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(True).alias("archived")))


@query("""with a as (select o_custkey, list(distinct o_orderkey % 10) as x, list(distinct o_orderkey % 7) as y from orders group by 1)
  select o_custkey, len(list_intersect(x, y)) as common, len(list_filter(x, lambda v: not list_contains(y, v))) as only_x, len(list_intersect(x, y)) = len(x) as inside from a""")
def u4_set_algebra(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 10).alias("x"), F.collect_set(F.col("o_orderkey") % 7).alias("y"))
    common, rest = F.size(F.array_intersect("x", "y")), F.size(F.array_except("x", "y"))
    return sets.select("o_custkey", common.alias("common"), rest.alias("only_x"), (rest == 0).alias("inside"))


# --- text, hashes, dates, arrays


@query(r"""with t as (select doc_id, replace(replace(text, ' ', '  '), '.', E' .\n\n\n\n ') as t from documents),
  h as (select doc_id, regexp_replace(t, '[ \t]+', ' ', 'g') as t from t), e as (select doc_id, regexp_replace(regexp_replace(t, '[ \t]+(\n)', '\1', 'g'), '(\n)[ \t]+', '\1', 'g') as t from h)
  select doc_id, md5(trim(regexp_replace(t, '\n{3,}', E'\n\n', 'g'), E' \n\r\t')) as folded from e""")
def f6_paragraph_spaces(spark, sf_dir):
    loose = F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("."), F.lit(" .\n\n\n\n "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.paragraph_spaces(loose)).alias("folded"))


@query("select p_partkey, upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), '-', ' ') || ' ' || replace(p_brand, '#', ' ') as title from part")
def f8_title(spark, sf_dir):
    name = F.concat(F.lit("/in/"), F.regexp_replace("p_name", " ", "_"), F.lit("--"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".docx"))
    return table(spark, sf_dir, "part").select("p_partkey", T.title_from_filename(name).alias("title"))


_IDS = """case o_orderkey % 8 when 0 then 'FR-' || o_orderkey when 1 then 'US-' || o_orderkey when 3 then 'NFR-3' when 5 then 'SYS4a' end"""


@query(f"select o_orderkey, {_IDS} as opening, case o_orderkey % 8 when 2 then 'US-02' when 6 then 'BR-7' when 4 then null else {_IDS} end as heading from orders")
def f10_f11_opening_ids(spark, sf_dir):
    """Texts that open with an id and are that requirement, and texts that only mention one."""
    key = F.col("o_orderkey").cast("string")
    forms = [
        F.concat(F.lit("**FR "), key, F.lit("**: The system ships.")), F.concat(F.lit("- User Story ID: US_"), key, F.lit(" Login")), F.lit("US-02 so that users may go on"), F.lit("2. NFR-3"),
        F.lit("FR-4, FR-5 and FR-6 depend on it"), F.lit("رقم المتطلب | SYS4a - دخول"), F.lit("Login (BR-7)"), F.lit("for 3 users"),
    ]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.opening_id(text).alias("opening"), T.heading_id(text).alias("heading"))


@query("""select o_orderkey, o_orderkey % 4 in (0, 3) as is_table, case o_orderkey % 4 when 0 then '| ' || o_orderkey || ' | b |' when 1 then 'one line | ' || o_orderkey when 2 then 'plain ' || o_orderkey
  else '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | d |' end as row from orders""")
def f13_tables(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    forms = [F.concat(F.lit("| a | b |\n| "), key, F.lit(" | b |")), F.concat(F.lit("one line | "), key), F.concat(F.lit("plain "), key), F.concat(F.lit("| a | b |\n| --- | --- |\n| "), key, F.lit(" | d |"))]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.looks_table(text).alias("is_table"), T.row_text(text).alias("row"))


@query("""select l_orderkey, l_linenumber, l_partkey, 'Lines' || chr(10) || '| part | flag |' || chr(10) || '| ' || l_partkey || ' | ' || l_returnflag || ' |' as piece from lineitem""")
def t2_table_rows(spark, sf_dir):
    """Each order's lines as one Markdown table, fanned out into a piece per data row under the header."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    line = lambda r: F.concat(F.lit("| "), r["l_partkey"].cast("string"), F.lit(" | "), r["l_returnflag"], F.lit(" |"))
    md = F.concat(F.lit("Lines\n\n| part | flag |\n| --- | :-: |\n"), F.array_join(F.transform(rows, line), "\n"))
    tables = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(md.alias("md"), F.transform(rows, lambda r: F.struct(r["l_linenumber"].alias("l_linenumber"), r["l_partkey"].alias("l_partkey"))).alias("keys"))
    pieces = tables.select("l_orderkey", "keys", F.posexplode(T.table_pieces(F.col("md"))).alias("at", "piece"))
    return pieces.select("l_orderkey", F.col("keys")[F.col("at")]["l_linenumber"].alias("l_linenumber"), F.col("keys")[F.col("at")]["l_partkey"].alias("l_partkey"), "piece")


@query("select doc_id, lang || ' / ' || coalesce(source, 'none') as path from documents")
def f15_join_path(spark, sf_dir):
    source = F.coalesce("source", F.lit("none"))
    path = T.join_path(F.concat("lang", F.lit(" /  / "), F.col("lang")), F.lit(None).cast("string"), F.concat(F.lit(" "), source, F.lit(" ")), source)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query("""select n_nationkey, case n_nationkey % 4 when 0 then 0.0::double when 1 then 0.5::double when 2 then 1.0::double else 0.0::double end as ratio, n_nationkey % 4 in (1, 2) as fails from nation""")
def f18_visual_order(spark, sf_dir):
    forms = ["يجب على النظام إدارة الطلبات كما هو", "النظام املستخدم", "كتابلا االسم", "plain words"]
    text = F.element_at(F.array(*map(F.lit, forms)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    ratio = T.visual_order_ratio(text)
    return table(spark, sf_dir, "nation").select("n_nationkey", ratio.alias("ratio"), (ratio > T.VISUAL_ORDER_LIMIT).alias("fails"))


@query(r"select doc_id, regexp_replace(lower(trim(regexp_replace(split_part(text, E'\n', 1), '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as print from documents")
def f19_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_fingerprint(F.substring_index("text", "\n", 1)).alias("print"))


@query("select conv_id, turn, turn % 4 = 0 or turn % 4 = 1 or (turn % 4 = 2 and conv_id between 1 and 8) as grounded from conversations")
def f21_grounded(spark, sf_dir):
    forms = [F.lit("  "), F.concat(F.lit("Sorry. "), F.lit(T.ABSTAIN)), F.concat(F.lit("It does ["), F.col("conv_id").cast("string"), F.lit("].")), F.lit("It does not say.")]
    answer = F.element_at(F.array(*forms), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.grounded(answer, F.lit(8)).alias("grounded"))


@query("select event_id, json_extract_string(props, '$.k')::int as k from events")
def f26_lenient_json(spark, sf_dir):
    """The first object in a chatty answer."""
    raw = F.concat(F.lit("Sure, here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    found = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")), "k int")
    return table(spark, sf_dir, "events").select("event_id", found["k"].alias("k"))


@query("""select o_orderkey, sha256('answer' || chr(0) || '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') as key from orders""")
def h2_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.cache_key("answer", F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("key"))


@query("select p_partkey, md5(p_name) as req_hash, md5(concat_ws(chr(31), p_name, coalesce(nullif(p_brand, 'Brand#11'), ''), p_type)) as def_hash, md5(concat_ws(chr(31), p_name, nullif(p_brand, 'Brand#11'), p_type)) as content_hash from part")
def h3_h4_h5_hashes(spark, sf_dir):
    """Hashes of a text, of fields with nulls as empty ones, and of fields without nulls."""
    fields = [F.col("p_name"), F.nullif("p_brand", F.lit("Brand#11")), F.col("p_type")]
    whole = F.md5(F.concat_ws(T.UNIT_SEPARATOR, *fields))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("req_hash"), T.definition_hash(*fields).alias("def_hash"), whole.alias("content_hash"))


@query("""with e as (select n_regionkey, string_agg(n_nationkey || ':' || md5(n_name), ',' order by n_nationkey) as entries from nation group by 1)
  select r_regionkey, md5(md5(nullif(r_name, 'ASIA')) || chr(31) || entries) as basis from region left join e on n_regionkey = r_regionkey""")
def h6_basis(spark, sf_dir):
    """Content hash with the map of requirement hashes; null where either is."""
    n = table(spark, sf_dir, "nation")
    entries = F.array_sort(F.collect_list(F.struct("n_nationkey", F.md5("n_name").alias("h"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["n_nationkey"].cast("string"), F.lit(":"), e["h"])), ",")
    maps = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(text.alias("entries"))
    basis = F.md5(F.concat(F.md5(F.nullif("r_name", F.lit("ASIA"))), F.lit(T.UNIT_SEPARATOR), F.col("entries")))
    return table(spark, sf_dir, "region").join(maps, "r_regionkey", "left").select("r_regionkey", basis.alias("basis"))


@query("select l_orderkey, sha256(string_agg(l_partkey || ':' || l_linenumber, '|' order by l_partkey, l_linenumber)) as batch_hash from lineitem group by 1")
def h7_batch_hash(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["l_partkey"].cast("string"), r["l_linenumber"].cast("string"))), "|")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(text, 256).alias("batch_hash"))


@query(f"select event_id, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 1000000.0::double as age, ts + interval 90 minutes as due, date_trunc('day', ts) as day from events")
def d1_dates(spark, sf_dir):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (micros(F.lit(NOW).cast("timestamp_ntz")) - micros(F.col("ts"))) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("event_id", age.alias("age"), (F.col("ts") + F.make_dt_interval(mins=F.lit(90))).alias("due"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))


@query("select p_partkey, round(1 / log2(p_size + 1), 6) as discount, least(40, greatest(5, p_size)) as clamped, ((p_size + 14) // 15)::bigint as batches from part")
def m1_arithmetic(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(1 / F.log2(size + 1), 6).alias("discount"), F.least(F.lit(40), F.greatest(F.lit(5), size)).alias("clamped"), F.ceil(size / 15).alias("batches"))


@query("select l_orderkey, count(*) as n, count(distinct l_partkey) as distinct_n, bool_or(l_partkey = 100) as has, min(l_partkey) as least from lineitem group by 1")
def n1_arrays(spark, sf_dir):
    cards = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    return cards.select("l_orderkey", F.size("ids").cast("long").alias("n"), F.size(F.array_distinct("ids")).cast("long").alias("distinct_n"), F.array_contains("ids", F.lit(100).cast("long")).alias("has"), F.array_min("ids").alias("least"))


@query("select event_id, (value is null or value < 50) = (event_id % 2 = 0) as correct from events")
def v2_abstention(spark, sf_dir):
    """Whether a case abstains (no score, or one below the threshold) exactly where it should."""
    abstains = F.col("value").isNull() | (F.col("value") < 50)
    return table(spark, sf_dir, "events").select("event_id", (abstains == (F.col("event_id") % 2 == 0)).alias("correct"))
