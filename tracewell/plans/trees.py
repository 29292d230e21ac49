"""Queries on trees and drafts, with their SQL: parts are folders (a heap: part k is in part k div 2), orders are cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.operators import trees as R
from tracewell.plans.retrieval import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _folders(spark, sf_dir):
    """Every 50th part names a parent that does not exist, every 70th is its own one's child and parent: a cycle."""
    key = F.col("p_partkey")
    parent = F.when(key % 50 == 0, -key).when(key % 70 == 0, key).otherwise(F.nullif(F.floor(key / 2), F.lit(0)))
    return table(spark, sf_dir, "part").select(key.alias("id"), parent.alias("parent"), F.col("p_brand").alias("name"), F.nullif("p_size", F.lit(7)).alias("ordinal"))


_TREE = """with recursive f as (
  select p_partkey as id, case when p_partkey % 50 = 0 then -p_partkey when p_partkey % 70 = 0 then p_partkey else nullif(p_partkey // 2, 0) end as parent, p_brand as name, nullif(p_size, 7) as ordinal from part),
g as (select f.*, u.id as up, {'kind': 0, 'last': f.ordinal is null, 'ordinal': coalesce(f.ordinal, 0), 'id': f.id} as node from f left join f u on f.parent = u.id),
t as (
  select id, parent, name, 1 as depth, [name] as path, [node] as key, [id] as ids from g where up is null
  union all select g.id, g.parent, g.name, t.depth + 1, list_append(t.path, g.name), list_append(t.key, g.node), list_append(t.ids, g.id) from t join g on g.up = t.id)"""


@query(f"""{_TREE},
own as (select o_custkey as id, count(*) as n from orders group by 1),
upwards as (select u as id, sum(n)::bigint as n_cases from (select unnest(ids) as u, n from t join own using (id)) group by 1),
r as (
  select 'folder' as kind, t.id, parent, name, depth, path, key, coalesce(n_cases, 0) as n_cases from t left join upwards using (id)
  union all select 'case', o_orderkey, o_custkey, o_orderstatus, depth + 1, path, list_append(key, {{'kind': 1, 'last': false, 'ordinal': o_orderkey % 7, 'id': o_orderkey}}), null from orders join t on t.id = o_custkey)
select row_number() over (order by key) - 1 as position, kind, id, parent, name, depth, array_to_string(path, ' / ') as path, n_cases from r""")
def a25_tree(spark, sf_dir):
    """The whole tree in reading order, with the number of cases in every subtree."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("folder_id"), (F.col("o_orderkey") % 7).alias("ordinal"), F.col("o_orderstatus").alias("name"))
    return R.tree(_folders(spark, sf_dir), cases, Scratch(spark, "tree")).withColumn("path", F.array_join("path", " / "))


@query(f"""{_TREE},
cited as (select distinct l_orderkey as uid, l_partkey as req from lineitem where l_partkey % 9 <> 0),
req as (
  select p_partkey as id, case when p_size > 10 then p_name else upper(p_name) end as text, md5(case when p_size > 10 then p_name else upper(p_name) end) as hash, 'FR-' || p_partkey as req_id
  from part where p_size > 10 or p_partkey % 3 > 0),
e as (
  select uid, string_agg(c.req || ':' || coalesce(hash, 'null'), ',' order by c.req) as hashes, coalesce(string_agg(req_id || '=' || text, ',' order by c.req) filter (where hash is not null), '') as reqs
  from cited c left join req on req.id = c.req group by 1),
l as (select l_orderkey as uid, string_agg(case when l_partkey % 9 = 0 then 'p' else '' end || l_partkey, ' ' order by l_linenumber, l_partkey, l_suppkey) as citations from lineitem group by 1),
c as (select o_orderkey as uid, o_custkey, o_orderkey % 7 as ordinal, o_orderstatus as title, nullif(o_orderpriority, '1-URGENT') as kind, citations from orders left join l on uid = o_orderkey),
d as (select *, md5(concat_ws(chr(31), title, kind, case when citations is not null then '["' || replace(citations, ' ', '","') || '"]' end)) as content_hash from c)
select d.uid, ordinal, coalesce(array_to_string(path, ' / '), '') as folder_path, coalesce(md5(kind), '') as def_hash, content_hash, coalesce(hashes, '') as hashes,
  md5(content_hash || chr(31) || coalesce(hashes, '')) as basis_hash, coalesce(reqs, '') as reqs
from d left join t on t.id = o_custkey left join e on e.uid = d.uid""")
def a14_draft_rows(spark, sf_dir):
    """Every order as a case that cites its lines' parts: some citations are no ids, some texts archived, some gone."""
    lines = table(spark, sf_dir, "lineitem")
    cite = F.concat(F.when(F.col("l_partkey") % 9 == 0, "p").otherwise(""), F.col("l_partkey").cast("string")).alias("v")
    cited = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cite))).getField("v").alias("citations"))
    kind = F.nullif("o_orderpriority", F.lit("1-URGENT"))
    cases = table(spark, sf_dir, "orders").join(cited, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("uid"), (F.col("o_orderkey") % 7).alias("ordinal"), F.col("o_custkey").alias("folder_id"), F.md5(kind).alias("def_hash"), "citations", F.col("o_orderstatus").alias("title"), kind.alias("kind")
    )
    part = table(spark, sf_dir, "part").withColumn("req_id", F.concat(F.lit("FR-"), F.col("p_partkey").cast("string")))
    live = part.where("p_size > 10").select(F.col("p_partkey").alias("id"), "req_id", F.col("p_name").alias("text"))
    archive = part.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), "req_id", F.upper("p_name").alias("text"))
    rows = R.draft_rows(cases, _folders(spark, sf_dir), live, archive, ["title", "kind"], Scratch(spark, "draft"))
    hashes = F.array_join(F.transform(F.map_entries("req_hashes"), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ",")
    reqs = F.array_join(F.transform("reqs", lambda r: F.concat(r["req_id"], F.lit("="), r["text"])), ",")
    return rows.select("uid", "ordinal", F.array_join("folder_path", " / ").alias("folder_path"), "def_hash", "content_hash", hashes.alias("hashes"), "basis_hash", reqs.alias("reqs"))
