"""Queries on publishing, with their SQL: orders are cases, their keys' remainders by 20 are scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import versions as V
from tracewell.plans import suites
from tracewell.plans.retrieval import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _published(spark, sf_dir):
    """Scopes divisible by 4 have no version, by 5 no edit, by 3 were reviewed before the edits; by 3 with rest 1 since then."""
    scope = F.abs("uid") % 20
    before, after = (suites._suite(spark, sf_dir, edited).withColumn("scope", scope) for edited in (False, True))
    draft = after.where("scope % 5 <> 0").unionByName(before.where("scope % 5 = 0"))
    versions = table(spark, sf_dir, "nation").where("n_nationkey < 20 and n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("long").alias("scope"), F.col("n_nationkey").cast("long").alias("number"))
    seen = V.fingerprint(before.where("scope % 3 = 0"), "scope").unionByName(V.fingerprint(draft.where("scope % 3 = 1"), "scope"))
    return V.publish(draft, before.where("scope % 4 <> 0"), versions, seen.withColumnRenamed("fingerprint", "expect"), "scope", ["title", "steps"])


_REVIEW = f"""with a16 as ({suites.ORACLE["a16_suite_diff"]}),
d as (
  select uid, abs(uid) % 20 as scope, change, fields, moved, retest from a16 where abs(uid) % 20 % 4 <> 0 and abs(uid) % 20 % 5 <> 0
  union all select o_orderkey, o_orderkey % 20, 'unchanged', '', false, false from orders where o_orderkey % 20 % 4 <> 0 and o_orderkey % 20 % 5 = 0
  union all select case when o_orderkey % 17 = 0 and o_orderkey % 20 % 5 <> 0 then -o_orderkey else o_orderkey end, o_orderkey % 20, 'added', '', false, false
    from orders where o_orderkey % 20 % 4 = 0 and (o_orderkey % 20 % 5 = 0 or o_orderkey % 13 <> 0)),
p as (
  select scope, case when scope % 3 = 0 and scope % 5 <> 0 then 'stale' when scope % 4 <> 0 and scope % 5 = 0 then 'unchanged' else 'published' end as outcome,
    count_if(change = 'added') as added, count_if(change = 'removed') as removed, count_if(change = 'modified') as modified, count_if(change = 'requirement_changed') as requirement_changed,
    count_if(change = 'moved') as moved, count_if(change = 'reordered') as reordered, count_if(change = 'unchanged') as unchanged, count_if(retest) as retest
  from d group by 1),
n as (select *, case when outcome = 'published' then case when scope % 4 <> 0 then scope else 0 end + 1 when scope % 4 <> 0 then scope end as number from p)"""


@query(f"{_REVIEW} select scope, outcome, number, added::bigint as added, removed::bigint as removed, modified::bigint as modified, requirement_changed::bigint as requirement_changed, moved::bigint as moved, reordered::bigint as reordered, unchanged::bigint as unchanged, retest::bigint as retest from n")
def a17_publish(spark, sf_dir):
    """Each scope's outcome: published, unchanged, or stale where the draft is not what was reviewed."""
    return _published(spark, sf_dir)[0]


@query(f"""{_REVIEW} select scope, uid, 'version_' || change as action,
  'Published in v' || number || ' — ' || replace(change, '_', ' ') || case when fields <> '' then ' (' || replace(fields, ',', ', ') || ')' else '' end || case when d.moved and change <> 'moved' then ', moved' else '' end as summary
  from d join n using (scope) where outcome = 'published' and change not in ('reordered', 'unchanged')""")
def a17_audit(spark, sf_dir):
    """What the published versions changed, case by case."""
    return _published(spark, sf_dir)[2]


@query("""with m as (select o_orderkey as uid, o_orderkey % 3 as version from orders),
  c as (select distinct l_orderkey as uid, l_partkey as id from lineitem),
  r as (select uid, string_agg(id || '=' || case when id % 4 > 0 then 'p' || id else '?' end, ',' order by id) as requirements from c group by 1)
  select o.version, o.uid, m.uid is not null as found, case when m.uid is not null then o_orderstatus end as title, case when m.uid is not null then coalesce(requirements, '') end as requirements
  from (select distinct l_suppkey % 3 as version, l_orderkey as uid from lineitem) o left join m using (version, uid) left join orders on o_orderkey = m.uid left join r on r.uid = m.uid""")
def a17_case_in_version(spark, sf_dir):
    """Each order belongs to one of three versions; it is asked for in the versions its lines' suppliers name."""
    suite = suites._suite(spark, sf_dir, False).withColumn("version", F.col("uid") % 3)
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("version"), F.col("l_orderkey").alias("uid"))
    texts = table(spark, sf_dir, "part").where("p_partkey % 4 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("text")).select(F.md5("text").alias("hash"), "text")
    contents = suite.select("content_hash", "data").dropDuplicates(["content_hash"])
    got = V.case_in_version(asked, suite.select("version", "uid", "content_hash", "folder_path", "req_hashes"), contents, texts)
    listed = F.array_join(F.transform("requirements", lambda r: F.concat(r["id"].cast("string"), F.lit("="), F.coalesce(r["text"], F.lit("?")))), ",")
    return got.select("version", "uid", "found", F.col("data.title").alias("title"), listed.alias("requirements"))
