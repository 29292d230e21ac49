"""Queries on logs of edits, with the SQL that they are compared with: lines of an order edit the order's row, in turn."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.operators import edits as E
from tracewell.plans.retrieval import table
from tracewell.plans.suites import _text

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _folded(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    live = o.select(_text("o", "$o_orderkey").alias("row_id"), F.col("o_custkey").alias("doc_id"), ordinal.alias("ordinal"), _text("FR-", "$o_orderkey").alias("req_id"), _text("order ", "$o_orderkey").alias("text"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).withColumn("last", F.lag("l_partkey").over(w))  # noqa: E741
    kind = F.element_at(F.array(*map(F.lit, ("delete", "revert", "split", "add", "edit", "edit", "edit"))), (F.col("l_partkey") % 7 + 1).cast("int"))
    part = _text("part ", "$l_partkey")
    pieces = F.when(kind == "split", F.array(part, _text("rest ", "$l_partkey"))).when(kind == "add", F.array(_text("more ", "$l_partkey"))).when(kind == "edit", F.array(part))
    log = l.select(
        _text("l", "$l_orderkey", "-", "$n").alias("op"), (F.col("l_orderkey") * 100 + F.col("n")).alias("seq"), F.lit(None).cast("long").alias("doc_id"), kind.alias("kind"), _text("o", "$l_orderkey").alias("row_id"),
        F.when(F.col("l_suppkey") % 3 == 0, F.sha2(_text("part ", "$last"), 256)).alias("expected"), pieces.alias("pieces"), F.when(kind == "split", F.array(_text("S-", "$l_partkey"))).alias("req_ids"),
    )
    return E.fold(live, log, Scratch(spark, "edits"))


_STATES = """with recursive l as (
  select l_orderkey as k, l_partkey as p, l_suppkey as sup, row_number() over w as n, lag(l_partkey) over w as last,
    ['delete', 'revert', 'split', 'add', 'edit', 'edit', 'edit'][l_partkey % 7 + 1] as kind from lineitem
  window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)
),
s as (
  select o_orderkey as k, o_custkey as doc_id, 0::bigint as n, 0::bigint as p, 'order ' || o_orderkey as text, 'FR-' || o_orderkey as req, null::varchar as was_req, false as gone,
    null::varchar as b_text, null::varchar as b_kind, null::varchar as b_req, null::varchar as outcome, null::varchar as kind from orders
  union all
  select k, doc_id, n, p, case when oc <> 'applied' then text when kind in ('edit', 'split') then 'part ' || p when kind = 'revert' then b_text else text end,
    case when oc = 'applied' and kind = 'split' then 'S-' || p when oc = 'applied' and kind = 'revert' and b_kind = 'split' then b_req else req end, req, gone or (oc = 'applied' and kind = 'delete'),
    case when oc = 'applied' and kind in ('edit', 'split', 'revert') then text else b_text end, case when oc = 'applied' and kind in ('edit', 'split', 'revert') then kind else b_kind end,
    case when oc = 'applied' and kind in ('edit', 'split', 'revert') then req else b_req end, oc, kind
  from (
    select s.k, s.doc_id, l.n, l.p, s.text, s.req, s.gone, s.b_text, s.b_kind, s.b_req, l.kind, case when s.gone then 'missing'
      when l.kind <> 'add' and l.sup % 3 = 0 and l.last is not null and sha256('part ' || l.last) <> sha256(s.text) then 'conflict'
      when l.kind = 'edit' and s.text = 'part ' || l.p then 'unchanged' when l.kind = 'revert' and (s.b_text is null or s.b_text = s.text) then 'unchanged' else 'applied' end as oc
    from s join l on l.k = s.k and l.n = s.n + 1
  )
)"""


@query(f"{_STATES} select 'l' || k || '-' || n as op, 'o' || k as row_id, outcome from s where n > 0")
def a12_edit_log(spark, sf_dir):
    return _folded(spark, sf_dir)["outcomes"].select("op", "row_id", "outcome")


@query(f"""{_STATES}, last as (select * from s qualify row_number() over (partition by k order by n desc) = 1),
  every as (select doc_id, k, 'o' || k as row_id, req as req_id, text, 0::bigint as turn from last where not gone
    union all select doc_id, k, 'l' || k || '-' || n || case kind when 'split' then '.1' else '.0' end, case kind when 'split' then was_req end, case kind when 'split' then 'rest ' || p else 'more ' || p end, -n from s where outcome = 'applied' and kind in ('split', 'add'))
  select row_id, doc_id, req_id, text, row_number() over (partition by doc_id order by k, turn = 0 desc, turn) - 1 as ordinal from every""")
def a12_live_rows(spark, sf_dir):
    return _folded(spark, sf_dir)["live"].select("row_id", "doc_id", "req_id", "text", "ordinal")


@query(f"""{_STATES} select k * 100 + n as seq, kind, doc_id, case when kind = 'add' then 'l' || k || '-' || n || '.0' else 'o' || k end as row_id, case when kind = 'add' then null else was_req end as req_id,
  case when kind = 'add' then null when kind = 'delete' then text else b_text end as old_text, case kind when 'add' then 'more ' || p when 'delete' then '' else text end as text from s where outcome = 'applied'""")
def a12_audit(spark, sf_dir):
    return _folded(spark, sf_dir)["audit"].select("seq", "kind", "doc_id", "row_id", "req_id", "old_text", "text")
