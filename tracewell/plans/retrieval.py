"""Queries on retrieval and evaluation, with the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.scratch import Scratch
from tracewell.operators import evaluation as E
from tracewell.operators import retrieval as R
from tracewell.operators import vector_index as X

#: The stated query set of searches: every row whose id is divisible by this, against all rows.
EVERY = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    return q, v


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


def r2_vector_topk(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return R.vector_topk(q, v)


def r1_index_topk(spark, sf_dir):
    """The same lists from an inverted-file index: a query reads the lists that it probes."""
    q, v = _vectors(spark, sf_dir)
    return X.VectorIndex(v.select("id", "v"), Scratch(spark, "index")).topk(q.select("query_id", "q"))


def r1_index_recall(spark, sf_dir):
    """Of each query's exact list, how much the index finds."""
    q, v = _vectors(spark, sf_dir)
    exact = R.vector_topk(q, v).select("query_id", "id")
    found = r1_index_topk(spark, sf_dir).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("exact"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.round(F.col("found") / F.col("exact"), 4))


def r2_scoped_topk(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return R.vector_topk(q, v, scope="label")


def r3_query_terms(spark, sf_dir):
    all_ = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return R.query_terms(all_)


def r4_keyword_topk(spark, sf_dir):
    return R.keyword_topk(_questions(spark, sf_dir), _bodies(spark, sf_dir))


def r11_hybrid(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return R.fuse(R.vector_topk(q, v), R.keyword_topk(_questions(spark, sf_dir), _bodies(spark, sf_dir)))


def r9_passages(spark, sf_dir):
    return R.passages(_bodies(spark, sf_dir)).select("id", "passage_no", "passage")


def r10_max_passage(spark, sf_dir):
    questions, docs = _questions(spark, sf_dir), _bodies(spark, sf_dir)
    return R.rerank_passages(questions, R.keyword_topk(questions, docs), docs)


def r12_stages(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    vector, keyword = R.vector_topk(q, v), R.keyword_topk(_questions(spark, sf_dir), _bodies(spark, sf_dir))
    tag = lambda df, s: df.select(F.lit(s).alias("stage"), "query_id", "rank", "id")
    return tag(vector, "vector").unionByName(tag(keyword, "keyword")).unionByName(tag(R.fuse(vector, keyword), "fused"))


def r14_widen(spark, sf_dir):
    all_ = table(spark, sf_dir, "benchmark")
    return all_.select("item_id", R.widen(F.col("text")).alias("w")).select("item_id", "w.k", "w.candidates")


def r15_abstain(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return R.abstain(R.vector_topk(q, v), q)


def _ranked_relevant(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    all_, scoped = R.vector_topk(q, v, k=10), R.vector_topk(q, v, k=10, scope="label")
    ranked = all_.select(F.lit("all").alias("stage"), "query_id", "rank", "id").unionByName(scoped.select(F.lit("scoped").alias("stage"), "query_id", "rank", "id"))
    relevant = q.join(v, (F.col("q_label") == F.col("label")) & (F.col("query_id") != F.col("id"))).select("query_id", "id")
    return ranked, relevant


def v1_ir_metrics(spark, sf_dir):
    return E.ranking_metrics(*_ranked_relevant(spark, sf_dir))


def v3_stage_means(spark, sf_dir):
    return E.stage_means(E.ranking_metrics(*_ranked_relevant(spark, sf_dir)))


def v4_calibrate(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return E.calibrate(docs.join(labels, "doc_id").select((F.col("n_chars") / 1000).alias("score"), (F.col("quality") == 0).alias("abstain")))


def v5_gate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    half = lambda early: events.where((F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")) == early).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    return E.gate(half(True), half(False))


def p14_stride(spark, sf_dir):
    """An even stride over documents in order: the row at floor(i * n / 100) for each i below 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    from pyspark.sql import Window

    # places come from counts per range of ids, so no task numbers all rows
    span = docs.withColumn("span", F.floor(F.col("doc_id") / 4096))
    counts = span.groupBy("span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("span", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    placed = span.join(offsets, "span").withColumn("idx", F.col("before") + F.row_number().over(Window.partitionBy("span").orderBy("doc_id")) - 1)
    step = F.ceil(F.col("idx") * 100 / F.col("all"))
    return placed.where((step < 100) & (F.floor(step * F.col("all") / 100) == F.col("idx"))).select("idx", "doc_id")


_TERMS = r"list_filter(regexp_extract_all(lower(translate(regexp_replace({}, '[ً-ْٰـ]', '', 'g'), 'أإآٱىة', 'اااايه')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2)"
_VECTOR = """
vec as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 as rank from (
  select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score
  from embeddings q join embeddings v on q.vec_id <> v.vec_id {scope} where q.vec_id % 100 = 0))"""
_KEYWORD = f"""
post as (select doc_id as id, term, count(*) as tf from (select doc_id, unnest({_TERMS.format('text')}) as term from documents) group by all),
ask as (select item_id as query_id, unnest(list_distinct({_TERMS.format('text')})) as term, len(list_distinct({_TERMS.format('text')})) as n_terms from benchmark where item_id % 100 = 0),
kw as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 as rank from (
  select query_id, id, round(sum(0.1::double * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::double / (j * j))) / 1.64493406685::double / n_terms), 6) as score
  from post join ask using (term) group by query_id, id))"""
_FUSED = """
fused as (select query_id, id, score, row_number() over (partition by query_id order by score desc, r0 nulls last, r1 nulls last, id) - 1 as rank from (
  select query_id, id, round(sum(1.0::double / (60 + rank + 1)), 9) as score, min(case when l = 0 then rank end) as r0, min(case when l = 1 then rank end) as r1
  from (select query_id, id, rank, 0 as l from vec where rank < 20 union all select query_id, id, rank, 1 from kw where rank < 20) group by query_id, id))"""
_SCOPE = "and q.label = v.label"
_RANKED = f"""with {_VECTOR.format(scope='').strip()},
{_VECTOR.format(scope=_SCOPE).replace('vec as', 'scoped as').strip()},
ranked as (select 'all' as stage, query_id, rank, id from vec where rank < 10 union all select 'scoped', query_id, rank, id from scoped where rank < 10),
rel as (select q.vec_id as query_id, v.vec_id as id from embeddings q join embeddings v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
n as (select query_id, count(*) as n from rel group by 1),
f as (select stage, r.query_id, count(*) filter (r.rank < 5 and rel.id is not null) as hits, count(*) filter (r.rank < 5) as returned,
        min(r.rank) filter (rel.id is not null) as first_rank, coalesce(sum(1 / log2(r.rank + 2)) filter (r.rank < 5 and rel.id is not null), 0) as dcg
      from ranked r left join rel on r.query_id = rel.query_id and r.id = rel.id group by all),
m as (select stage, query_id, (hits > 0)::int as hit, round(hits / n, 6) as recall, round(hits / greatest(returned, 1), 6) as precision,
        round(coalesce(1 / (first_rank + 1), 0), 6) as rr, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg
      from f join n using (query_id))"""

QUERIES = {
    f.__name__: f
    for f in (
        r1_index_topk, r1_index_recall, r2_vector_topk, r2_scoped_topk, r3_query_terms, r4_keyword_topk, r11_hybrid, r9_passages, r10_max_passage, r12_stages, r14_widen, r15_abstain,
        v1_ir_metrics, v3_stage_means, v4_calibrate, v5_gate, p14_stride,
    )
}

ORACLE = {
    "r2_vector_topk": f"with {_VECTOR.format(scope='').strip()} select query_id, rank, id, score from vec where rank < 20",
    "r2_scoped_topk": f"with {_VECTOR.format(scope=_SCOPE).strip()} select query_id, rank, id, score from vec where rank < 20",
    "r3_query_terms": f"select item_id as query_id, unnest(list_distinct({_TERMS.format('text')})) as term, len(list_distinct({_TERMS.format('text')})) as n_terms from benchmark",
    "r4_keyword_topk": f"with {_KEYWORD.strip()} select query_id, rank, id, score from kw where rank < 20",
    "r11_hybrid": f"with {_VECTOR.format(scope='').strip()}, {_KEYWORD.strip()}, {_FUSED.strip()} select query_id, rank, id, score from fused where rank < 10",
    "r12_stages": f"""with {_VECTOR.format(scope='').strip()}, {_KEYWORD.strip()}, {_FUSED.strip()}
select 'vector' as stage, query_id, rank, id from vec where rank < 20 union all select 'keyword', query_id, rank, id from kw where rank < 20
union all select 'fused', query_id, rank, id from fused where rank < 10""",
    "r9_passages": r"""
select doc_id as id, (row_number() over (partition by doc_id order by p, w) - 1)::int as passage_no, substr(t, (w * 280 + 1)::int, 280) as passage
from (select doc_id, p, trim(parts[p]) as t, unnest(range(0, ((length(trim(parts[p])) - 1) // 280) + 1)) as w
      from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as p from (
        select doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?؟۔])\s+', '\1' || chr(10), 'g'), '[\n|]+'), lambda x: length(trim(x)) > 0) as parts from documents)))""",
    "r14_widen": r"""
select item_id, case when w then 8 else 5 end as k, case when w then 16 else 10 end as candidates
from (select item_id, regexp_matches(text, '(?i)\b(list|all|every|which|what are|enumerate)\b') as w from benchmark)""",
    "r15_abstain": f"with {_VECTOR.format(scope='').strip()} select query_id, max(score) as top_score, max(score) < 0.4 as abstain from vec group by 1",
    "v1_ir_metrics": _RANKED + " select * from m",
    "v3_stage_means": _RANKED + " select stage, count(*) as cases, round(avg(hit), 4) as hit, round(avg(recall), 4) as recall, round(avg(precision), 4) as precision, round(avg(rr), 4) as rr, round(avg(ndcg), 4) as ndcg from m group by 1",
    "v4_calibrate": """
with s as (select n_chars / 1000 as score, quality = 0 as abstain from documents join labels using (doc_id)),
d as (select distinct score from s),
t as (select (score + lead(score) over (order by score)) / 2 as th from d union all select min(score) - 0.01 from d union all select max(score) + 0.01 from d),
c as (select th, count(*) filter (not abstain and score >= th) + count(*) filter (abstain and score < th) as correct,
        count(*) filter (not abstain and score < th) as false_abstain, count(*) filter (abstain and score >= th) as false_answer, count(*) as n
      from t cross join s where th is not null group by th)
select round(th, 6) as threshold, round(correct / n, 6) as accuracy, false_abstain, false_answer from c order by correct desc, th desc limit 1""",
    "v5_gate": """
with h as (select event_type as metric, ts < timestamp '2024-01-16' as early, round(avg(value), 4) as v from events group by all)
select a.metric, a.v as was, b.v as now, round(b.v - a.v, 6) as delta, round(b.v - a.v, 6) < -0.02 as failed
from h a join h b on a.metric = b.metric and a.early and not b.early""",
    "p14_stride": """
select idx, doc_id from (select row_number() over (order by doc_id) - 1 as idx, count(*) over () as n, doc_id from documents)
where idx in (select floor(i * (select count(*) from documents) / 100)::bigint from range(0, 100) r(i))""",
}
