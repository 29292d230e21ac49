"""Queries on pages of spans and the direction of text, with the SQL that they are compared with: documents laid out in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.operators import pages as P
from tracewell.plans.retrieval import table
from tracewell.plans.suites import _text

QUERIES: dict = {}
ORACLE: dict = {}
WORDS, LINES = 6, 20  # of a line, of a column


def query(sql: str):
    """Registers a query under its name with its SQL."""

    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _spans(spark, sf_dir):
    """Each document as pages of two columns, a large title on the first, a running head on all."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where("size(w) > 0")
    n_lines = F.ceil(F.size("w") / WORDS).cast("int")
    lines = F.transform(F.sequence(F.lit(0), n_lines - 1), lambda k: F.array_join(F.slice("w", k * WORDS + 1, F.lit(WORDS)), " "))
    each = d.select("doc_id", F.posexplode(lines).alias("k", "said"))
    x0, y0 = F.when(F.floor(F.col("k") / LINES) % 2 == 0, 40.0).otherwise(320.0), 100.0 + 12 * (F.col("k") % LINES)
    page = (F.floor(F.col("k") / (2 * LINES)) + 1).cast("int")
    box = lambda x, y, w, size: (x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + size).alias("y1"), F.lit(float(size)).alias("size"), F.lit(False).alias("bold"))
    rest = (F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    body = each.select("doc_id", page.alias("page"), *box(x0, y0, 240.0, 10), F.col("said").alias("text"), *rest)
    heads = body.select("doc_id", "page").distinct()
    head = heads.select("doc_id", "page", *box(F.lit(40.0), F.lit(20.0), 200.0, 10), _text("Report ", "$doc_id", ", page ", "$page").alias("text"), *rest)
    title = d.select("doc_id", F.lit(1).alias("page"), *box(F.lit(40.0), F.lit(60.0), 500.0, 20), _text("Document ", "$doc_id").alias("text"), *rest)
    return body.unionByName(head).unionByName(title)


@query(r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as w from documents),
l as (select doc_id, len(w) as n, unnest(range(0, ((len(w) + 5) // 6)::bigint)) as k, w from w where len(w) > 0),
c as (select doc_id, k // 40 + 1 as page, (k // 20) % 2 as side, string_agg(array_to_string(w[k * 6 + 1 : k * 6 + 6], ' '), ' ' order by k) as text from l group by 1, 2, 3),
p as (select doc_id, max(page) as pages from c group by 1),
every as (select doc_id, page, 2 + side as place, text, false as title from c union all select doc_id, 1, 1, 'Document ' || doc_id, true from p
  union all select doc_id, unnest(range(1, pages + 1)), 0, null, false from p where pages < 3),
named as (select doc_id, page, place, title, coalesce(text, 'Report ' || doc_id || ', page ' || page) as text from every)
select doc_id, page::int as page, (row_number() over (partition by doc_id, page order by place) - 1 + case when pages < 3 then 0 else 1 end)::int as block, case when title then 2 end as level,
  case when title then '## ' || text when text like '#%' then ' ' || text else text end as markdown
from named join p using (doc_id)
where not regexp_full_match(lower(text), '[-–—\s]*\d{1,4}[-–—\s]*|page \d+( of \d+)?')
""")
def s3_page_layout(spark, sf_dir):
    # blocks are used four times: sizes, running lines, headings, text
    return P.structured(Scratch(spark, "pages").save(P.blocks(_spans(spark, sf_dir)), "blocks"))


@query("""
select doc_id, case doc_id % 4 when 0 then 'accepted' when 1 then 'retried' when 2 then 'quarantine' else 'accepted' end as route,
  case doc_id % 4 when 2 then repeat('كتابلا الكتابلا ', 20) when 3 then coalesce(text, '') else repeat('يجب على النظام إدارة الطلبات رقم ' || doc_id || chr(10), 12) end as text
from documents
""")
def s5_direction_gate(spark, sf_dir):
    """Texts in logical order, turned round, wrong beyond repair, and those of the documents themselves."""
    line = F.concat(F.lit("يجب على النظام إدارة الطلبات رقم "), F.col("doc_id").cast("string"))
    # as it is seen from left to right: turned round, the number as it was
    turned = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.reverse(F.lit("يجب على النظام إدارة الطلبات رقم")))
    forms = F.array(F.repeat(F.concat(line, F.lit("\n")), 12), F.repeat(F.concat(turned, F.lit("\n")), 12), F.lit("كتابلا الكتابلا " * 20), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents")
    return P.gate(docs.select("doc_id", F.get(forms, (F.col("doc_id") % 4).cast("int")).alias("text")))
