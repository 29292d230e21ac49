"""Hybrid retrieval: vector and keyword top-k, rank fusion, passage rerank, gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T

RRF_K = 60
#: Fixed values of the rank formula: the default weight of a term and pi squared over 6.
TERM_WEIGHT, RANK_NORM = 0.1, 1.64493406685
PASSAGE = 280
#: Rows of a block: at most 64 MB of scores in a task.
QUERY_BLOCK, VECTOR_BLOCK = 512, 16_384
ABSTAIN_BELOW = 0.4
LIST_QUESTION = r"(?i)\b(list|all|every|which|what are|enumerate)\b"


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)

    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def _top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, ranked from 0; Spark limits groups before it shuffles them."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, scope: str | None = None) -> DataFrame:
    """(query_id, rank, id, score) of queries (query_id, q) against vectors (id, v), within equal scope if given.

    Both sides are dealt into blocks by hash, whatever their scopes; a task takes one block of each, multiplies the unit
    vectors and returns the first k of each query, so neither side is broadcast and no pair becomes a row. Rows without a
    vector, or with a zero one, match nothing.
    """
    n_queries, n_vectors = (max(1, -(-x.count() // size)) for x, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    scope_of = lambda name: F.lit("") if scope is None else F.col(name).cast("string")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), scope_of(f"q_{scope}").alias("s"), F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int").alias("qb"), every(n_vectors).alias("vb"))
    given = vectors.select("id", F.col("v").cast("array<double>").alias("v"), scope_of(scope).alias("s"), F.pmod(F.xxhash64("id"), F.lit(n_vectors)).cast("int").alias("vb"), every(n_queries).alias("qb"))

    def units(lists: pa.ChunkedArray) -> np.ndarray:
        x = np.array(lists.to_pylist(), dtype=float)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = right.column("id").to_numpy(), []
        names, labels = right.column("s").to_pylist(), left.column("s").to_pylist()
        if left.num_rows and right.num_rows:
            scores = np.round(units(left.column("q")) @ units(right.column("v")).T, 6)
            codes = {label: c for c, label in enumerate(set(names) | set(labels)) if label is not None}
            mine, theirs = (np.array([codes.get(x, miss) for x in xs]) for xs, miss in ((labels, -1), (names, -2)))
            for i, query in enumerate(left.column("query_id").to_pylist()):
                at = np.flatnonzero((theirs == mine[i]) & (ids != query) & ~np.isnan(scores[i]))
                at = at[np.lexsort((ids[at], -scores[i][at]))[:k]]
                out += [(query, int(j), float(x)) for j, x in zip(ids[at], scores[i][at], strict=True)]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    valid = lambda rows, v: rows.where(F.exists(v, lambda x: x != 0))
    met = valid(asked, "q").groupBy("qb", "vb").cogroup(valid(given, "v").groupBy("qb", "vb")).applyInArrow(lambda left, right: best(left, right), "query_id long, id long, score double")
    return _top(met, k, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of docs (id, body)."""
    return docs.select("id", F.explode(T.all_terms(F.col("body"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms): the query's distinct words, any of which may match."""
    found = queries.select("query_id", T.terms(F.col("question")).alias("terms"))
    return found.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """Rank of an OR query with default weights: per term 0.1 times the sum of 1/j² over its occurrences."""
    asked = query_terms(queries)
    # only words that some query asks for leave the scan's stage
    wanted = asked.select("term").distinct()
    held = docs.select("id", F.explode(T.all_terms(F.col("body"))).alias("term")).join(wanted, "term", "left_semi")
    held = held.groupBy("id", "term").agg(F.count("*").alias("tf"))
    weight = F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda t, j: t + F.lit(1.0) / (j * j))
    matched = held.join(asked, "term").groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(TERM_WEIGHT) * weight / F.lit(RANK_NORM) / F.col("n_terms")), 6).alias("score")
    )
    return _top(matched, k, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")


def fuse(*lists: DataFrame, candidates: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists; ties keep the order of the first list, then of the next."""
    tagged = [x.select("query_id", "id", "rank", F.lit(n).alias("list")) for n, x in enumerate(lists)]
    every = tagged[0]
    for x in tagged[1:]:
        every = every.unionByName(x)
    first = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank{n}") for n in range(len(lists))]
    scored = every.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank") + 1)), 9).alias("score"), *first)
    order = [F.desc("score"), *[F.col(f"rank{n}").asc_nulls_last() for n in range(len(lists))], F.asc("id")]
    return _top(scored, candidates, *order).select("query_id", "rank", "id", "score")


def passages(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """(id, passage_no, passage): lines cut at sentence ends and cells, and windows of over-long ones."""
    parts = F.filter(F.split(F.regexp_replace("body", r"([.!?؟۔])\s+", "$1\n"), r"[\n|]+"), lambda p: F.length(F.trim(p)) > 0)
    cut = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(F.trim(p)) - 1) / length).cast("int")), lambda n: F.substr(F.trim(p), n * length + 1, F.lit(length))
            ),
        )
    )
    return docs.select("id", F.posexplode(cut).alias("passage_no", "passage"))


def overlap_score(question_terms: Column, text: Column) -> Column:
    """Offline stand-in for a reranking model: the share of the question's words that a text holds."""
    return F.size(F.array_intersect(question_terms, T.terms(text))) / F.greatest(F.size(question_terms), F.lit(1))


def rerank_passages(queries: DataFrame, candidates: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """Candidates (query_id, id) by their best passage."""
    asked = queries.select("query_id", T.terms(F.col("question")).alias("terms"))
    texts = passages(docs.join(candidates.select("id").distinct(), "id", "left_semi"))
    scored = candidates.select("query_id", "id").join(texts, "id").join(asked, "query_id")
    best = scored.groupBy("query_id", "id").agg(F.round(F.max(overlap_score(F.col("terms"), F.col("passage"))), 6).alias("score"))
    return _top(best, k, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")


def rerank_document(path: Column, text: Column) -> Column:
    """The section path before the text, unless the text begins with it."""
    starts = F.ltrim(text).startswith(F.substring(path, 1, 40))
    return F.when(path.isNull() | (path == "") | starts, text).otherwise(F.concat_ws("\n", path, text))


def widen(question: Column) -> Column:
    """(k, candidates): more of both for questions that ask for a list."""
    wide = question.rlike(LIST_QUESTION)
    return F.struct(F.when(wide, 8).otherwise(5).alias("k"), F.when(wide, 16).otherwise(10).alias("candidates"))


def abstain(ranked: DataFrame, queries: DataFrame, threshold: float = ABSTAIN_BELOW) -> DataFrame:
    """Per query the top score and whether it is too low to answer."""
    top = ranked.groupBy("query_id").agg(F.max("score").alias("top_score"))
    return queries.select("query_id").join(top, "query_id", "left").withColumn("abstain", F.coalesce(F.col("top_score") < threshold, F.lit(True)))
