"""An inverted-file index for vector top-k: every vector filed under its nearest centre, a query reads the lists it probes.

Centres come from k-means over a bounded sample (``SAMPLE`` vectors by hash order), at most ``CENTRES``; all vectors are filed, whatever the
sample held. A query asks the ``probes`` lists whose centres are nearest. Lists are cut into blocks, so a list with a third of
all vectors is many units of work, and a unit multiplies one block with the queries that probe its list: no query meets every
vector, nothing but the centres is broadcast. Scores are exact cosines, so what is found is ranked as an exact search ranks it.

Rows without a vector, or with a zero or non-finite one, are in no list; vectors of other widths than the centres' neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.operators.retrieval import _top

SAMPLE, CENTRES, ROUNDS, PROBES = 20_000, 256, 12, 12
PER_CENTRE = 32  # vectors of the sample for one centre, at least
BLOCK = 8192  # vectors of a unit of work
SEED = 7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vectors.withColumn(column, F.col(column).cast("array<double>")).where(F.forall(column, finite) & F.exists(column, lambda v: v != 0))


def centres(vectors: DataFrame, most: int = CENTRES, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres by spherical k-means over a bounded sample of vectors (id, v) of the most frequent width."""
    rows = _usable(vectors, "v")
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if width is None:
        return np.zeros((0, 0))
    taken = rows.where(F.size("v") == width.w).orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).select("v").toArrow()
    x = _unit(taken.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width.w))
    many = max(1, min(most, len(x) // PER_CENTRE))
    random = np.random.default_rng(SEED)
    found = x[random.choice(len(x), many, replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        # a centre that nobody is near, or whose vectors cancel, starts anew at a vector
        lost = size < 1e-12
        found = np.where(lost[:, None], x[random.choice(len(x), many)], sums / np.maximum(size, 1e-12)[:, None])
    return found


def _nearest(rows: DataFrame, column: str, spread, many: int) -> DataFrame:
    """Adds ``lists``: the nearest centres, nearest first."""
    names = [c for c in rows.columns if c != column]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1))
            score = x @ spread.value.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :many].astype(np.int32)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), unit, lists], names=[*names, column, "lists"])

    return rows.select(*names, column).mapInArrow(run, f"{types}{', ' if types else ''}{column} array<double>, lists array<int>")


class VectorIndex:
    """The filed vectors (id, v: unit vectors) by list and block, below a scratch folder."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, most: int = CENTRES, sample: int = SAMPLE):
        self.scratch, self.centres = scratch, centres(vectors, most, sample)
        self.width = self.centres.shape[1]
        self.spread = scratch.spark.sparkContext.broadcast(self.centres)
        rows = _usable(vectors, "v").where(F.size("v") == self.width).select(F.col("id").cast("long").alias("id"), "v")
        filed = _nearest(rows, "v", self.spread, 1).select("id", "v", F.col("lists")[0].alias("list")) if self.width else rows.withColumn("list", F.lit(0))
        self.filed = scratch.save(filed, "filed")
        counts = self.filed.groupBy("list").agg(F.count("*").alias("n"))
        self.blocks = scratch.save(counts.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "blocks")  # a row for each centre at most

    def topk(self, queries: DataFrame, k: int = 20, probes: int = PROBES) -> DataFrame:
        """(query_id, rank, id, score) of queries (query_id, q); a query doesn't find the row of its own id."""
        asked = _usable(queries, "q").where(F.size("q") == self.width).select(F.col("query_id").cast("long").alias("query_id"), "q")
        out = "query_id long, id long, score double"
        if not self.width:
            return _top(self.scratch.spark.createDataFrame([], out), k, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")
        blocks = F.broadcast(self.blocks)
        probing = _nearest(asked, "q", self.spread, min(probes, len(self.centres))).select("query_id", "q", F.explode("lists").alias("list")).join(blocks, "list")
        left = probing.select("query_id", "q", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = self.filed.join(blocks, "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            found = []
            if a.num_rows and b.num_rows:
                x, y = (t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t, c in ((a, "q"), (b, "v")))
                ids, asking, score = b.column("id").to_numpy(), a.column("query_id").to_numpy(), np.round(x @ y.T, 6)
                for i, query in enumerate(asking.tolist()):
                    mine = np.where(ids == query, -2.0, score[i])
                    # everything as good as the k-th, then the first k of it by id
                    at = np.arange(len(ids)) if len(ids) <= k else np.flatnonzero(mine >= np.partition(mine, -k)[-k])
                    at = at[mine[at] > -2]
                    at = at[np.lexsort((ids[at], -mine[at]))[:k]]
                    found += zip([query] * len(at), ids[at].tolist(), mine[at].tolist(), strict=True)
            columns = list(zip(*found, strict=True)) or [[], [], []]
            return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

        met = left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInArrow(best, out)
        return _top(met, k, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")
