"""Connected components of an edge table by alternating star contractions.

Each round links a node's larger neighbours, then its smaller ones, to the least node it sees; a few rounds, by the
logarithm of the longest chain, leave stars around the least node of each component. Neighbours are reduced by
``min`` before any join, so a node with very many links is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch, label: str = "stars") -> DataFrame:
    """node, root (the least node it is connected with) for all nodes of edges (a, b), of longs."""
    state = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = scratch.save(state, f"{label}0")
    seen, step = _sum(state), 0
    while True:
        step += 1
        # large star: larger neighbours of a node go to the least of its neighbours and itself
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        state = scratch.save(small.where("a <> b").distinct(), f"{label}{step}")
        scratch.drop(f"{label}{step - 1}")
        now = _sum(state)
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
