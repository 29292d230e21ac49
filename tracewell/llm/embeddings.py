"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Equal vectors are one node with a count. The others are rotated by three rounds of random signs and a fast
Hadamard transform; the largest coordinate and its sign are one hash value. ``FUNCTIONS`` values make a bucket
in each of ``TABLES`` tables. A vector is kept in its own bucket and probes, for each value, the bucket with the
second largest coordinate instead. Vectors that share a bucket, one of them as its own, are a candidate pair; their
cosine is computed in double precision, and pairs of at least ``COSINE`` are linked.

A bucket is dealt into blocks of about ``BLOCK`` vectors and each pair of blocks is one unit of work, so a very
large bucket spreads over many tasks. Pairs are not written: a unit returns, per vector, how many links it found and
the least vector it reaches. A pair that several buckets hold is counted in the first of them only, which the
hash values of both decide.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do
vectors of different lengths; rows that repeat an id are one vector of each distinct value; a row without an id
links with nothing; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm.components import components

TABLES = 16
FUNCTIONS = 3
COSINE = 0.9
BLOCK = 1024
SLICE = 1 << 15
SEED = 20_240_501


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and the fast Hadamard transform; the width is a power of two."""
    n, d = x.shape
    for row in signs:
        x, half = x * row, 1
        while half < d:
            pairs = x.reshape(n, d // (2 * half), 2, half)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, d)
            half *= 2
    return x


def hash_values(vectors: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS) -> np.ndarray:
    """Buckets of each vector: [vectors, tables, 1 + functions], its own first, then those it probes."""
    n, width = vectors.shape
    d = 1 << max(1, (width - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :width] = vectors
    random = np.random.default_rng(SEED + width)
    signs = random.choice([-1.0, 1.0], size=(tables, functions, 3, d))
    out = np.zeros((n, tables, 1 + functions), dtype=np.int64)
    for t in range(tables):
        own, second = [], []
        for f in range(functions):
            r = _rotated(x, signs[t, f])
            size = np.abs(r)
            order = np.argpartition(-size, 1, axis=1)[:, :2]
            values = np.take_along_axis(size, order, 1)
            order = np.where((values[:, :1] >= values[:, 1:]), order, order[:, ::-1])
            code = 2 * order + (np.take_along_axis(r, order, 1) < 0)
            own.append(code[:, 0])
            second.append(code[:, 1])
        for p in range(1 + functions):
            value = np.zeros(n, dtype=np.int64)
            for f in range(functions):
                value = value * (2 * d) + (second[f] if p == f + 1 else own[f])
            out[:, t, p] = value
    return out


def _hashed(nodes: DataFrame, tables: int, functions: int) -> DataFrame:
    """Add ``codes``: the flattened bucket values of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, width = batch.column("vector"), batch.column("width").to_numpy()
            codes: list = [None] * batch.num_rows
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x = vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), w).astype(float)
                for i, row in zip(at, hash_values(x, tables, functions).reshape(len(at), -1), strict=True):
                    codes[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    return nodes.mapInArrow(run, "node long, copies long, width int, vector array<double>, codes array<long>")


def _links(x: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, code: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one unit of work that no earlier bucket holds; left and right are row numbers."""
    norm = np.sqrt((x * x).sum(axis=1))
    found = (x[left] @ x[right].T) / norm[left][:, None] / norm[right][None, :] >= cosine
    i, j = (left[found.nonzero()[0]], right[found.nonzero()[1]])
    if left is right:
        i, j = i[(keep := i < j)], j[keep]
    # a pair of blocks of like vectors has up to a million links: their buckets are compared in slices
    here = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), SLICE):
        x, y = i[a : a + SLICE], j[a : a + SLICE]
        own_x, own_y = codes[x, :, 0], codes[y, :, 0]
        y_finds, x_finds = (codes[y] == own_x[:, :, None]).any(axis=2), (codes[x] == own_y[:, :, None]).any(axis=2)
        meet = y_finds | x_finds
        first = meet.argmax(axis=1)
        at = np.arange(len(x))
        low = np.where(y_finds[at, first], own_x[at, first], np.iinfo(np.int64).max)
        low = np.minimum(low, np.where(x_finds[at, first], own_y[at, first], np.iinfo(np.int64).max))
        here[a : a + SLICE] = meet.any(axis=1) & (first == table) & (low == code)
    return i[here], j[here]


def _units(rows: DataFrame, tables: int, functions: int, cosine: float) -> DataFrame:
    """Links per vector and unit of work, of rows sorted by unit: node, links, least (the least node reached)."""

    def unit(key: tuple, batch: pa.Table) -> tuple | None:
        _, table, code, low, high = key
        node, copies, block = (batch.column(c).to_numpy() for c in ("node", "copies", "block"))
        x = batch.column("vector").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        codes = batch.column("codes").combine_chunks().flatten().to_numpy().reshape(len(node), tables, 1 + functions)
        left = np.flatnonzero(block == low)
        i, j = _links(x, codes, left, left if low == high else np.flatnonzero(block == high), table, code, cosine)
        if not len(i):
            return None
        links = np.zeros(len(node), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        least = node.copy()
        while True:
            before = least.copy()
            np.minimum.at(least, i, least[j])
            np.minimum.at(least, j, least[i])
            if (before == least).all():
                break
        hit = links > 0
        return node[hit], links[hit], least[hit]

    keys = ["width", "table", "code", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None

        def finish():
            if held and (out := unit(now, pa.concat_tables(held))) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["node", "links", "least"])

        for batch in batches:
            values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = tuple(values[a].tolist())
                if key != now:
                    yield from finish()
                    held, now = [], key
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        yield from finish()

    return rows.mapInArrow(run, "node long, links long, least long")


def near_duplicates(table: DataFrame, scratch: Scratch, tables: int = TABLES, functions: int = FUNCTIONS, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept."""
    given = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    usable = F.coalesce((F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    valid = given.where(usable).distinct()
    nodes = valid.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = nodes.select("node", "copies", F.size("vector").alias("width"), "vector")
    hashed = scratch.save(_hashed(nodes, tables, functions), "hashed")

    placed = hashed.select("node", "width", F.posexplode("codes").alias("at", "code"))
    placed = placed.select("node", "width", F.floor(F.col("at") / (1 + functions)).cast("int").alias("table"), "code", (F.col("at") % (1 + functions) == 0).alias("own"))
    bucket = ["width", "table", "code"]
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 and owned")
    sizes = sizes.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # own and probing rows of a vector in one bucket would be one candidate twice
    members = placed.select(*bucket, "node").join(sizes, bucket)
    block = F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).select(
        *bucket, "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select(*bucket, "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    work = dealt.join(hashed.select("node", "copies", "vector", "codes"), "node")
    unit = ["width", "table", "code", "low", "high"]
    found = _units(work.repartition(*unit).sortWithinPartitions(*unit), tables, functions, cosine)
    found = scratch.save(found, "links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), scratch)
    per_node = (
        hashed.select("node", "copies", "vector")
        .join(counts, "node", "left")
        .join(reach, "node", "left")
        .select("vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    )
    linked = given.where(usable).join(per_node, "vector").select("vec_id", "n_links", "component_id")
    alone = given.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
