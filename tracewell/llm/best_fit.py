"""Vector best-fit packing: tokens, documents and attention cost of a sequence are bounded at once.

A document longer than a sequence is cut into whole sequences and a last, shorter piece; others stay whole. A piece of n tokens
asks for the vector (n tokens, 1 document, n * n attention cost). Pieces go by falling length into open sequences: of those with
room under every capacity, the one that fits best takes the piece, and only where none has room is a sequence opened. Fit is
judged on residual capacities in parts of the whole capacity, by one of two rules:

- ``norm``: the least weighted length of what stays free after the piece;
- ``dot``: the least weighted dot product of the piece and the residual, the tightest where the piece asks most.

Equal lengths ask for equal vectors, so the rule works on counts: open sequences with one residual are one group, and a group
takes pieces in bulk, each of its sequences as many as it holds, which is what piece after piece would give. The driver sees a
histogram of at most ``sequence`` lengths and holds groups, never pieces; ``pack`` tries both rules and keeps the one with
fewer sequences (ties: ``norm``). A piece finds its sequence by its rank among pieces of its length; ranks come
from counts of hash buckets, as many per length as it has pieces to fill, so no length is sorted in one task.

Defined results: a null text has no ids but the closing one; equal rows are packed each; null ids of documents are carried along;
an empty table gives no pieces; further columns are ignored; a piece that no empty sequence can hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tokenizing import by_size, word_encoder

SEQUENCE = 2048
CLOSING_ID = 0
BUCKET = 512  # pieces of one length that are ranked together, about
BLOCK = 4096  # buckets whose counts are added up together
PIECES = "doc_id long, piece int, start long, length long, ids binary, piece_salt long"


def cut_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of (doc_id, text): piece, start, length and ids (little-endian unsigned 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(vocabulary).encode
        for whole in batches:
            for batch in by_size(whole, "text"):
                ids, tokens = encode(batch.column("text"), CLOSING_ID)
                pieces = -(-tokens // sequence)
                owner = np.repeat(np.arange(len(tokens)), pieces)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts = nth * sequence
                lengths = np.minimum(sequence, tokens[owner] - starts)
                bounds = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4").tobytes())])
                columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(nth.astype(np.int32)), pa.array(starts), pa.array(lengths), binary, pa.array(np.arange(len(owner), dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "piece_salt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class BestFit:
    """Sequences for ``demand[i]`` pieces of ``lengths[i]`` tokens, under three capacities."""

    def __init__(
        self, lengths: np.ndarray, demand: np.ndarray, tokens: int = SEQUENCE, documents: int | None = None, attention: int | None = None,
        weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm",
    ):
        # one document asks for one token at least, and squares add up to less than the square of the sum
        self.capacity = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=np.int64)
        self.weights, self.rule = np.array(weights, dtype=float), rule
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset
        self.groups: dict[tuple[int, int, int], list[list[int]]] = {}  # residual -> runs of sequences: first, number, tokens so far
        for i in np.argsort(-lengths, kind="stable"):
            if demand[i]:
                self._place(int(lengths[i]), int(demand[i]))

    def _best(self, ask: np.ndarray) -> tuple[int, int, int] | None:
        """The residual that the rule prefers, of those with room under every capacity; ties: the least residual."""
        if not self.groups:
            return None
        free = np.array(list(self.groups), dtype=np.int64)
        free = free[(free >= ask).all(axis=1)]
        if not len(free):
            return None
        if self.rule == "norm":
            score = (self.weights * ((free - ask) / self.capacity) ** 2).sum(axis=1)
        else:
            score = (self.weights * (ask / self.capacity) * (free / self.capacity)).sum(axis=1)
        return tuple(free[np.lexsort((free[:, 2], free[:, 1], free[:, 0], score))[0]].tolist())

    def _place(self, length: int, left: int) -> None:
        ask, rank = np.array([length, 1, length * length], dtype=np.int64), 0
        if (ask > self.capacity).any():
            raise ValueError(f"no sequence holds a piece of {length} tokens")
        while left:
            free = self._best(ask)
            if free is None:
                most = int((self.capacity // ask).min())
                opened = -(-left // most)
                self.groups[tuple(self.capacity.tolist())] = [[self.sequences, opened, 0]]
                self.sequences += opened
                continue
            held = self.groups[free]
            most = int((np.array(free) // ask).min())
            while held and left:
                first, many, used = held.pop()
                full = min(many, left // most)
                # whole sequences first, then one that takes what is left, then those that stay as they were
                parts = [(first, full, most)] if full else []
                if full < many and left - full * most:
                    parts.append((first + full, 1, left - full * most))
                touched = 0
                for start, n, each in parts:
                    self.runs.append((length, rank, start, each, used))
                    rank, left, touched = rank + n * each, left - n * each, touched + n
                    rest = tuple((np.array(free) - each * ask).tolist())
                    if min(rest):
                        self.groups.setdefault(rest, []).append([start, n, used + each * length])
                if touched < many:
                    held.append([first + touched, many - touched, used])
                    break
            if not held:
                del self.groups[free]

    def places(self) -> dict[str, np.ndarray]:
        """Runs of ranks by length, sorted."""
        table = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def least_sequences(lengths: np.ndarray, demand: np.ndarray, tokens: int = SEQUENCE) -> int:
    """No packing has fewer: pieces over half need one each, and those that don't fit beside the longest add up (Martello and Toth)."""
    best = -(-int(lengths @ demand) // tokens)
    for k in range(tokens // 2 + 1):
        large = int(demand[lengths > tokens - k].sum())
        half = (lengths <= tokens - k) & (2 * lengths > tokens)
        small = (2 * lengths <= tokens) & (lengths >= k)
        room = tokens * int(demand[half].sum()) - int(lengths[half] @ demand[half])
        best = max(best, large + int(demand[half].sum()) + max(0, -(-(int(lengths[small] @ demand[small]) - room) // tokens)))
    return best


def pack(
    pieces: DataFrame, tokens: int = SEQUENCE, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rules: tuple[str, ...] = ("norm", "dot"),
) -> DataFrame:
    """Add sequence_id, offset, all_sequences and least_sequences to stored pieces (doc_id, start, length, ...).

    Capacities: ``tokens`` of a sequence, its ``documents`` (pieces) and its ``attention`` cost, the sum of squared lengths; None
    leaves what the others imply.
    """
    # all columns, the salt among them: pieces that repeat an id or a whole row do not meet in one bucket
    keyed = pieces.withColumn("_order", F.xxhash64(*pieces.columns))
    histogram = {r["length"]: r["n"] for r in keyed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `tokens` rows
    lengths, demand = (np.array(list(x), dtype=np.int64) for x in (histogram.keys(), histogram.values()))
    solved = min((BestFit(lengths, demand, tokens, documents, attention, weights, rule) for rule in rules), key=lambda x: x.sequences)
    places, widest = solved.places(), 1 << 48
    most = np.zeros(tokens + 1, dtype=np.int64)
    most[lengths] = -(-demand // BUCKET)

    @F.pandas_udf("long")
    def buckets(length: pd.Series) -> pd.Series:
        return pd.Series(most[length.to_numpy()])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, k = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(places["length"] * widest + places["rank"], size * widest + k, "right") - 1
        nth = k - places["rank"][at]
        return pd.DataFrame({"sequence_id": places["sequence"][at] + nth // places["each"][at], "offset": places["offset"][at] + nth % places["each"][at] * size})

    keyed = keyed.withColumn("_bucket", F.pmod("_order", buckets("length")))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    # buckets before a bucket: by blocks of them, so that a length of very many pieces is no single sorted group
    block = F.floor(F.col("_bucket") / BLOCK)
    blocks = counts.groupBy("length", block.alias("_block")).agg(F.sum("n").alias("n"))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda by, order: F.coalesce(F.sum("n").over(earlier(by, order)), F.lit(0))
    starts = blocks.select("length", "_block", sums(["length"], "_block").alias("_start"))
    counts = counts.withColumn("_block", block).select("length", "_bucket", "_block", sums(["length", "_block"], "_bucket").alias("_within"))
    before = counts.join(starts, ["length", "_block"]).select("length", "_bucket", (F.col("_start") + F.col("_within")).alias("_before"))
    tie = [c for c in pieces.columns if c not in ("doc_id", "start", "length")]
    within = Window.partitionBy("length", "_bucket").orderBy("_order", "doc_id", "start", *tie)
    ranked = keyed.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(
        *[c for c in pieces.columns if c != "piece_salt"],
        "_place.sequence_id",
        "_place.offset",
        F.lit(solved.sequences).cast("long").alias("all_sequences"),
        F.lit(least_sequences(lengths, demand, tokens) if len(lengths) else 0).cast("long").alias("least_sequences"),
    )
