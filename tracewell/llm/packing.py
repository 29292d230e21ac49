"""Packing into training sequences by cutting-stock column generation.

A document's ids are cut into whole sequences and one remainder. How many pieces there are of each length is a
histogram of at most ``SEQUENCE`` numbers, which is all that the driver sees. Its linear program (fewest
sequences that hold all pieces, a pattern of lengths per sequence) starts from greedy patterns; then the dual
prices of the lengths go to a knapsack dynamic program that finds better patterns, until the bound that those
prices prove is within ``GAP``. Patterns are used as often as their rounded-down amounts say; what then is left,
fewer sequences than there are lengths, is filled by subset sums.

Each piece gets its rank among the pieces of its length, and the ranks are dealt to the patterns' places, so a
piece finds its sequence and offset alone. Ranks come from counts of ``BUCKETS`` hash buckets per length, so no
length is sorted in one task.

Defined results: a null text has no ids but the closing one; equal rows are packed each; null ids of documents
are carried along; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tokenizing import by_size, encoder

SEQUENCE = 2048
CLOSING_ID = 1
BUCKETS = 1024
GAP = 1e-3
REFRESH = 400
COLUMNS = 64
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, piece_salt int"


def cut_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", sequence: int = SEQUENCE) -> DataFrame:
    """Token pieces of (doc_id, text): start, length, doc_tokens and ids (little-endian unsigned 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks).encode
        for whole in batches:
            for batch in by_size(whole, "text"):
                ids = [np.append(x, CLOSING_ID).astype("<u4") for x in encode(batch.column("text"))]
                tokens = np.array([len(x) for x in ids], dtype=np.int64)
                pieces = -(-tokens // sequence)
                owner = np.repeat(np.arange(len(ids)), pieces)
                starts = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
                lengths = np.minimum(sequence, tokens[owner] - starts)
                bounds = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(bounds), pa.py_buffer(np.concatenate(ids).tobytes())])
                columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(starts), pa.array(lengths), pa.array(tokens[owner]), binary, pa.array(np.arange(len(owner), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "piece_salt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Patterns:
    """Places for ``demand[i]`` pieces of ``lengths[i]`` in sequences of ``sequence``."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, sequence: int = SEQUENCE):
        order = np.argsort(-lengths)
        self.lengths, self.demand, self.sequence = lengths[order].astype(np.int64), demand[order].astype(np.int64), sequence
        self.patterns: list[tuple[dict[int, int], int]] = []  # index of length -> pieces, and how often
        self.bound, self.pivots = 0.0, 0  # no packing has fewer sequences than the bound
        if len(lengths):
            self._solve()

    def _greedy_basis(self) -> tuple[np.ndarray, np.ndarray]:
        """Greedy patterns, each used (in parts, too) until a length is gone: a triangular basis, and its amounts."""
        left, m = self.demand.astype(float), len(self.lengths)
        columns, amounts = [], []
        ascending = self.lengths[::-1]
        while left.any():
            a, space, i = np.zeros(m), self.sequence, int(np.flatnonzero(left)[0])
            while i < m:
                if n := min(space // int(self.lengths[i]), max(1, int(left[i]))):
                    a[i], space = n, space - n * int(self.lengths[i])
                i = max(i + 1, m - int(np.searchsorted(ascending, space, "right")))
                later = np.flatnonzero(left[i:])
                i = i + int(later[0]) if len(later) else m
            used = np.flatnonzero(a)
            parts = left[used] / a[used]
            times = float(parts.min())
            left[used] -= times * a[used]
            gone = used[(parts == times) | (left[used] <= 1e-9)]
            left[gone] = 0
            columns.append(a)
            amounts.append(times)
            for j in gone[1:]:
                single = np.zeros(m)
                single[j] = self.sequence // self.lengths[j]
                columns.append(single)
                amounts.append(0.0)
        return np.array(columns).T, np.array(amounts)

    def _price(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Knapsack: the best value at each capacity, and the length taken last there (-1: none)."""
        best, taken = np.zeros(self.sequence + 1), np.full(self.sequence + 1, -1)
        up, worth = self.lengths[::-1].copy(), value[::-1].copy()
        fitting = np.searchsorted(up, np.arange(self.sequence + 1), "right")
        for c in range(1, self.sequence + 1):
            best[c] = best[c - 1]
            if n := int(fitting[c]):
                total = best[c - up[:n]] + worth[:n]
                j = int(total.argmax())
                if total[j] > best[c] + 1e-12:
                    best[c], taken[c] = total[j], len(up) - 1 - j
        return best, taken

    def _pattern(self, taken: np.ndarray, c: int) -> np.ndarray:
        a = np.zeros(len(self.lengths))
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                a[taken[c]] += 1
                c -= int(self.lengths[taken[c]])
        return a

    def _solve(self) -> None:
        basis, amount = self._greedy_basis()
        inverse = np.linalg.inv(basis)
        bound = float(self.lengths @ self.demand) / self.sequence
        pivots, fresh = 0, 0
        while True:
            if pivots - fresh >= REFRESH:
                inverse, fresh = np.linalg.inv(basis), pivots
                amount = inverse @ self.demand
            price = inverse.sum(axis=0)
            best, taken = self._price(np.maximum(price, 0))
            bound = max(bound, amount.sum() / max(1.0, best[-1]))
            if amount.sum() <= max(bound * (1 + GAP), np.ceil(bound - 1e-6)) + 1e-6:
                break
            # the best patterns that hold a given length, the best of all among them
            gains = price + best[self.sequence - self.lengths]
            entered = 0
            for j in np.argsort(-gains)[:COLUMNS]:
                a = self._pattern(taken, self.sequence - int(self.lengths[j]))
                a[j] += 1
                used = np.flatnonzero(a)
                if price[used] @ a[used] <= 1 + 1e-6:
                    continue
                step = inverse[:, used] @ a[used]
                rows = np.flatnonzero(step > 1e-6)
                ratio = np.maximum(amount[rows], 0) / step[rows]
                tied = rows[ratio <= ratio.min() + 1e-9]
                out = tied[np.argmax(step[tied])]  # of equal ratios the largest pivot, for stability
                length = max(amount[out], 0.0) / step[out]
                amount = amount - length * step
                amount[out] = length
                line = inverse[out] / step[out]
                price += line * (1 - step.sum())
                step[out] = 0
                touched = np.flatnonzero(np.abs(step) > 1e-12)
                inverse[touched] -= np.outer(step[touched], line)
                inverse[out] = line
                basis[:, out] = a
                entered += 1
            pivots += entered
            if not entered:
                break
        self.bound, self.pivots = bound, pivots
        left, patterns = self.demand.copy(), []
        # whole parts first, then one more of each pattern by falling fraction, as long as its pieces are there
        whole = np.floor(np.maximum(amount, 0) + 1e-6)
        for k, most in [(k, int(whole[k])) for k in np.flatnonzero(whole)] + [(k, 1) for k in np.argsort(whole - amount, kind="stable")]:
            used = np.flatnonzero(basis[:, k])
            a = basis[used, k].astype(np.int64)
            if (n := min(most, int((left[used] // a).min()))) and (n == most or whole[k]):
                left[used] -= n * a
                patterns.append(({int(j): int(c) for j, c in zip(used, a, strict=True)}, n))
        self.patterns = patterns + self._fill(left)

    def _fill(self, left: np.ndarray) -> list[tuple[dict[int, int], int]]:
        """One sequence after another: the longest piece left, and the subset of the others that fills it best."""
        patterns = []
        while left.any():
            first = int(np.flatnonzero(left)[0])
            left[first] -= 1
            space = self.sequence - int(self.lengths[first])
            mask, reach, steps = (1 << (space + 1)) - 1, 1, []
            for j in np.flatnonzero(left):
                if (size := int(self.lengths[j])) > space:
                    continue
                for _ in range(min(int(left[j]), space // size)):
                    steps.append((int(j), reach))
                    reach |= (reach << size) & mask
                if reach >> space & 1:
                    break
            total, chosen = reach.bit_length() - 1, {first: 1}
            for j, before in reversed(steps):
                if not before >> total & 1:
                    chosen[j] = chosen.get(j, 0) + 1
                    left[j] -= 1
                    total -= int(self.lengths[j])
            patterns.append((chosen, 1))
        return patterns

    def places(self) -> dict[str, np.ndarray]:
        """Runs of ranks per length, sorted: where they start, the first sequence, pieces in each, offset, sequence size."""
        rows, sequence, rank = [], 0, np.zeros(len(self.lengths), dtype=np.int64)
        for pattern, times in self.patterns:
            offset, size = 0, sum(int(self.lengths[j]) * n for j, n in pattern.items())
            for j, n in sorted(pattern.items()):
                rows.append((int(self.lengths[j]), int(rank[j]), sequence, n, offset, size))
                rank[j] += times * n
                offset += n * int(self.lengths[j])
            sequence += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
        return dict(zip(("length", "rank", "sequence", "each", "offset", "size"), table.T, strict=True))


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id, offset, sequence_tokens and padded_length to stored pieces (doc_id, start, length, ...).

    A sequence is padded to ``sequence``; one whose tokens are a power of two stays as it is. ``all_sequences`` says how
    many there are, and ``least_sequences`` what the linear program proves that any packing needs.
    """
    # all columns, the salt among them: pieces that repeat an id or a whole row do not meet in one bucket
    keyed = pieces.withColumn("_order", F.xxhash64(*pieces.columns)).withColumn("_bucket", F.pmod("_order", F.lit(BUCKETS)).cast("int"))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `sequence` rows
    lengths, demand = (np.array([r[k] for r in histogram], dtype=np.int64) for k in ("length", "n"))
    solved = Patterns(lengths, demand, sequence)
    places = solved.places()
    widest = 1 << 48

    @F.pandas_udf("sequence_id long, offset long, sequence_tokens long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, k = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(places["length"] * widest + places["rank"], size * widest + k, "right") - 1
        nth = k - places["rank"][at]
        return pd.DataFrame(
            {
                "sequence_id": places["sequence"][at] + nth // places["each"][at],
                "offset": places["offset"][at] + nth % places["each"][at] * size,
                "sequence_tokens": places["size"][at],
            }
        )

    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    tie = [c for c in pieces.columns if c not in ("doc_id", "start", "length")]
    within = Window.partitionBy("length", "_bucket").orderBy("_order", "doc_id", "start", *tie)
    ranked = keyed.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    placed = ranked.withColumn("_place", place("length", "_rank"))
    tokens = F.col("_place.sequence_tokens")
    power = tokens.bitwiseAND(tokens - 1) == 0
    return placed.select(
        *[c for c in pieces.columns if c != "piece_salt"],
        "_place.sequence_id",
        "_place.offset",
        tokens.alias("sequence_tokens"),
        F.when(power, tokens).otherwise(F.lit(sequence)).cast("long").alias("padded_length"),
        F.lit(sum(n for _, n in solved.patterns)).cast("long").alias("all_sequences"),
        F.lit(math.ceil(solved.bound - 1e-6)).cast("long").alias("least_sequences"),
    )
