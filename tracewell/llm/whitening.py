"""Whitening of embeddings by exact covariances: digit-slice products in float64, merged as big integers.

Each entry c becomes the whole number x = floor(64 c) + 1,000,000. The fit list is each distinct x vector once: n vectors with
sums S. Centred entries are the whole numbers y = n x - S, so the covariance of x is the sum of y y' over n^3, without any
rounding before that division.

How the sum stays exact: a task takes the fit list in blocks of ``BLOCK`` vectors and splits y into signed limbs of ``LIMB``
bits. A product of two limb matrices is a float64 BLAS product whose sums stay below 2^53, so it has no rounding error. Limb
products are added as int64, recombined by shifts as Python integers once a task, and sent as rows of the matrix; the rows of
all tasks are summed in Spark, one group per row, as integers. Only the finished matrix, bounded by the square of the width,
reaches the driver. Its eigenvectors come from LAPACK and are then refined in extended precision against the exact matrix.

Vectors of different widths are fitted apart, in turns that hold models of at most ``MODEL_BYTES``; usually there is one.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, as are empty vectors, which have
no entries; a row without an id stays, and so does each of several equal rows; entries beyond the range of long stop at its ends;
``deviation`` is a decimal of 38 digits, null beyond; where an eigenvalue is zero (one distinct vector, dependent entries)
``whitened`` is null, and ``explained`` is null if all are; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
BLOCK = 4096
LIMB = 20  # 2 * (LIMB - 1) bits of a product and the bits of BLOCK are below 53
ROUNDS = 1 << 12  # blocks whose sums int64 holds
MODEL_BYTES = 64 << 20
ROWS = 1 << 16  # rows of one output batch
REFINEMENTS = 4
SUMS = "width int, row int, numbers array<string>"
OUT = "vec_id long, width int, component int, n long, deviation decimal(38,0), whitened double"


def whole_entries(table: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that remain."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    given = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    given = given.where((F.size("x") > 0) & F.forall("x", finite))
    # floor of a double stops at the ends of long
    whole = lambda c: F.least(F.floor(c * F.lit(float(SCALE))), F.lit((1 << 63) - 1 - SHIFT)) + F.lit(SHIFT)
    return given.select("vec_id", F.transform("x", whole).alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, width)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = np.diff(batch.column("x").offsets.to_numpy())
    for width in np.unique(widths).tolist():
        yield width, batch if (widths == width).all() else batch.take(pa.array(np.flatnonzero(widths == width)))


def _texts(numbers) -> list[str]:
    return [str(int(v)) for v in numbers]


def _rows(found: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
    width, row, numbers = ([x[k] for x in found] for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(width, pa.int32()), pa.array(row, pa.int32()), pa.array(numbers, pa.list_(pa.string()))], names=["width", "row", "numbers"])


def _added(parts: DataFrame) -> DataFrame:
    """Sums of the big integers of each (width, row), place by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["width"], r["row"]) != key:
                    if key is not None:
                        yield _rows([(*key, _texts(sums))])
                    key, sums = (r["width"], r["row"]), [0] * len(r["numbers"])
                sums = [a + int(b) for a, b in zip(sums, r["numbers"], strict=True)]
        if key is not None:
            yield _rows([(*key, _texts(sums))])

    return parts.repartition("width", "row").sortWithinPartitions("width", "row").mapInArrow(add, SUMS)


def total(fit: DataFrame) -> DataFrame:
    """Per width one row (row 0): n and then S, as big integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, part in _by_width(batch):
                x = _matrix(part, width)
                small = len(x) * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62
                sums = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
                held[width] = held.get(width, 0) + np.concatenate([[len(x)], sums]).astype(object)
        if held:
            yield _rows([(w, 0, _texts(s)) for w, s in held.items()])

    return _added(fit.mapInArrow(run, SUMS))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """y = n x - S, in int64 where that holds it and as Python integers elsewhere."""
    most = max(abs(int(x.max())), abs(int(x.min())))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of base 2^LIMB, lowest first, as float64."""
    out, half = [], 1 << (LIMB - 1)
    while not out or np.any(y != 0):
        digit = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(digit.astype(np.float64))
        y = (y - digit) >> LIMB
    return out


class Gram:
    """The exact sum of y y' over blocks."""

    def __init__(self, width: int):
        self.width, self.whole, self.open, self.blocks = width, np.zeros((width, width), dtype=object), {}, 0

    def add(self, y: np.ndarray) -> None:
        digits = limbs(y)
        for i, a in enumerate(digits):
            for j, b in enumerate(digits[: i + 1]):
                product = a.T @ b  # exact: whole numbers below 2^53
                # a pair of different limbs occurs in both orders
                self.open[i + j] = self.open.get(i + j, 0) + (product if i == j else product + product.T).astype(np.int64)
        self.blocks += 1
        if self.blocks % ROUNDS == 0:
            self.close()

    def close(self) -> np.ndarray:
        for place, sums in self.open.items():
            self.whole = self.whole + (sums.astype(object) << (LIMB * place))
        self.open = {}
        return self.whole


def gram(fit: DataFrame, totals: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """Rows of the exact sum of y y' per width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gram] = {}
        for batch in batches:
            for width, part in _by_width(batch):
                if width in totals:
                    x = _matrix(part, width)
                    own = held.setdefault(width, Gram(width))
                    for a in range(0, len(x), BLOCK):
                        own.add(centred(x[a : a + BLOCK], *totals[width]))
        for width, own in held.items():
            whole = own.close()
            for i in range(width):
                yield _rows([(width, i, _texts(whole[i]))])

    return _added(fit.mapInArrow(run, SUMS))


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix in extended precision.

    LAPACK's vectors X are improved by X + X E, where E follows from what X' X lacks of the identity and X' A X of a diagonal
    matrix; each step doubles the right digits. For eigenvalues that can't be told apart only the first part of E is used.
    """
    scale = np.abs(matrix).max() or np.longdouble(1)
    a = matrix / scale
    _, x = np.linalg.eigh(a.astype(np.float64))
    x = x.astype(np.longdouble)
    for _ in range(REFINEMENTS):
        lacking = np.eye(len(a), dtype=np.longdouble) - x.T @ x
        inner = x.T @ a @ x
        inner = (inner + inner.T) / 2  # else rounding, over a small distance, would bend right angles
        values = np.diag(inner) / (1 - np.diag(lacking))
        apart = values[None, :] - values[:, None]
        tight = 2 * (np.abs(inner - np.diag(values)).max() + np.abs(values).max() * np.abs(lacking).max()) + np.finfo(np.longdouble).eps
        near = np.abs(apart) <= tight
        e = np.where(near, lacking / 2, (inner + values[None, :] * lacking) / np.where(near, 1, apart))
        x = x + x @ e
    x /= np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)


@dataclass
class Model:
    """What a width's rows are projected with."""

    n: int
    sums: list[int]
    axes: np.ndarray  # [width, components]: unit eigenvectors over the root of their eigenvalue, NaN where that is zero
    explained: list[float | None]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ self.axes


def fitted(n: int, sums: list[int], rows: dict[int, list[int]], components: int = COMPONENTS) -> Model:
    """From the exact matrix of y y' to the model: divisions are of whole numbers, each rounded once to extended precision."""
    width, cube = len(sums), n**3

    def rounded(a: int) -> np.longdouble:
        head = float(Fraction(a, cube))
        return np.longdouble(head) + np.longdouble(float(Fraction(a, cube) - Fraction(head)))

    matrix = np.array([[rounded(v) for v in rows[i]] for i in range(width)], dtype=np.longdouble)
    values, vectors = eigenvectors(matrix)
    trace = rounded(sum(rows[i][i] for i in range(width)))
    many = min(components, width)
    real = values[:many] > np.abs(values).max() * width * np.finfo(np.float64).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(real, vectors[:, :many] / np.sqrt(np.where(real, values[:many], 1)), np.nan).astype(np.float64)
    return Model(n, sums, axes, [float(v / trace) if r else (0.0 if trace > 0 else None) for v, r in zip(values[:many], real, strict=True)])


def identity_error(fit: DataFrame, models: dict[int, Model], spread) -> dict[int, float]:
    """Per width the largest absolute entry of whitened's covariance over the fit list minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for width, part in _by_width(batch):
                if width in spread.value:
                    model, x = spread.value[width], _matrix(part, width)
                    use = np.flatnonzero(~np.isnan(model.axes[0]))
                    own = held.setdefault(width, [np.zeros(len(use)), np.zeros((len(use), len(use)))])
                    for a in range(0, len(x), BLOCK):
                        w = model.whitened(centred(x[a : a + BLOCK], model.n, model.sums))[:, use]
                        own[0] += w.sum(axis=0)
                        own[1] += w.T @ w
        for width, (sums, products) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.concatenate([sums, products.ravel()])], pa.list_(pa.float64()))], names=["width", "values"])

    parts = fit.mapInArrow(run, "width int, values array<double>")
    places = parts.select("width", F.posexplode("values").alias("at", "value")).groupBy("width", "at").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, float]] = {}
    for r in places.collect():  # of each width at most components * (components + 1) numbers
        found.setdefault(r["width"], {})[r["at"]] = r["value"]
    out = {}
    for width, values in found.items():
        n, many = models[width].n, int((~np.isnan(models[width].axes[0])).sum())
        every = np.array([values[k] for k in range(len(values))]) / n
        mean, products = every[:many], every[many:].reshape(many, many)
        out[width] = float(np.abs(products - np.outer(mean, mean) - np.eye(many)).max()) if many else None
    return out


def project(rows: DataFrame, spread) -> DataFrame:
    """A row per vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, every in _by_width(batch):
                if (model := spread.value.get(width)) is None:
                    continue
                many = model.axes.shape[1]
                step = max(1, ROWS // many)
                for a in range(0, every.num_rows, step):
                    part = every.slice(a, step)
                    y = centred(_matrix(part, width), model.n, model.sums)
                    most = max(abs(int(y.max())), abs(int(y.min())))
                    squares = (y * y if most * most * width < 1 << 62 else y.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in squares.tolist()], pa.decimal128(38, 0))
                    nth = np.repeat(np.arange(len(y)), many)
                    whitened = model.whitened(y).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("vec_id").take(pa.array(nth)), pa.array(np.full(len(nth), width, dtype=np.int32)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(y))),
                            pa.array(np.full(len(nth), model.n, dtype=np.int64)), deviation.take(pa.array(nth)), pa.array(whitened, mask=np.isnan(whitened)),
                        ],
                        names=["vec_id", "width", "component", "n", "deviation", "whitened"],
                    )

    return rows.mapInArrow(run, OUT)


def whiten(table: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> DataFrame:
    """vec_id, width, component, n, deviation, whitened, explained, identity_error for each row of table (vec_id, embedding)."""
    spark = scratch.spark
    rows = whole_entries(table)
    fit = scratch.save(rows.select("x").distinct(), "fit")
    totals = {r["width"]: (int(r["numbers"][0]), [int(v) for v in r["numbers"][1:]]) for r in scratch.save(total(fit), "totals").collect()}
    turns: list[list[int]] = []
    room = 0
    for width in sorted(totals):
        if not turns or (room := room - 16 * width * width) < 0:
            turns.append([])
            room = MODEL_BYTES - 16 * width * width
        turns[-1].append(width)
    out = []
    for k, turn in enumerate(turns or [[]]):
        exact: dict[int, dict[int, list[int]]] = {}
        for r in scratch.save(gram(fit, {w: totals[w] for w in turn}), f"gram{k}").toLocalIterator():
            exact.setdefault(r["width"], {})[r["row"]] = [int(v) for v in r["numbers"]]
        models = {w: fitted(*totals[w], exact.pop(w), components) for w in turn}
        spread = spark.sparkContext.broadcast(models)
        errors = identity_error(fit, models, spread)
        known = [(w, i, v, errors.get(w)) for w, m in models.items() for i, v in enumerate(m.explained, 1)]
        facts = spark.createDataFrame(known, "width int, component int, explained double, identity_error double")
        out.append(project(rows, spread).join(F.broadcast(facts), ["width", "component"]))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select("vec_id", "width", "component", "n", "deviation", "whitened", "explained", "identity_error")
