"""Whitening of embeddings on their leading principal components, found by spectrum slicing.

Entries become whole numbers; their sums and, after taking the whole part of the mean off, the sums of their products are added up exactly
in tasks and merged by a shuffle, so the driver only sees one number for each two dimensions. There the inertia of LDL^T factors of the shifted
covariance counts the eigenvalues above a shift, which isolates each leading eigenvalue between two shifts; Rayleigh quotient
iteration converges cubically from there, and counts on both sides of what it finds certify the component's number.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.registry import query, table
from faultlens.llm.shared import releasing

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 52)  # of a scaled entry that becomes a whole number
EXACT = 1 << 53
LEAST_SHARE = 1e-11  # of the trace; components with less variance can't be told from rounding
_PIVOT = (1 + 17 ** 0.5) / 8  # Bunch and Parlett's bound on the growth of the factors
_DIGITS = pa.decimal128(38, 0)


# --- spectrum slicing -------------------------------------------------------------------------------------------------------------

def positive_eigenvalues(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues: the inertia of D in a pivoted LDL^T factorization (Sylvester's law)."""
    rest = matrix.copy()
    positive = 0
    while len(rest):
        diagonal = np.abs(rest.diagonal())
        p = int(diagonal.argmax())
        apart = np.abs(rest)
        np.fill_diagonal(apart, 0.0)
        r, s = divmod(int(apart.argmax()), len(rest))
        if not max(diagonal[p], apart[r, s]) > 0:
            break
        if diagonal[p] >= _PIVOT * apart[r, s]:
            keep = np.arange(len(rest)) != p
            pivot, column = rest[p, p], rest[keep, p]
            positive += pivot > 0
            rest = rest[np.ix_(keep, keep)] - np.outer(column, column / pivot)
        else:  # a block of determinant below 0 has an eigenvalue of each sign
            keep = np.ones(len(rest), bool)
            keep[[r, s]] = False
            block, columns = rest[np.ix_([r, s], [r, s])], rest[np.ix_(keep, [r, s])]
            positive += 1
            rest = rest[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
    return int(positive)


class Spectrum:
    """Leading eigenpairs of a symmetric matrix without negative eigenvalues."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.size = len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        self.width = 4 * self.size * np.finfo(float).eps * self.norm  # eigenvalues closer than this are one to a double
        self.above = {-self.width: self.size, self.norm + self.width: 0}  # shift: eigenvalues above it
        self.values: list[float] = []
        self.vectors: list[np.ndarray] = []

    def count(self, shift: float) -> int:
        if shift not in self.above:
            self.above[shift] = positive_eigenvalues(self.matrix - shift * np.eye(self.size))
        return self.above[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """Narrowest known shifts between which the eigenvalue of this number lies."""
        return max(s for s, n in self.above.items() if n >= number), min(s for s, n in self.above.items() if n < number)

    def component(self, number: int) -> tuple[float, np.ndarray]:
        """The eigenpair of this number (from 1, by falling eigenvalue); those before it have to be known."""
        start = np.random.default_rng(number).normal(size=self.size)
        while True:
            low, high = self.bracket(number)
            alone = self.count(low) == number and self.count(high) == number - 1
            narrow = high - low <= 2 * self.width
            if alone or narrow:
                value, vector = self._iterate((low + high) / 2, start, steps=2)
                if narrow or low - self.width <= value <= high + self.width and self._certified(value, number):
                    return value, vector
            if narrow:
                raise ArithmeticError(f"component {number} was not found between {low} and {high}")
            self.count((low + high) / 2)

    def _certified(self, value: float, number: int) -> bool:
        return self.count(value - 2 * self.width) >= number > self.count(value + 2 * self.width)

    def _iterate(self, shift: float, vector: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
        """Inverse iteration at the shift, then Rayleigh quotient iteration. Vectors of eigenvalues nearby are kept orthogonal."""
        near = [v for e, v in zip(self.values, self.vectors, strict=True) if abs(e - shift) <= 1e-3 * self.norm]
        vector = self._unit(vector, near)
        best = np.inf
        for step in range(60):
            try:
                solved = np.linalg.solve(self.matrix - shift * np.eye(self.size), vector)
            except np.linalg.LinAlgError:
                solved = np.linalg.solve(self.matrix - (shift + self.width) * np.eye(self.size), vector)
            if not np.isfinite(solved).all():
                break
            vector = self._unit(solved, near)
            value = float(vector @ self.matrix @ vector)
            residual = float(np.linalg.norm(self.matrix @ vector - value * vector))
            if step >= steps and residual >= best / 2 and best <= 16 * self.width:
                break
            best = min(best, residual)
            if step + 1 >= steps:
                shift = value
        return float(vector @ self.matrix @ vector), vector

    @staticmethod
    def _unit(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        vector = vector / np.linalg.norm(vector)
        for _ in range(2):
            for other in others:
                vector = vector - (other @ vector) * other
        return vector / np.linalg.norm(vector)

    def leading(self, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues above ``least``, ``most`` at most, and their unit eigenvectors as columns."""
        wanted = min(most, self.size, self.count(least))
        for number in range(1, wanted + 1):
            value, vector = self.component(number)
            self.values.append(value)
            self.vectors.append(vector)
        return np.array(self.values), np.array(self.vectors).reshape(wanted, self.size).T


# --- sums over all vectors --------------------------------------------------------------------------------------------------------

def _whole(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """Whole numbers of the vectors (last column), a row each."""
    entries = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, dimension) + SHIFT


def _sum_task(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(dimension, object), 0
        for batch in batches:
            x = _whole(batch, dimension)
            n += len(x)
            # Upper and lower parts of the numbers apart: neither sum leaves 64 bits.
            sums += (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), pa.array(map(Decimal, sums.tolist()), _DIGITS)], names=["i", "n", "value"])

    return run


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns, as Python integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest > EXACT:
        whole = y.astype(object)
        return whole.T @ whole
    rows = max(1, EXACT // max(1, largest * largest))  # so many rows sum up exactly in floating point
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for begun in range(0, len(y), rows):
        part = y[begun:begun + rows].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _product_task(centre: np.ndarray):
    dimension = len(centre)
    i, j = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((dimension, dimension), object), 0
        for batch in batches:
            sums += products(_whole(batch, dimension) - centre)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, sums[i, j].tolist()), _DIGITS)], names=["i", "j", "value"])

    return run


@dataclass(frozen=True)
class Whitening:
    """What whitening a vector takes: its whole-number centre, what the mean is beyond it (``rest / n``), weights and shares of the trace."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    explained: np.ndarray

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y - self.rest / self.n) @ self.weights

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 of each vector; null where it leaves 64 bits."""
        largest = self.n * int(np.abs(y).max(initial=0)) + self.n
        if largest * largest * max(1, y.shape[1]) < 1 << 63:
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist(), strict=True)) for row in y.tolist()]
        return [value if value < 1 << 63 else None for value in exact]


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    finite = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE > LARGEST))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(finite)


def fit(rows: DataFrame, dimension: int, most: int = COMPONENTS) -> Whitening:
    """Whitening of ``rows`` (last column: arrays of ``dimension`` finite doubles). The driver gets one sum for each two dimensions."""
    sums = rows.mapInArrow(releasing(_sum_task(dimension)), "i int, n long, value decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    collected = sorted((row.i, row.n, int(row.value)) for row in sums.collect())
    n, totals = collected[0][1], [value for _, _, value in collected]
    centre = np.array([total // n for total in totals], np.int64)
    rest = [total - n * int(c) for total, c in zip(totals, centre, strict=True)]
    merged = rows.mapInArrow(releasing(_product_task(centre)), "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value"))
    covariance = np.zeros((dimension, dimension))
    for row in merged.collect():
        covariance[row.i, row.j] = covariance[row.j, row.i] = float(Fraction(n * int(row.value) - rest[row.i] * rest[row.j], n * n))
    trace = float(covariance.trace())
    values, directions = Spectrum(covariance).leading(most, LEAST_SHARE * trace) if trace > 0 else (np.empty(0), np.empty((dimension, 0)))
    return Whitening(n, centre, np.array(rest, np.int64), values, directions / np.sqrt(values), values / trace if trace > 0 else values)


def _check_task(model: Whitening):
    count = len(model.values)
    i, j = (grid.ravel() for grid in np.mgrid[:count + 1, :count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count + 1, count))
        for batch in batches:
            z = model.whitened(_whole(batch, len(model.centre)) - model.centre)
            sums += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], names=["i", "j", "value"])

    return run


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the whitened rows themselves."""
    count = len(model.values)
    sums = np.zeros((count + 1, count))
    for row in rows.mapInArrow(releasing(_check_task(model)), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        sums[row.i, row.j] = row.value
    mean = sums[count] / model.n
    return float(np.abs(sums[:count] / model.n - np.outer(mean, mean) - np.eye(count)).max(initial=0.0))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten_task(model: Whitening, error: float):
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            y = _whole(batch, len(model.centre)) - model.centre
            place = np.repeat(np.arange(rows), count)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(place)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(len(place), model.n)),
                pa.array(model.deviations(y), pa.int64()).take(pa.array(place)), pa.array(model.whitened(y).ravel()), pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(len(place), error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and each of the ``most`` leading components.

    Vectors that are null or empty, hold a null or non-finite entry or one of 2**42 or more take no part, nor do those of another length than the
    most common one (ties: the longer). All others make up the fit. Components whose variance is below ``LEAST_SHARE`` of the trace
    are left out, so equal vectors and a single one give no rows, like an empty table. Rows repeated under one number, and those with a null
    number, count and are returned one by one. Equal eigenvalues get orthogonal components of their space, the same for all rows. Further
    columns of any name are left out. A deviation beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, vec_id, vector)
    common = usable.groupBy(F.size("v").alias("dimension")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dimension")).first()
    if common is None:
        return spark.createDataFrame([], _RESULT)
    rows = usable.where(F.size("v") == common.dimension)
    model = fit(rows, common.dimension, most)
    if not len(model.values):
        return spark.createDataFrame([], _RESULT)
    return rows.mapInArrow(releasing(_whiten_task(model, identity_error(rows, model))), _RESULT)


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
