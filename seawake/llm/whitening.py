"""Whitening of embeddings by pivoted Cholesky of the centred scatter and one-sided Jacobi on its factor.

Each component c of a vector becomes the whole number x = floor(256 c). The fit list holds every different x vector once.
Its scatter is summed exactly: x is centred by the whole number next to its mean before anything is multiplied, products
are summed as whole numbers, and the part of a unit that is left of the mean is taken off at the end, so the covariance
does not depend on how rows are dealt or on tasks that run twice. The scatter is factored by Cholesky with the largest
pivot first; rotations then make the factor's columns orthogonal, whose squared lengths are the eigenvalues and whose
directions are the components. Only such d x d tables, of whole numbers and of rotations, are on the driver.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are entries so large (2^53 and more,
times 256) that they have no exact x. Vectors of each length are fitted by themselves, the sum of the squared lengths being
at most `CELLS`. Equal eigenvalues keep an arbitrary order. A component without variance has no whitened value (null) and
explains nothing (0; null if nothing varies at all). A deviation beyond a long is null. Repeated rows and null ids each get
their rows; columns besides vec_id and embedding are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.llm.words import cut, shared_folder

SCALE, CELLS, EXACT = 256, 1 << 24, 1 << 53
EPS = np.finfo(np.float64).eps
SUMS = "d int, i int, j int, total decimal(38,0)"


@dataclass
class Model:
    """Of the vectors of one length: their number, sums, components (columns), eigenvalues and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x on the components, over the deviation; NaN for a component without variance."""
        centred = (x * np.float64(self.n) - self.sums) / self.n if self.n * np.abs(x).max(initial=0) >= EXACT else (x * self.n - self.sums) / np.float64(self.n)
        scale = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return centred @ self.components / scale


# ---- the factor and its rotation


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', a column for each pivot, largest first, until nothing of `a` is left but rounding."""
    d = len(a)
    left, columns = np.diag(a).copy(), np.zeros((d, d))
    least = left.max(initial=0) * d * EPS
    for k in range(d):
        p = int(left.argmax())
        if left[p] <= least:
            return columns[:, :k]
        c = a[:, p] - columns[:, :k] @ columns[p, :k]
        columns[:, k] = c / np.sqrt(c[p])
        left -= columns[:, k] ** 2
        left[p] = 0
    return columns


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) of factor factor' and their unit vectors: pairs of columns are rotated until all are orthogonal.

    The pairs of a round share no column (each column meets each other once in a sweep), so a round is a few array steps.
    """
    g, r = factor.copy(), factor.shape[1]
    order = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(order) - 1):
            a, b = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            a, b = a[keep := (a < r) & (b < r)], b[keep]
            x, y = g[:, a], g[:, b]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > EPS * np.sqrt(alpha * beta)
            if turn.any():
                turned = True
                zeta = (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                x, y = x[:, turn], y[:, turn]
                g[:, a[turn]], g[:, b[turn]] = c * x - c * t * y, c * t * x + c * y
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if not turned:
            break
    norms = np.sqrt((g * g).sum(0))
    by = np.argsort(-norms, kind="stable")
    return norms[by] ** 2, g[:, by] / norms[by]


def components_of(n: int, sums: list[int], shifts: list[int], products: list[list[int]], most: int) -> Model:
    """The model from exact sums: `products` of x - shifts. The covariance is (n products - rest rest') / n^2 exactly."""
    d = len(sums)
    rest = [s - n * m for s, m in zip(sums, shifts, strict=True)]
    v = np.array([[(n * products[i][j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    k = min(most, d)
    have = min(k, len(values))
    components, e = np.zeros((d, k)), np.zeros(k)
    components[:, :have], e[:have] = vectors[:, :have], values[:have]
    return Model(n, np.array(sums, np.float64 if max(map(abs, sums)) >= 1 << 62 else np.int64), components, e, float(np.trace(v)))


# ---- Spark


def _x(embedding: Column) -> Column:
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def sound(embedding: str = "embedding") -> Column:
    """Whether a vector has an x."""
    c = F.col(embedding)
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) * SCALE >= EXACT)), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, _matrix(batch.column(column).take(pa.array(rows)))


def gram(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers without limit: in double precision where that is exact, a slice of rows at a time."""
    most = int(np.abs(y).max(initial=0)) or 1
    step = EXACT // (most * most)
    if not step:
        return y.astype(object).T @ y.astype(object)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), step):
        part = y[k : k + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _scatter(shifts: dict[int, np.ndarray]) -> object:
    """Sums of products of x - shifts, the upper half, from each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch, 0):
                totals[d] = totals.get(d, 0) + gram(x - shifts[d])
        for d, t in totals.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(v) for v in t[i, j]], pa.decimal128(38, 0))], ["d", "i", "j", "total"])

    return task


def _spread(models: dict[int, Model]) -> object:
    """Sums of whitened values and of their products, from each task, for the check of the model."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch, 0):
                z = np.column_stack((np.ones(len(x)), models[d].whitened(x)))
                totals[d] = totals.get(d, 0) + z.T @ z
        for d, t in totals.items():
            i, j = np.triu_indices(len(t))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t[i, j])], ["d", "i", "j", "total"])

    return task


def fit(vectors: DataFrame, *, most: int = 4) -> dict[int, Model]:
    """A model for each length of vector. The different x vectors are written once to the shared folder (as Parquet, a byte
    or two an entry) and read three times: for sums, scatter and the check."""
    spark, folder = vectors.sparkSession, f"{shared_folder(vectors.sparkSession)}/whitening-{uuid.uuid4().hex}"
    vectors.filter(sound()).select(_x(F.col("embedding")).alias("x")).distinct().write.parquet(folder)
    different = spark.read.schema("x array<bigint>").parquet(folder)
    per = different.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v")).groupBy("d", "i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sizes = different.select(F.size("x").alias("d")).distinct().agg(F.sum(F.col("d").cast("long") * F.col("d")).alias("cells")).first().cells or 0
    if sizes > CELLS:
        raise ValueError(f"the squared lengths of the vectors sum to {sizes}, more than {CELLS}")
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in per.collect():  # a row for each length and dimension
        sums.setdefault(r.d, {})[r.i] = (r.n, int(r.s))
    shifts = {d: [round(s / n) if abs(s) < EXACT else s // n for n, s in (v[i] for i in range(d))] for d, v in sums.items()}
    arrays = {d: np.array(v, np.int64) for d, v in shifts.items()}
    products = {d: [[0] * d for _ in range(d)] for d in sums}
    for r in different.mapInArrow(_scatter(arrays), SUMS).groupBy("d", "i", "j").agg(F.sum("total").alias("total")).collect():  # at most CELLS rows
        products[r.d][r.i][r.j] = products[r.d][r.j][r.i] = int(r.total)
    models = {d: components_of(v[0][0], [v[i][1] for i in range(d)], shifts[d], products[d], most) for d, v in sums.items()}
    spread: dict[int, dict[tuple[int, int], float]] = {}
    for r in different.mapInArrow(_spread(models), SUMS.replace("decimal(38,0)", "double")).groupBy("d", "i", "j").agg(F.sum("total").alias("total")).collect():
        spread.setdefault(r.d, {})[r.i, r.j] = r.total
    for d, m in models.items():
        real = [k for k in range(len(m.values)) if m.values[k] > 0]
        mean = {k: spread[d][0, k + 1] / m.n for k in real}
        m.error = max((abs(spread[d][a + 1, b + 1] / m.n - mean[a] * mean[b] - (a == b)) for a in real for b in real if a <= b), default=None)
    return models


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 of each row, exact; None beyond a long."""
    bound = int(np.abs(x).max(initial=0)) * model.n + int(np.abs(model.sums).max(initial=0))
    if bound * bound * x.shape[1] < 1 << 63:
        return ((x * model.n - model.sums) ** 2).sum(1).tolist()
    y = x.astype(object) * model.n - np.array([int(s) for s in model.sums], object)
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(1)]


def whiten(vectors: DataFrame, *, most: int = 4, models: dict[int, Model] | None = None) -> DataFrame:
    """Every sound row: vec_id, n, deviation, whitened (an entry for each of up to `most` components), explained, identity_error."""
    models = fit(vectors, most=most) if models is None else models
    kinds = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _by_length(batch, 1):
                m, k = models[d], len(rows)
                z, w = m.whitened(x), len(m.values)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, k * w + 1, w), pa.int32()), pa.array(v.ravel(), from_pandas=True))  # noqa: B023, E731
                share = np.tile(m.values / m.trace if m.trace > 0 else np.full(w, np.nan), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([m.n] * k, pa.int64()), pa.array(deviations(x, m), pa.int64()), lists(z), lists(share), pa.array([m.error] * k, pa.float64())], ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    given = vectors.filter(sound()).select("vec_id", _x(F.col("embedding")).alias("x"))
    return given.mapInArrow(task, f"vec_id {given.schema['vec_id'].dataType.simpleString()}, {kinds}")


def digest(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component."""
    each = whitened.select("*", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.col("explained").alias("e"))).alias("k", "z"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("z.w").alias("whitened"), F.col("z.e").alias("explained"), "identity_error")
