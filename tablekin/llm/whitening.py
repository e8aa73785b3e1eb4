"""Whitening of embeddings by their leading principal components.

Entries become whole numbers first, so sums over all rows are exact. Tasks sum up their
rows, then what the rows' differences from the mean multiply to; only these d and d x d
statistics reach the driver, whatever the number of rows. There the covariance is made
tridiagonal by Householder reflections, its leading eigenvalues are bisected by Sturm
counts, and inverse iteration finds their vectors, made orthogonal to each other within
clusters of close eigenvalues. The few components go back to the tasks with the
projection, and what the projected rows' covariance lacks to the identity is measured on
the rows themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.session import settle

#: An entry c becomes ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 1024, 100_000

#: Components made, and the gap of eigenvalues, as a share of the largest, below which
#: their vectors are kept orthogonal.
COMPONENTS, CLUSTER = 8, 1e-3

_EPS = float(np.finfo(float).eps)
_LOW = (1 << 32) - 1


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the reflections' directions of a symmetric matrix."""
    a = np.array(matrix, float)
    d = len(a)
    away = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if not size or not np.abs(x[1:]).max():
            continue
        x /= size
        x[0] += math.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        away[k, k + 1 :] = v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        head = a[k + 1 :, k]
        head -= 2 * (v @ head) * v
        a[k, k + 1 :] = head
    return np.diag(a).copy(), np.diag(a, -1).copy(), away


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are less than each of some numbers."""
    scale = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, 1e-300)
    least = _EPS * _EPS * scale
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, np.where(q < 0, -least, least), q)
        q = diagonal[k] - at - off[k - 1] * (off[k - 1] / q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, want: int) -> np.ndarray:
    """The largest eigenvalues, falling, bisected to the spacing of doubles."""
    d = len(diagonal)
    radius = np.zeros(d)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    span = max((np.abs(diagonal) + radius).max(), 1e-300) * 4 * _EPS
    low = np.full(want, (diagonal - radius).min() - span)
    high = np.full(want, (diagonal + radius).max() + span)
    place = d - 1 - np.arange(want)
    while True:
        middle = low + (high - low) / 2
        near = np.maximum(_EPS * np.maximum(np.abs(low), np.abs(high)), _EPS * span)
        if (high - low <= near).all():
            return middle
        left = below(diagonal, off, middle) <= place
        low, high = np.where(left, middle, low), np.where(left, high, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """``(T - value) x = right`` by elimination with exchange of neighbouring rows."""
    d = len(diagonal)
    main, up, far, x = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * d, right.tolist()
    for k in range(d - 1):
        sub, next_main, next_up = float(off[k]), main[k + 1], up[k + 1]
        if abs(sub) > abs(main[k]):
            f = main[k] / sub
            main[k], main[k + 1] = sub, up[k] - f * next_main
            up[k], up[k + 1] = next_main, -f * next_up
            far[k] = next_up
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
        else:
            main[k] = main[k] if abs(main[k]) > least else least
            f = sub / main[k]
            main[k + 1] = next_main - f * up[k]
            x[k + 1] -= f * x[k]
    for k in range(d - 1, -1, -1):
        rest = x[k] - (up[k] * x[k + 1] if k + 1 < d else 0.0) - (far[k] * x[k + 2] if k + 2 < d else 0.0)
        x[k] = rest / (main[k] if abs(main[k]) > least else least)
    return np.array(x)


def _vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix per value, as rows."""
    d, top = len(diagonal), max(np.abs(values).max(), 1e-300)
    random = np.random.default_rng(12)
    out = np.zeros((len(values), d))
    first, shifted = 0, values[0]
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * top:
            first, shifted = i, value
        elif i:
            # Equal values must differ a little, or the solutions would not.
            shifted = min(value, shifted - 4 * _EPS * top)
        else:
            shifted = value
        x = random.uniform(-1, 1, d)
        for _ in range(5):
            x = _solved(diagonal, off, shifted, x / np.linalg.norm(x), _EPS * top)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[first:i].T @ (out[first:i] @ x)
        out[i] = x / np.linalg.norm(x)
    return out


def leading_components(matrix: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and unit vectors as rows.

    The sign makes the largest entry of each vector positive.
    """
    size = np.abs(matrix).max()
    if not size:
        return np.zeros(want), np.eye(len(matrix))[:want]
    diagonal, off, away = tridiagonal(matrix / size)
    values = leading_eigenvalues(diagonal, off, want)
    vectors = _vectors(diagonal, off, values)
    for v in away[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.sign(vectors[np.arange(want), np.abs(vectors).argmax(axis=1)])
    return values * size, vectors * signs[:, None]


def _usable(vector: Column) -> Column:
    """Not missing or empty, all entries present, finite and whole numbers of 62 bits."""
    most = float(1 << 62) / SCALE
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < most))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + SHIFT


class Fit:
    """Exact sums over all rows, and differences from them in a task's rows."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.narrow = np.array(sums, np.int64) if max(map(abs, sums)) < 1 << 62 else None

    def differences(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: in 64 bits where they suffice, else as Python's numbers."""
        if self.narrow is not None and float(np.abs(x).max(initial=0)) * self.n < 1 << 62:
            return x * self.n - self.narrow
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` with a single rounding per step."""
        return (self.differences(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squared differences per row, missing if it is no long."""
        far = self.differences(x)
        if far.dtype != object and float(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return (far * far).sum(axis=1).tolist()
        exact = [sum(int(y) ** 2 for y in row) for row in far]
        return [y if y < 1 << 63 else None for y in exact]


def _sums(vectors: DataFrame) -> tuple[int, list[int]] | None:
    """Number of rows and exact sums per dimension, of the commonest vector length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column("v").value_lengths()
            for d in lengths.unique().to_pylist():
                x = _matrix(batch.filter(pc.equal(lengths, d)), d)
                now = held.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                now[0] += len(x)
                now[1] += (x >> 32).sum(axis=0)
                now[2] += (x & _LOW).sum(axis=0)
        for d, (n, high, low) in held.items():
            columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64())]
            yield pa.record_batch([*columns, pa.array(high), pa.array(low)], ["d", "place", "n", "high", "low"])

    def exact(name: str) -> Column:
        return F.sum(F.col(name).cast("decimal(20,0)")).cast("decimal(38,0)").alias(name)

    parts = vectors.mapInArrow(work, "d int, place int, n long, high long, low long")
    whole = settle(parts.groupBy("d", "place").agg(F.sum("n").alias("n"), exact("high"), exact("low")), "sums")
    common = whole.where("place = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if common is None:
        return None
    rows = whole.where(F.col("d") == common["d"]).orderBy("place").select("high", "low").collect()
    return common["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _products(rows: DataFrame, d: int, make) -> np.ndarray:
    """The d x d sums of products of what ``make`` turns a batch into, added up by Spark."""
    upper = np.triu_indices(d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros((d, d))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                y = make(batch.slice(low, 4096))
                told += y.T @ y
        yield pa.record_batch([pa.array(np.arange(len(upper[0]))), pa.array(told[upper])], ["place", "told"])

    summed = rows.mapInArrow(work, "place long, told double").groupBy("place").agg(F.sum("told").alias("told"))
    out = np.zeros((d, d))
    for place, told in summed.collect():
        i, j = upper[0][place], upper[1][place]
        out[i, j] = out[j, i] = told
    return out


def whiten(rows: DataFrame, id_name: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    One row per remaining row and component, for as many components as the vectors are
    long, ``components`` at most. Rows whose vector is missing, empty, or holds a missing
    or non-finite entry, or one too large for a whole number of 64 bits, are left out,
    and so are vectors of another length than most rows have (of equally frequent
    lengths the longest stays). Repeated rows all count and all come back, as do rows
    without an identifier. ``deviation`` is missing where it is no long. A component
    without variance beyond rounding, as of equal rows, has no ``whitened`` value;
    ``explained`` is missing if there is no variance at all, ``identity_error`` if no
    component has any. No rows give none. Other columns are ignored.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_name]
    v = F.col(vector).cast("array<double>")
    vectors = rows.select(F.col(id_name).alias("id"), v.alias("v")).where(_usable(F.col("v")))
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    found = _sums(vectors.select("v"))
    if found is None:
        return spark.createDataFrame([], schema)
    n, sums = found
    d, fit = len(sums), Fit(n, sums)
    fitting = vectors.where(F.size("v") == d)
    covariance = _products(fitting.select("v"), d, lambda batch: fit.centred(_matrix(batch, d))) / n
    want = min(components, d)
    values, directions = leading_components(covariance, want)
    trace = float(np.trace(covariance))
    varies = values > d * _EPS * max(values[0], 0.0) if trace > 0 else np.zeros(want, bool)
    scaled = directions[varies].T / np.sqrt(values[varies])

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        return fit.centred(_matrix(batch, d)) @ scaled

    # The projection of centred rows is centred as well.
    error = None
    if varies.any():
        seen = _products(fitting.select("v"), int(varies.sum()), projected) / n
        error = float(np.abs(seen - np.eye(len(seen))).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                white = np.full((part.num_rows, want), np.nan)
                white[:, varies] = projected(part)
                told = fit.deviations(_matrix(part, d))
                again = pa.array(np.repeat(np.arange(part.num_rows), want))
                count = part.num_rows
                yield pa.record_batch(
                    [
                        part.column("id").take(again),
                        pa.array(np.tile(np.arange(1, want + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * want, n, np.int64)),
                        pa.array(told, pa.int64()).take(again),
                        pa.array(white.ravel(), mask=np.tile(~varies, count)),
                        pa.array(np.tile(values / trace, count) if trace > 0 else [None] * (count * want), pa.float64()),
                        pa.array([error] * (count * want), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return fitting.mapInArrow(work, schema)
