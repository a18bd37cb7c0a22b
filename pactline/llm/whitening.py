"""Embedding whitening (operator 11).

1. Entries become integers. One pass counts the vectors and sums each dimension; sums are integers, hence exact.
2. A second pass centres each entry by the whole part of its mean and sums the products of every two dimensions. Tasks send
   one number a pair of dimensions; the rest of the mean is taken off in whole numbers too, so every entry of the covariance
   is rounded once and the result doesn't depend on the order of tasks.
3. The covariance, of the dimensions squared and nothing larger, meets on the driver: Householder reflections make it
   tridiagonal, bisection by Sturm counts finds the leading eigenvalues, and inverse iteration, orthogonalised inside clusters
   of close eigenvalues, the components.
4. The components are broadcast; a third pass measures the covariance of what comes out, a fourth returns it.

Memory: a batch of vectors, and dimensions squared numbers a task. The table itself is never moved.

Defined results: vectors that are null or hold a null, NaN or infinite entry have no rows; entries that a shorter vector lacks
count as 0.0; rows of null or repeated id are rows like others; components whose eigenvalue is not above 1e-11 of the largest
(all, if no entry varies) can't be scaled and are left out; an empty table gives none. An entry beyond 2^62 / 1024 or a
deviation beyond 64 bits raises an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues up to this share of the largest can't be told from zero to four digits.
LEAST_SHARE = 1e-11
#: Eigenvalues closer than this share of the largest are a cluster.
CLUSTER = 1e-3


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    if (length == dims).all():
        raw = values.reshape(len(length), dims)
    else:
        raw = np.zeros((len(length), dims))
        raw[np.arange(dims) < length[:, None]] = values
    scaled = np.floor(SCALE * raw)
    if np.abs(scaled).max(initial=0) >= 1 << 62:
        raise OverflowError("an entry is beyond 64 bits")
    return scaled.astype(np.int64) + SHIFT


def _exact(numbers: np.ndarray) -> list[str]:
    return [str(int(x)) for x in numbers]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension the sum and count of the entries; dimension -1 counts the vectors."""
    n, total, count = 0, np.zeros(0, object), np.zeros(0, np.int64)
    for batch in batches:
        column = batch.column("vector")
        if not len(column):
            continue
        length = np.diff(column.offsets.to_numpy())
        dims = int(length.max(initial=0))
        if dims > len(total):
            more = dims - len(total)
            total, count = np.append(total, np.zeros(more, object)), np.append(count, np.zeros(more, np.int64))
        x = _integers(column, dims)
        x[np.arange(dims) >= length[:, None]] = 0
        safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
        total[:dims] += (x if safe else x.astype(object)).sum(axis=0)
        count[:dims] += (np.arange(dims) < length[:, None]).sum(axis=0)
        n += len(x)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *range(len(total))], pa.int32()), pa.array(["0", *_exact(total)], pa.string()), pa.array([n, *count.tolist()], pa.int64())],
        names=["dim", "total", "count"],
    )


@dataclass(frozen=True)
class Centre:
    """Number of vectors, and each dimension's mean as a whole part and a rest in n-ths."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, column: pa.Array) -> np.ndarray:
        return _integers(column, len(self.whole)) - self.whole


def centre(vectors: DataFrame) -> Centre:
    rows = vectors.select("vector").mapInArrow(_sums, "dim int, total string, count long").groupBy("dim")
    rows = rows.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count")).collect()
    n = max((r["count"] for r in rows if r["dim"] < 0), default=0)
    sums = [int(r["total"]) + SHIFT * (n - r["count"]) for r in sorted(rows, key=lambda r: r["dim"]) if r["dim"] >= 0]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def covariance(vectors: DataFrame, middle: Centre) -> np.ndarray:
    """Of the integers, divisor n."""
    n, dims = middle.n, len(middle.whole)
    upper = np.triu_indices(dims)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((dims, dims), np.int64), 0

        def sent() -> pa.RecordBatch:
            columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(_exact(total[upper]), pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["i", "j", "total"])

        for batch in batches:
            y = middle.centred(batch.column("vector"))
            most = len(y) * int(np.abs(y).max(initial=0)) ** 2
            if held + most >= 1 << 62:
                yield sent()
                total, held = np.zeros((dims, dims), object if most >= 1 << 62 else np.int64), 0
            if most < 1 << 53:  # all partial sums are whole numbers that a double holds
                z = y.astype(np.float64)
                total += (z.T @ z).astype(np.int64)
            else:
                z = y.astype(object)
                total = total + z.T @ z
            held += most
        yield sent()

    rows = vectors.select("vector").mapInArrow(products, "i int, j int, total string").groupBy("i", "j")
    found = np.zeros((dims, dims))
    for i, j, total in rows.agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        found[i, j] = found[j, i] = (n * int(total) - int(middle.rest[i]) * int(middle.rest[j])) / n**2
    return found


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a, reflectors = matrix.astype(np.float64, copy=True), []
    off = np.zeros(max(len(a) - 1, 0))
    for k in range(len(a) - 1):
        v = a[k + 1 :, k].copy()
        off[k] = v[0]
        size = np.sqrt(v @ v)
        if k < len(a) - 2 and np.abs(v[1:]).max() > 0:
            off[k] = -size if v[0] > 0 else size
            v[0] -= off[k]
            v /= np.sqrt(v @ v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            q = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, q) + np.outer(q, v)
        else:
            v[:] = 0
        reflectors.append(v)
    return np.diag(a).copy(), off, reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each of `at`."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < tiny, np.where(q < 0, -tiny, tiny), q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    high += np.abs(high) * 1e-12 + np.finfo(float).tiny
    rank = len(diagonal) - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = below(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; pivots of zero become `least`."""
    n = len(diagonal)
    main, first, second, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    lower = off.tolist()
    for i in range(n - 1):
        if abs(main[i]) >= abs(lower[i]):
            pivot = main[i] = main[i] if abs(main[i]) > least else least
            factor = lower[i] / pivot
            main[i + 1] -= factor * first[i]
        else:
            factor = main[i] / lower[i]
            main[i], first[i], main[i + 1] = lower[i], main[i + 1], first[i] - factor * main[i + 1]
            second[i], first[i + 1] = first[i + 1], -factor * first[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        known = (first[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - known) / (main[i] if abs(main[i]) > least else least)
    return np.array(x)


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    size = float(np.abs(matrix).max(initial=0))
    k = min(k, len(matrix))
    if not k or not size:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading(diagonal, off, k)
    most = max(np.abs(values).max(), np.finfo(float).tiny)
    draw, found, start = np.random.default_rng(11), np.zeros((k, len(matrix))), 0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * most:
            start = i
        x = draw.standard_normal(len(matrix))
        for _ in range(6):
            for _ in range(2):  # twice is enough to be orthogonal to the last digits
                x -= found[start:i].T @ (found[start:i] @ x)
            x /= np.sqrt(x @ x)
            x = _solve(diagonal, off, values[i], x, np.finfo(float).eps * most)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= found[start:i].T @ (found[start:i] @ x)
        found[i] = x / np.sqrt(x @ x)
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        found[:, j + 1 :] -= 2 * np.outer(found[:, j + 1 :] @ v, v)
    found /= np.sqrt((found * found).sum(axis=1))[:, None]
    found *= np.where(found[np.arange(k), np.abs(found).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return values * size, found


@dataclass(frozen=True)
class Model:
    """What whitens a vector: the centre, the eigenvalues and components, and the trace of the covariance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Of vectors that are centred by the whole part of the mean."""
        return (y - self.centre.rest / self.centre.n) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, y: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S) squared."""
        n = self.centre.n
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        if len(self.centre.whole) * most**2 < 1 << 63:
            d = n * y - self.centre.rest
            return (d * d).sum(axis=1).tolist()
        d = n * y.astype(object) - self.centre.rest.astype(object)
        found = [int(x) for x in (d * d).sum(axis=1)]
        if max(found, default=0) >= 1 << 63:
            raise OverflowError("a deviation is beyond 64 bits")
        return found


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Model | None:
    """The model of all rows of a table with a column `vector` of finite entries; none without rows."""
    middle = centre(vectors)
    if not middle.n or not len(middle.whole):
        return None
    matrix = covariance(vectors, middle)
    values, found = components(matrix, k)
    kept = values > LEAST_SHARE * max(values.max(initial=0), 0)
    return Model(middle, values[kept], found[kept], float(np.trace(matrix)))


def identity_error(vectors: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, measured over all of them."""
    k = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = model.whitened(model.centre.centred(batch.column("vector")))
            total, first = total + z.T @ z, first + z.sum(axis=0)
        place, value = [*range(k * k + k)], [*total.ravel(), *first]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(value, pa.float64())], names=["i", "total"])

    rows = vectors.select("vector").mapInArrow(products, "i int, total double").groupBy("i").agg(F.sum("total")).collect()
    sums = np.zeros(k * k + k)
    for i, total in rows:
        sums[i] = total / model.centre.n
    mean = sums[k * k :]
    return float(np.abs(sums[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """`id, component, n, deviation, whitened, explained, identity_error` of every finite vector and component."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).alias("id"), vector.alias("vector")).where(finite(F.col("vector")))
    model = fit(rows, k)
    kind = rows.schema["id"].dataType.simpleString()
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame(
            [], f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.centre.centred(batch.column("vector"))
            z = model.whitened(y)
            ends = pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32())
            columns = [batch.column("id"), pa.array(model.deviations(y), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "deviation", "z"])

    share = F.lit([float(x) for x in model.values / model.trace])
    found = rows.mapInArrow(project, f"id {kind}, deviation long, z array<double>").select("id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return found.select(
        "id", (F.col("k") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(identity_error(rows, model)).alias("identity_error"),
    )
