"""Embedding whitening: distributed centred covariance, eigenvectors by tridiagonalisation, broadcast projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 61)  # of SCALE times an entry: beyond it x, or the distance of two, may be no 64-bit number
CLUSTER = 1e-3            # eigenvalues closer than this share of the norm are orthogonalised against each other
_EPS = float(np.finfo(float).eps)


# --- eigenvectors of a symmetric matrix; its side is the vectors' length, whatever the number of rows ---

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): Householder reflections take the matrix to three diagonals. Reflector k
    is a unit vector over the rows from k + 1 on, empty where nothing was to be reflected."""
    a = np.array(matrix, float)
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        length = float(np.linalg.norm(x))
        if length == 0 or not np.any(x[1:]):
            reflectors.append(np.zeros(0))
            continue
        x[0] += np.copysign(length, x[0])
        v = x / np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = 2 * (rest @ v)
        p -= (p @ v) * v
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each number of ``at``: negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny ** 0.5
    squares = np.concatenate([[0.0], off * off])
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for d, square in zip(diagonal, squares):
        q = d - at - square / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    low = np.full(k, float((diagonal - reach).min()))
    high = np.full(k, float((diagonal + reach).max()))
    edge = max(abs(low[0]), abs(high[0])) * 2 * _EPS
    low, high = low - edge, high + edge
    rank = n - np.arange(1, k + 1)  # eigenvalue i (from 1, falling) has so many below it
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        below = sturm_count(diagonal, off, middle) > rank
        high, low = np.where(open_ & below, middle, high), np.where(open_ & ~below, middle, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, smallest: float) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; vanishing pivots become ``smallest``."""
    n = len(diagonal)
    u0, u1, u2, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        under = off[i]
        if abs(under) > abs(u0[i]):  # the next row goes up
            factor = u0[i] / under
            u0[i], u1[i], u2[i], u0[i + 1], u1[i + 1] = under, u0[i + 1], u1[i + 1], u1[i] - factor * u0[i + 1], -factor * u1[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(u0[i]) < smallest:
                u0[i] = smallest
            factor = under / u0[i]
            u0[i + 1] -= factor * u1[i]
            x[i + 1] -= factor * x[i]
    if abs(u0[-1]) < smallest:
        u0[-1] = smallest
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= u1[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= u2[i] * x[i + 2]
        x[i] /= u0[i]
        largest = abs(x[i])
        if largest > 1e200:  # the right side is scaled along
            x /= largest
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values``. Those of a cluster are made orthogonal to its earlier ones in
    every step, and equal values are moved apart by a rounding's width."""
    n = len(diagonal)
    norm = float(np.max(np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off)))) or 1.0
    rng = np.random.default_rng(64)
    out = np.zeros((n, len(values)))
    start, last = 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            start = i
        shift = min(float(value), last - 10 * _EPS * norm) if i > start else float(value)
        last = shift
        x = rng.uniform(-1, 1, n)
        for _ in range(6):
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x), _EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                for j in range(start, i):
                    x -= (out[:, j] @ x) * out[:, j]
        out[:, i] = x / np.linalg.norm(x)
    return out


def leading_eigenvectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the ``k`` largest eigenvalues of a symmetric matrix."""
    n = len(matrix)
    if not n or not k:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        if len(reflectors[i]):
            part = vectors[i + 1:]
            part -= 2 * np.outer(reflectors[i], reflectors[i] @ part)
    return values, vectors / np.linalg.norm(vectors, axis=0)


# --- the vectors, in Spark ---

def valid(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE > LARGEST)
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .filter((F.size("embedding") > 0) & ~F.exists("embedding", bad)))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """x of a batch, less SHIFT: rows of exact 64-bit numbers."""
    return np.floor(column.flatten().to_numpy().reshape(len(column), dims) * SCALE).astype(np.int64)


def _column(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, np.ascontiguousarray(values).ravel())


def sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number, exact sum of each dimension of x): every task sends one row per dimension; high and low halves are
    summed apart, so nothing overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * dims, pa.int64())],
                                             names=["i", "high", "low", "n"])

    got = rows.mapInArrow(run, "i int, high long, low long, n long").groupBy("i").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]).orderBy("i").collect()
    if not got:
        return 0, [0] * dims
    n = int(got[0]["n"])
    return n, [(int(r["high"]) << 32) + int(r["low"]) + n * SHIFT for r in got]


def covariance(rows: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray], dims: int, n: int) -> np.ndarray:
    """The covariance (divisor ``n``) of what ``centred`` makes of each batch: numbers whose mean is 0 but for rounding,
    which is taken off again. Every task sends its sums of products as one row per dimension; tasks that own a
    dimension add them up as they stream in, so the driver gets one matrix."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            c = centred(batch)
            total, square = total + c.sum(axis=0), square + c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total), _column(square)], names=["i", "total", "products"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = np.column_stack([batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, dims)])
            for i, row in zip(batch.column(0).to_pylist(), flat):
                held[i] = held[i] + row if i in held else row
        if held:
            made = np.stack(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(made[:, 0].copy()), _column(made[:, 1:])],
                                             names=["i", "total", "products"])

    schema = "i int, total double, products array<double>"
    got = rows.mapInArrow(products, schema).repartition("i").mapInArrow(merged, schema).orderBy("i").collect()
    if not got:
        return np.zeros((dims, dims))
    mean = np.array([r["total"] for r in got]) / n
    v = np.array([r["products"] for r in got]) / n - np.outer(mean, mean)
    return (v + v.T) / 2


@dataclass
class Whitening:
    """The fitted projection; its size depends on the vectors' length only."""

    dims: int
    n: int
    sums: list[int]        # S
    whole: np.ndarray      # S // n less SHIFT
    rest: np.ndarray       # S - n * (S // n)
    values: np.ndarray     # eigenvalues, falling
    components: np.ndarray # unit columns
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts first, so that only the last difference is rounded."""
        return (x - self.whole).astype(float) - self.rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None where no 64-bit number holds it."""
        apart = x - self.whole
        bound = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if self.dims * bound * bound < 1 << 63:
            y = self.n * apart - self.rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in apart]
        return [e if e < 1 << 63 else None for e in exact]


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(the rows that take part, the whitening fitted on all of them; None where there are none).

    Left out: vectors that are null, empty, or hold null, non-finite or too large entries (64 times
    which is beyond 2^61). Vectors of another length than most (of equally many, the longer) are left out too. Components
    whose eigenvalue is 0 but for rounding are not made: they cannot be whitened. Null and repeated ids, and repeated
    vectors, take part as they are."""
    rows = valid(rows)
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).limit(1).collect()
    if not lengths:
        return rows, None
    dims = lengths[0]["dims"]
    rows = rows.filter(F.size("embedding") == dims)
    n, total = sums(rows, dims)
    made = Whitening(dims, n, total, np.array([s // n - SHIFT for s in total], np.int64), np.array([s % n for s in total], float),
                     np.zeros(0), np.zeros((dims, 0)), 0.0)
    v = covariance(rows, lambda batch: made.centred(_matrix(batch.column(1), dims)), dims, n)
    values, vectors = leading_eigenvectors(v, min(components, dims))
    keep = int((values > dims * _EPS * max(float(values[0]), 0.0)).sum()) if len(values) else 0
    made.values, made.components, made.trace = values[:keep], vectors[:, :keep], float(np.trace(v))
    return rows, made


def identity_error(rows: DataFrame, made: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over all rows."""
    k = len(made.values)
    v = covariance(rows, lambda batch: made.project(_matrix(batch.column(1), made.dims)), k, made.n)
    return float(np.abs(v - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector of ``rows`` (vec_id, embedding) that takes part (see ``fit``) and component: vec_id, component
    (from 1), n, deviation (null beyond 64 bits), whitened, explained, identity_error. The fit is made when this is
    called, over all vectors; the projection, a bounded matrix, goes along with the tasks. Other columns are not read.
    An empty table, and one whose vectors are all equal, gives no rows."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, made = fit(rows, components)
    if made is None or not len(made.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, made)
    k = len(made.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x, m = _matrix(batch.column(1), made.dims), batch.num_rows
                times = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, made.n, np.int64)), pa.array(made.deviations(x), pa.int64()).take(pa.array(times)),
                     pa.array(made.project(x).ravel()), pa.array(np.tile(made.values / made.trace, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
