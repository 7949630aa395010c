"""Embedding whitening by spectral divide and conquer.

Entries become whole numbers, so sums are exact.  The distinct vectors give sums
and then a centred covariance, each added up per task and across tasks.  The
covariance alone, dimension by dimension, reaches the driver.  There QDWH polar
decompositions of the shifted covariance give projectors onto the eigenvalues
above and below the shift; both invariant subspaces are split again until single
components are left.  Rows are whitened where they lie by the broadcast
components.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000  # entry c becomes floor(SCALE * c) + SHIFT
LARGEST = float(1 << 52)  # beyond it, SCALE * c counts as this
SHIFTS = 6  # places tried for a split before the best is taken
_EPS = float(np.finfo(float).eps)
_LONG = 1 << 63


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal factor of the polar decomposition of a symmetric matrix, by QDWH iteration.

    Every step is a weighted Halley step whose weights follow from a lower bound
    of the singular values; it takes a QR factorisation and no inverse.
    """
    n = len(a)
    x, least = a / np.linalg.norm(a), _EPS
    for _ in range(30):
        square = least * least
        root = (4 * (1 - square) / (square * square)) ** (1 / 3)
        weight = np.sqrt(1 + root)
        p = weight + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * weight), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))[0]
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        least = min(least * (p + q * square) / (1 + r * square), 1.0)
        if 1 - least < 4 * _EPS and moved < _EPS ** (1 / 3):
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Orthonormal bases of the subspaces above and below `shift`, and what still couples them."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(2):
        basis = np.linalg.qr(projector @ basis)[0]
    above, below = np.split(np.linalg.qr(basis, mode="complete")[0], [k], axis=1)
    return above, below, float(np.linalg.norm(below.T @ a @ above))


def leading(a: np.ndarray, wanted: int) -> np.ndarray:
    """Eigenvectors of the `wanted` largest eigenvalues of a symmetric matrix, as columns."""
    n, size = len(a), float(np.linalg.norm(a))
    mean = float(np.trace(a)) / n
    if n == 1 or wanted == 0 or float(np.linalg.norm(a - mean * np.eye(n))) <= n * _EPS * size:
        return np.eye(n)[:, :wanted]
    # The mean lies between the least and the largest eigenvalue; a shift that
    # meets an eigenvalue leaves the parts coupled and gives way to another.
    middle, step = float(np.median(np.diag(a))), float(np.ptp(np.diag(a))) / 16
    best = None
    for i, shift in enumerate([middle, mean, *(mean + s * step for s in (1, -1, 2, -2))][:SHIFTS]):
        found = split(a, shift)
        if found is not None and (best is None or found[2] < best[2]):
            best = found
        if best is not None and best[2] <= n * _EPS * size:
            break
    if best is None:  # equal eigenvalues to working precision
        return np.eye(n)[:, :wanted]
    above, below, _ = best
    inside = [(q, q.T @ a @ q) for q in (above, below)]
    first, rest = min(wanted, above.shape[1]), max(0, wanted - above.shape[1])
    return np.hstack([q @ leading((b + b.T) / 2, m) for (q, b), m in zip(inside, (first, rest)) if m])


def components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the largest `wanted`."""
    vectors = leading(covariance, min(wanted, len(covariance)))
    values = np.einsum("ij,ik,kj->j", vectors, covariance, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    n: int  # vectors of the fit list
    sums: tuple[int, ...]  # of each dimension over the fit list
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def base(self) -> np.ndarray:
        """Whole numbers close to the means; differences to them are exact."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the means have beyond `base`, times n: whole numbers from 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)

    @property
    def rates(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); 0 for a component without variance."""
        real = self.values > len(self.sums) * _EPS * max(self.trace, 1e-300)
        return np.where(real, 1 / np.sqrt(np.where(real, self.values, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) * self.rates

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2; None beyond a long."""
        y = x - self.base
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if len(self.sums) * most * most < _LONG:
            t = self.n * y - self.rest
            return (t * t).sum(1).tolist()
        t = self.n * y.astype(object) - self.rest.astype(object)
        return [int(s) if s < _LONG else None for s in (t * t).sum(1).tolist()]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(`id`, `x`) of the usable rows with their entries as whole numbers, and the dimension.

    Left out are null vectors, those with a null or non-finite entry, and those of
    another length than most have.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(v.isNotNull())
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = usual[0].n if usual else 0

    def whole(c: Column) -> Column:
        scaled = F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(scaled).cast("bigint") + F.lit(SHIFT).cast("bigint")

    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where((F.size(v) == dimension) & finite).select("id", F.transform(v, whole).alias("x")), dimension


def exact_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the exact sum of each dimension of `x`."""

    def add(batches):
        n, sums = 0, None
        for batch in filter(len, batches):
            x = _matrix(batch.column(0))
            n += len(x)
            # Slices of 512 rows of up to 2^53 stay within a long.
            parts = [x[i : i + 512].sum(0).astype(object) for i in range(0, len(x), 512)]
            sums = sum(parts, 0 if sums is None else sums)
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([Decimal(int(s)) for s in sums], kind), pa.array([n] * len(sums), pa.int64())], names=["dim", "total", "n"])

    found = rows.select("x").mapInArrow(add, "dim int, total decimal(38,0), n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r.dim)  # one row per dimension
    return (found[0].n if found else 0), tuple(int(r.total) for r in found)


def mean_products(rows: DataFrame, n: int, size: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the rows of the products of each two entries of `centred(x)`, over n."""

    def multiply(batches):
        sums = np.zeros((size, size))
        for batch in filter(len, batches):
            z = centred(_matrix(batch.column(0)))
            sums += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], names=["i", "j", "s"])

    out = np.zeros((size, size))
    for r in rows.select("x").mapInArrow(multiply, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def fit(rows: DataFrame, dimension: int, wanted: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors `x` of `rows`; None without a vector.

    Copies of a vector are merged before the shuffle, however many there are.
    """
    distinct = stored(rows.select("x").distinct())
    n, sums = exact_sums(distinct)
    if not n or not dimension:
        return None
    bare = Whitening(n, sums, np.zeros(0), np.zeros((dimension, 0)), 0.0)
    covariance = mean_products(distinct, n, dimension, bare.centred)
    values, vectors = components(covariance, wanted)
    made = Whitening(n, sums, values, vectors, float(np.trace(covariance)))
    # Whitened rows are centred already, as the means are subtracted from x.
    spread = mean_products(distinct, n, len(values), made.whitened)
    error = np.abs(spread - np.diag((made.rates > 0).astype(float))).max(initial=0.0)
    return Whitening(n, sums, values, vectors, made.trace, float(error))


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row and component: `vec_id`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Repeated rows are answered each and fitted once; ids may be null.  A component
    without variance (few or equal vectors) gives 0 and counts as expected in
    `identity_error`.  Equal eigenvalues get some orthonormal basis of their
    space.  A deviation beyond a long is null.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, dimension = whole_numbers(vectors, id_col, vector_col)
    model = fit(rows, dimension, wanted)
    schema = T.StructType([
        T.StructField("vec_id", rows.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ])
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def project(batches):
        model = shared.value
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for batch in filter(len, batches):
            x = _matrix(batch.column("x"))
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(project, schema)
