"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors become integer vectors x = floor(scale * c), so counts and sums are exact.  The fit list holds each distinct
integer vector once; it is written to the shared folder and read by three aggregations, each of which leaves its
tasks as a few rows: number and sums, then the scatter about the mean (centred before multiplying), and at the end
mean and covariance of the whitened list.  No task holds more than a batch of vectors and one square matrix.

The scatter matrix, whose size depends on the dimension alone, is factored on the driver: Cholesky with diagonal
pivoting gives P V P' = L L', one-sided Jacobi turns pairs of columns of L until all are at right angles.  The
columns' norms are then the roots of the eigenvalues, the columns divided by them the components.  L L' is never
multiplied out, so small eigenvalues keep their digits.  The sign makes the largest entry (the first of equal
ones) positive.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are left out, and so are rows of another
length than the most frequent one (of equally frequent ones the longest); copies, also a third of all rows, are one
row of the fit list and each keep their results; a null id is kept, equal ids are kept each; scaled entries
beyond 2**61 stop there; a vector shorter than the number of components asked for has as
many components as entries; a component without variance has a null ``whitened`` and 0 as ``explained`` (null if no
component has any) and is no part of ``identity_error``, which is null if none is left; ``deviation`` is null where it
passes 64 bits, ``deviation_text`` holds its digits always; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import common

# Fixed values of the query.
SCALE, COMPONENTS = 256, 4
SWEEPS = 60  # Jacobi converges in about ten; beyond this bound it is an error
EPS = float(np.finfo(float).eps)


# --- factoring a matrix ------------------------------------------------------------------------


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (d x rank, lower trapezoidal) and the order of rows with v[order][:, order] = L L'."""
    a = np.array(v, float)
    d = len(a)
    order = np.arange(d)
    factor = np.zeros((d, d))
    left = np.diag(a).copy()
    least = d * EPS * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return factor[:, :k], order
        if p != k:
            a[[k, p]], factor[[k, p]] = a[[p, k]], factor[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            order[[k, p]], left[[k, p]] = order[[p, k]], left[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0 .. n - 1 in rounds of disjoint pairs, as in a tournament."""
    seats = [*range(n), *([-1] if n % 2 else [])]
    out = []
    for _ in range(max(len(seats) - 1, 0)):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if min(a, b) >= 0]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns turned in pairs until all pairs are at right angles to working precision."""
    u = np.array(factor, float)
    u = u[:, np.argsort(-(u * u).sum(axis=0), kind="stable")]
    schedule = [r for r in rounds(u.shape[1]) if len(r[0])]
    for _ in range(SWEEPS):
        turned = False
        for i, j in schedule:
            x, y = u[:, i], u[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(c) > 4 * EPS * np.sqrt(a * b)
            if not off.any():
                continue
            turned = True
            zeta = (b - a) / np.where(off, 2 * c, 1.0)
            t = np.where(off, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            u[:, i], u[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
        if not turned:
            return u
    raise ArithmeticError("Jacobi turns did not end")


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and the unit components as rows; only those with variance."""
    factor, order = pivoted_cholesky(v)
    u = jacobi(factor)
    norms = np.sqrt((u * u).sum(axis=0))
    by_size = np.argsort(-norms, kind="stable")
    norms, u = norms[by_size], u[:, by_size]
    keep = norms > 0
    components = np.zeros((int(keep.sum()), len(v)))
    components[:, order] = (u[:, keep] / norms[keep]).T
    largest = np.abs(components).argmax(axis=1)
    components *= np.sign(components[np.arange(len(components)), largest])[:, None]
    return norms[keep] ** 2, components


# --- aggregations --------------------------------------------------------------------------------


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, x: the usable rows with their integer vectors."""
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("_c"))
    bad = F.exists("_c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("_c").isNotNull() & (F.size("_c") > 0) & ~F.coalesce(bad, F.lit(True)))
    bound = float(1 << 61)

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c * scale, F.lit(bound)), F.lit(-bound))).cast("long")

    return rows.select("vec_id", F.transform("_c", whole).alias("x"))


def _sums(d: int):
    """Per task: number of vectors and the sums of their entries, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * d, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            # In halves of 32 bits no sum over a batch passes 64 bits.
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist(), strict=True)]
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.record_batch([[n], [[str((a << 32) + b) for a, b in zip(high, low, strict=True)]]], names=["n", "s"])

    return run


def _scatter(d: int, value: Callable[[np.ndarray], np.ndarray]):
    """Per task: one row (i, products) for each row i of the sum of outer products of ``value(x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = value(_matrix(batch.column("x"), d))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def scatter(fit: DataFrame, d: int, value: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of outer products over the fit list; what comes back has the size of the matrix."""
    parts = fit.select("x").mapInArrow(_scatter(d, value), "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((width, width))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row.i, row.j] = row.v
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What is fitted: number and sums of the fit list, mean, eigenvalues, components, trace."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once per entry: the whole part is taken off as an integer."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole).astype(float) - rest

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        kept = min(k, len(self.values))
        return self.centred(x) @ self.components[:kept].T / np.sqrt(self.values[:kept])


def fit(vectors: DataFrame) -> tuple[DataFrame, Whitening] | None:
    """The fit list (x, distinct) in the shared folder, and what is fitted on it; None without vectors."""
    listed = common.staged(vectors.select("x").distinct(), "whitening-fit")
    d = len(listed.first().x) if not listed.isEmpty() else 0
    if not d:
        return None
    # One row per task, added up as texts of whole numbers: at most 10**10 tasks of 2**62 fit 38 digits.
    parts = listed.mapInArrow(_sums(d), "n long, s array<string>").select("n", F.posexplode("s").alias("i", "s"))
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    n, sums = rows[0].n, [int(r.s) for r in sorted(rows, key=lambda r: r.i)]
    plain = Whitening(n, sums, np.array([s / n for s in sums]), np.zeros(0), np.zeros((0, d)), 0.0)
    v = scatter(listed, d, plain.centred, d) / n
    values, components = principal(v)
    return listed, Whitening(n, sums, plain.mean, values, components, float(np.trace(v)))


def identity_error(listed: DataFrame, w: Whitening, k: int) -> float | None:
    """Largest absolute entry of the whitened list's covariance minus the identity."""
    kept = min(k, len(w.values))
    if not kept:
        return None
    d = len(w.sums)
    with_one = lambda x: np.column_stack([w.project(x, k), np.ones(len(x))])
    mean = scatter(listed, d, with_one, kept + 1)[kept, :kept] / w.n
    cov = scatter(listed, d, lambda x: w.project(x, k) - mean, kept) / w.n
    return float(np.abs(cov - np.eye(kept)).max())


def _apply(w: Whitening, k: int, error: float | None):
    """Rows with their components."""
    d = len(w.sums)
    some = min(k, d)
    kept = min(some, len(w.values))
    explained = [float(e / w.trace) for e in w.values[:kept]] + [0.0 if w.trace > 0 else None] * (some - kept)
    reach = max((abs(s) for s in w.sums), default=0)

    def deviations(x: np.ndarray) -> list[int]:
        furthest = w.n * max(abs(int(x.min())), abs(int(x.max()))) + reach
        if d * furthest * furthest < 1 << 63:
            return ((w.n * x - np.array(w.sums)) ** 2).sum(axis=1).tolist()
        return [sum((w.n * c - s) ** 2 for c, s in zip(row, w.sums, strict=True)) for row in x.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), d)
            rows, dev = len(x), deviations(x)
            white = np.full((rows, some), np.nan)
            white[:, :kept] = w.project(x, some)
            exact = pa.array([v if v < 1 << 63 else None for v in dev], pa.int64())
            text = pa.array([str(v) for v in dev])
            again = pa.array(np.repeat(np.arange(rows), some))
            missing = np.tile(np.arange(some) >= kept, rows)
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), rows)), pa.array(np.full(rows * some, w.n)), exact.take(again),
                    pa.array(white.ravel(), mask=missing), pa.array(explained * rows, pa.float64()), pa.array([error] * (rows * some), pa.float64()), text.take(again),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"],
            )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text."""
    rows = integers(vectors, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths.d)
    listed, w = fit(rows)
    return rows.mapInArrow(_apply(w, components, identity_error(listed, w, components)), schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(common.documents(spark, sf_dir, "embeddings"))
