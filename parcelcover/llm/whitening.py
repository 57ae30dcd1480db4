"""Whitening of vectors by pivoted Cholesky and one-sided Jacobi.

Sums and the scatter come from exact integer sums over all rows, taken by tasks and added by Spark, so they don't depend
on order or partitions. The scatter, d x d numbers, is factored on the driver: pivoted Cholesky gives a triangular factor,
whose columns Jacobi rotations make orthogonal. Their squared norms are the eigenvalues, their directions the components.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: an entry c becomes floor(SCALE * c) + SHIFT. Components at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Integers up to this are exact in doubles, so their products can be summed by fast matrix products.
EXACT = 2.0**53
#: Pivots below this share of the largest variance end the factor: the rest is rounding.
RANK = 1e-13


def usable(vector) -> F.Column:
    """Rows whose vector has only finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def _integers(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Rows of x - SHIFT, as whole numbers in doubles; exact up to 2^53."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    z = np.floor(SCALE * flat)
    if len(z) and np.abs(z).max() >= EXACT:
        raise ValueError(f"an entry beyond 2^53 / {SCALE} has no exact place among whole numbers")
    return z.reshape(-1, d)


def _products(z: np.ndarray) -> np.ndarray:
    """z' z of whole numbers, exact: by doubles where no sum can pass 2^53, else by Python's integers."""
    top = np.abs(z).max(initial=0.0)
    if top * top * len(z) < EXACT:
        return (z.T @ z).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in z], object)
    return whole.T @ whole


def _halves(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Integers of any size as upper and lower parts whose sums stay in 64 bits."""
    whole = [int(v) for v in values.ravel()]
    return [v >> 40 for v in whole], [v & (1 << 40) - 1 for v in whole]


def _summed(vectors: DataFrame, d: int, of, size: int) -> list[int]:
    """Exact sums over all rows of size integers that of(rows) gives for a batch: one sum for each task goes through
    the shuffle, and size numbers come to the driver."""

    def run(batches):
        total: np.ndarray | int = 0
        for x in batches:
            if x.num_rows:
                total = total + of(_integers(x.column("v"), d)).astype(object).ravel()
        if isinstance(total, np.ndarray):
            upper, lower = _halves(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(upper, pa.int64()), pa.array(lower, pa.int64())], names=["at", "upper", "lower"])

    out = [0] * size
    for r in vectors.select("v").mapInArrow(run, "at long, upper long, lower long").groupBy("at").agg(F.sum("upper").alias("u"), F.sum("lower").alias("l")).collect():
        out[r["at"]] = (r["u"] << 40) + r["l"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """F with F F' = a for a symmetric, positive semidefinite a: the columns of the pivoted factor, rows in a's order, as
    many as the rank."""
    d = len(a)
    rest, rows = np.diag(a).copy(), np.zeros((0, d))
    top = rest.max(initial=0.0)
    while len(rows) < d:
        p = int(np.argmax(rest))
        if not rest[p] > RANK * top:
            break
        row = (a[p] - rows[:, p] @ rows) / np.sqrt(rest[p])
        row[rest == 0] = 0  # earlier pivots
        row[p] = np.sqrt(rest[p])
        rows = np.vstack([rows, row])
        rest = np.maximum(rest - row * row, 0)
        rest[p] = 0
    return rows.T


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as rows) of factor factor', by rotating pairs of columns until all are
    orthogonal. A sweep meets every pair once, in rounds of pairs that share no column, each round at one go."""
    g = np.array(factor, float, order="F")
    d, k = g.shape
    if k % 2:
        g = np.hstack([g, np.zeros((d, 1))])
    n = g.shape[1]
    for _ in range(sweeps):
        worst, ring = 0.0, list(range(1, n))
        for _ in range(max(n - 1, 0)):
            order = np.array([0, *ring])
            p, q = order[: n // 2], order[: n // 2 - 1 : -1]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = np.where(turn, 1 / np.hypot(1, t), 1.0)
            sin = np.where(turn, cos * t, 0.0)
            g[:, p], g[:, q] = cos * g[:, p] - sin * g[:, q], sin * g[:, p] + cos * g[:, q]
            ring = ring[-1:] + ring[:-1]
        if worst < 1e-15 * max(d, 10):
            break
    else:
        raise ArithmeticError(f"rotations did not end in {sweeps} sweeps")
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], (g[:, order] / np.sqrt(values[order])).T


class Fit:
    """n, sums of x, eigenvalues, components and trace of all usable vectors."""

    def __init__(self, n: int, sums: list[int], scatter: list[int], centre: list[int]):
        """scatter: of x - centre, a whole number near each mean; its own mean is taken off exactly."""
        d = len(sums)
        self.n, self.sums = n, sums
        off = [s - n * m for s, m in zip(sums, centre, strict=True)]
        v = np.array([[float(Fraction(n * scatter[i * d + j] - off[i] * off[j], n * n)) for j in range(d)] for i in range(d)])
        self.values, self.components = jacobi(pivoted_cholesky(v.reshape(d, d)))
        self.trace = float(sum((Fraction(n * scatter[i * d + i] - off[i] ** 2, n * n) for i in range(d)), Fraction(0)))


def _centred(z: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, whole numbers: 64-bit ones where they fit."""
    low = [s - n * SHIFT for s in sums]
    top = int(np.abs(z).max(initial=0.0)) * n + max(map(abs, low), default=0)
    if top < 1 << 62:
        return z.astype(np.int64) * n - np.array(low, np.int64)
    return np.array([[int(v) * n - s for v, s in zip(row, low, strict=True)] for row in z], object).reshape(z.shape)


def _squares(y: np.ndarray) -> pa.Array:
    """Exact sums of squares of each row."""
    if y.dtype == np.int64 and float(np.abs(y).max(initial=0)) ** 2 * max(y.shape[1], 1) < 2.0**62:
        return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in y], pa.decimal128(38, 0))


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of every usable row and its components.

    Rows whose vector is null or holds nulls or numbers that aren't finite are left out; repeated keys and rows stay.
    All vectors must have one length, else it's an error, as are entries beyond 2^53 / 64. Components whose variance is
    zero, but for rounding, aren't given: equal vectors, a single one, empty ones and an empty table give no rows.
    deviation is decimal(38, 0), as it grows with the square of n. Other columns are left aside.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(usable(F.col("v")))
    schema = f"`{key}` {dict(df.dtypes)[key]}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, d, longest = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or not longest:
        return df.sparkSession.createDataFrame([], schema)
    if d != longest:
        raise ValueError(f"vectors have {d} to {longest} entries")
    sums = [s + n * SHIFT for s in _summed(rows, d, lambda z: np.array([sum(map(int, c)) for c in z.T], object) if np.abs(z).max(initial=0.0) * len(z) >= EXACT else z.sum(0).astype(np.int64), d)]
    centre = [s // n for s in sums]
    near = np.array([m - SHIFT for m in centre], float)
    fit = Fit(n, sums, _summed(rows, d, lambda z: _products(z - near), d * d), centre)
    k = min(components, len(fit.values))
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    axes, explained = (fit.components[:k] / np.sqrt(fit.values[:k])[:, None]).T, fit.values[:k] / fit.trace

    def project(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = _centred(z, n, sums)
        return y, (y.astype(float) / n) @ axes

    def moments(batches):
        total = np.zeros((k + 1, k))
        for x in batches:
            _, w = project(_integers(x.column("v"), d))
            total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    got = np.zeros((k + 1, k)).ravel()
    for r in rows.select("v").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        got[r["at"]] = r["value"] / n
    mean, second = got[:k], got[k:].reshape(k, k)
    # Whitened rows are centred already; what rounding leaves of their mean is taken off.
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches):
        for x in batches:
            y, w = project(_integers(x.column("v"), d))
            m, at = len(w), np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    x.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), _squares(y).take(pa.array(at)), pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
