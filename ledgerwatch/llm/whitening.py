"""Embedding whitening: distributed centred covariance, Householder tridiagonalisation, Sturm-count
bisection, inverse iteration with cluster reorthogonalisation, broadcast projection.

Every valid entry c becomes the integer x = floor(scale * c) + offset. The covariance of x is exact:
each task sums n, S and the Gram matrix of y = floor(scale * c) in integers (the offset cancels in
n * G - S S^T), Spark adds the partial sums as decimal(38, 0), and only the d x d matrix reaches the
driver, bounded by the dimension and not by the rows. The eigenproblem of that matrix is solved on the
driver by the named method; components and means go back to the executors as literals of d * k
doubles and every row is projected in the JVM (no Python on the projection path).

Defined cases: rows whose vector is null, holds a null or a non-finite entry are dropped; vectors of
unequal length are padded with zero entries (x = offset) up to the longest; a null vec_id is a row
like any other and keeps its null id; repeated rows count as often as they occur; an empty table (or
one with no valid vector) gives an empty result; other columns of the input are never read, so
clashing names do not matter. A component whose eigenvalue is not above 1e-12 of the trace (n = 1,
equal vectors, fewer independent directions than components) has a null `whitened`; `explained` is
null when the trace is zero; `identity_error` covers the components with a positive eigenvalue and
is null when there are none. At most `components` components are returned, fewer when d is smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import fresh

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Rows of one batch whose Gram matrix numpy forms in int64 when |y| stays below SMALL (exact).
SMALL = 1 << 20


def finite_vector(vector: Column) -> Column:
    """True when the vector is not null and every entry is a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, as long."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))


def _gram(d: int):
    """Per task: (k, v) with k = 0 for n, 1..d for S, d + 1 + i * d + j for G[i, j] of y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, [0] * d, np.zeros((d, d), dtype=object)
        for b in batches:
            if not b.num_rows:
                continue
            y = np.asarray(b.column(0).flatten(), dtype=np.int64).reshape(b.num_rows, d)
            n += b.num_rows
            if np.abs(y).max(initial=0) < SMALL and b.num_rows < SMALL:
                s = [a + int(c) for a, c in zip(s, y.sum(axis=0))]
                g = g + (y.T @ y).astype(object)
            else:  # exact for any long: Python integers
                o = y.astype(object)
                s = [a + c for a, c in zip(s, o.sum(axis=0))]
                g = g + o.T.dot(o)
        if n:
            vals = [n, *s, *g.reshape(-1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(vals)), pa.int32()), pa.array([Decimal(int(v)) for v in vals], pa.decimal128(38, 0))],
                names=["k", "v"])

    return run


def moments(y: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Exact n, S of y and n * G - S S^T (Python integers) from per-task sums added by Spark."""
    parts = y.mapInArrow(_gram(d), "k int, v decimal(38,0)")
    tot = {r["k"]: int(r["v"]) for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    if not tot:
        return 0, [0] * d, np.zeros((d, d), dtype=object)
    n, s = tot[0], [tot[1 + i] for i in range(d)]
    g = np.array([[tot[1 + d + i * d + j] for j in range(d)] for i in range(d)], dtype=object)
    centred = g * n - np.array([[a * b for b in s] for a in s], dtype=object)
    return n, s, centred


# ---------------------------------------------------------------- eigenproblem of one d x d matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a symmetric matrix: diagonal, off-diagonal and the reflectors."""
    a = np.array(a, dtype=float)
    m = len(a)
    reflectors = []
    for k in range(m - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0.0:
            reflectors.append(np.zeros(0))
            continue
        alpha = -norm if x[0] >= 0 else norm
        v = x
        v[0] -= alpha
        vn = np.linalg.norm(v)
        if vn == 0.0:
            reflectors.append(np.zeros(0))
            continue
        v /= vn
        reflectors.append(v)
        sub = a[k + 1:, :]
        sub -= 2.0 * np.outer(v, v @ sub)
        sub = a[:, k + 1:]
        sub -= 2.0 * np.outer(sub @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_count(diag: np.ndarray, off: np.ndarray, x: float) -> int:
    """Number of eigenvalues of the tridiagonal matrix below x."""
    count, q = 0, 1.0
    tiny = np.finfo(float).tiny
    for i in range(len(diag)):
        q = diag[i] - x - (off[i - 1] ** 2 / q if i else 0.0)
        if q == 0.0:
            q = -tiny
        if q < 0:
            count += 1
    return count


def bisect(diag: np.ndarray, off: np.ndarray, index: int) -> float:
    """Eigenvalue number `index` from the bottom (0-based) by Sturm counts."""
    m = len(diag)
    r = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    lo, hi = float(np.min(diag - r)), float(np.max(diag + r))
    span = max(abs(lo), abs(hi), np.finfo(float).tiny)
    lo, hi = lo - 1e-12 * span, hi + 1e-12 * span
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi) or hi - lo <= 2 * np.finfo(float).eps * max(abs(lo), abs(hi)):
            break
        if sturm_count(diag, off, mid) > index:
            hi = mid
        else:
            lo = mid
    return 0.5 * (lo + hi) if m else 0.0


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, rhs: np.ndarray) -> np.ndarray:
    """(T - shift I) x = rhs by Gaussian elimination with partial pivoting on the band."""
    m = len(diag)
    eps = np.finfo(float).eps * max(1.0, float(np.max(np.abs(diag))) + float(np.max(np.abs(off), initial=0.0)))
    # rows as [u0 (diagonal), u1, u2] after pivoting; lower part is one multiplier per row
    u = np.zeros((m, 3))
    u[:, 0] = diag - shift
    if m > 1:
        u[:-1, 1] = off
    lower = np.zeros(m)
    sub = np.concatenate([off, [0.0]])  # entry below the diagonal in column i is off[i]
    perm_swap = np.zeros(m, dtype=bool)
    for i in range(m - 1):
        if abs(sub[i]) > abs(u[i, 0]):  # swap rows i and i + 1
            perm_swap[i] = True
            row_i = u[i].copy()
            u[i, 0], u[i, 1], u[i, 2] = sub[i], diag[i + 1] - shift, (off[i + 1] if i + 1 < m - 1 else 0.0)
            below = row_i  # former row i: [a_ii, a_i,i+1, 0] in columns i, i+1, i+2
            if u[i, 0] == 0.0:
                u[i, 0] = eps
            f = below[0] / u[i, 0]
            lower[i] = f
            u[i + 1, 0] = below[1] - f * u[i, 1]
            u[i + 1, 1] = below[2] - f * u[i, 2]
            u[i + 1, 2] = 0.0
        else:
            if u[i, 0] == 0.0:
                u[i, 0] = eps
            f = sub[i] / u[i, 0]
            lower[i] = f
            u[i + 1, 0] -= f * u[i, 1]
            u[i + 1, 1] -= f * u[i, 2]
    if u[m - 1, 0] == 0.0:
        u[m - 1, 0] = eps
    b = rhs.astype(float).copy()
    for i in range(m - 1):
        if perm_swap[i]:
            b[i], b[i + 1] = b[i + 1], b[i]
        b[i + 1] -= lower[i] * b[i]
    x = np.zeros(m)
    for i in range(m - 1, -1, -1):
        t = b[i]
        if i + 1 < m:
            t -= u[i, 1] * x[i + 1]
        if i + 2 < m:
            t -= u[i, 2] * x[i + 2]
        x[i] = t / u[i, 0]
    return x


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: list[float], rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors of T for the given eigenvalues; vectors of close values are kept orthogonal."""
    m = len(diag)
    norm = float(np.max(np.abs(diag)) + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    gap = 1e-3 * norm
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(12345)
    for k, lam in enumerate(values):
        cluster = [j for j in range(k) if abs(values[j] - lam) <= gap]
        x = rng.standard_normal(m)
        shift = lam + (len(cluster) * 10 * np.finfo(float).eps * norm)  # separate equal shifts a little
        for _ in range(rounds):
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x))
            for _ in range(2):  # twice is enough for orthogonality within a cluster
                for j in cluster:
                    x -= (vectors[j] @ x) * vectors[j]
            nx = np.linalg.norm(x)
            if not np.isfinite(nx) or nx == 0.0:
                x = rng.standard_normal(m)
                continue
            x /= nx
        vectors.append(x)
    return np.array(vectors).reshape(len(values), m)


def back_transform(z: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Eigenvector of the full matrix from one of its tridiagonal form."""
    z = z.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if len(v):
            z[k + 1:] -= 2.0 * v * (v @ z[k + 1:])
    return z


def leading(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest k eigenvalues (falling) and unit eigenvectors (rows) of a symmetric matrix."""
    m = len(cov)
    k = min(k, m)
    if m == 0 or k == 0:
        return np.zeros(0), np.zeros((0, m))
    if m == 1:
        return np.array([float(cov[0][0])]), np.ones((1, 1))
    diag, off, reflectors = tridiagonal(cov)
    values = [bisect(diag, off, m - 1 - i) for i in range(k)]
    z = inverse_iteration(diag, off, values)
    vectors = np.array([back_transform(v, reflectors) for v in z])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # one sign for all rows: the entry of largest magnitude (first of equals) is positive
    for v in vectors:
        if v[int(np.argmax(np.abs(v)))] < 0:
            v *= -1.0
    return np.array(values), vectors


# ---------------------------------------------------------------- the operator

def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every valid row and
    each of the leading `components` components; see the module text for defined cases."""
    spark = df.sparkSession
    y_col, id_name = fresh(df, "y"), fresh(df, "id")
    rows = (df.select(F.col(id_col).alias(id_name), F.col(vector).alias(y_col))
            .filter(finite_vector(F.col(y_col)))
            .select(id_name, integers(F.col(y_col), scale).alias(y_col)))
    d = rows.agg(F.max(F.size(y_col))).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if d == 0:
        return spark.createDataFrame([], schema) if rows.limit(1).count() == 0 else _zero_dim(rows, id_name)
    rows = rows.select(id_name, F.concat(y_col, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(y_col))).alias(y_col))
    n, s, centred = moments(rows.select(y_col), d)
    if n == 0:
        return spark.createDataFrame([], schema)
    cov = np.array([[float(Decimal(int(v)) / Decimal(n * n)) for v in row] for row in centred])
    values, vectors = leading(cov, components)
    trace = float(Decimal(int(sum(centred[i][i] for i in range(d)))) / Decimal(n * n))
    live = [i for i, e in enumerate(values) if e > 1e-12 * trace]
    # means of x = y + offset: exact integers divided once
    mean = [float((Decimal(v) + Decimal(n) * offset) / Decimal(n)) for v in s]
    x = F.transform(F.col(y_col), lambda v: v.cast("double") + F.lit(float(offset)))
    centred_x = F.transform(x, lambda v, j: v - F.array(*[F.lit(m) for m in mean])[j])
    whitened = []
    for i in range(len(values)):
        if i in live:
            w = F.array(*[F.lit(float(c / np.sqrt(values[i]))) for c in vectors[i]])
            whitened.append(F.aggregate(F.zip_with(centred_x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))
        else:
            whitened.append(F.lit(None).cast("double"))
    big = "decimal(38,0)"
    sums = F.array(*[F.lit(Decimal(v)).cast(big) for v in s])
    dev = F.aggregate(F.transform(F.col(y_col), lambda v, j: F.pow(v.cast(big) * F.lit(n).cast(big) - sums[j], 2).cast(big)),
                      F.lit(0).cast(big), lambda acc, v: (acc + v).cast(big))
    w_name = fresh(df, "w")
    projected = rows.select(F.col(id_name), dev.cast("long").alias("deviation"), F.array(*whitened).alias(w_name))
    identity_error = _identity_error(projected, w_name, live, n)
    explained = [F.lit(float(e / trace) if trace > 0 else None).cast("double") for e in values]
    per = F.arrays_zip(F.sequence(F.lit(1), F.lit(len(values))).alias("component"), F.col(w_name).alias("whitened"),
                       F.array(*explained).alias("explained"))
    return (projected.select(F.col(id_name).alias("vec_id"), "deviation", F.explode(per).alias("c"))
            .select("vec_id", F.col("c.component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
                    F.lit(identity_error).cast("double").alias("identity_error")))


def _identity_error(projected: DataFrame, w_name: str, live: list[int], n: int) -> float | None:
    """Largest |covariance of whitened - identity| over the live components, from one Spark pass."""
    if not live:
        return None
    w = F.col(w_name)
    aggs = [F.sum(w[i]).alias(f"s{i}") for i in live]
    aggs += [F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for a, i in enumerate(live) for j in live[a:]]
    r = projected.agg(*aggs).first()
    worst = 0.0
    for a, i in enumerate(live):
        for j in live[a:]:
            cov = r[f"p{i}_{j}"] / n - (r[f"s{i}"] / n) * (r[f"s{j}"] / n)
            worst = max(worst, abs(cov - (1.0 if i == j else 0.0)))
    return worst


def _zero_dim(rows: DataFrame, id_name: str) -> DataFrame:
    """Only empty vectors: no components, so no rows."""
    return rows.select(F.col(id_name).alias("vec_id")).limit(0).select(
        "vec_id", F.lit(None).cast("int").alias("component"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("double").alias("whitened"),
        F.lit(None).cast("double").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
