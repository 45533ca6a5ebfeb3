"""Distances, statistics and small linear algebra, as Column builders and as numpy functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(a, b, step) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), step), F.lit(0.0), lambda s, v: s + v)


def manhattan(a, b) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y).cast("double"))


def euclidean(a, b) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")))


def minkowski(a, b, p: float = 2) -> Column:
    return F.pow(_fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def use_distance(name: str):
    """The Column builder of a distance's name."""
    known = {"manhattan": manhattan, "1-norm": manhattan, "euclidean": euclidean, "2-norm": euclidean, "minkowski": minkowski, "p-norm": minkowski}
    if name not in known:
        raise ValueError(f"no distance is named {name}")
    return known[name]


def pairwise(x: np.ndarray, y: np.ndarray, metric: str = "euclidean", p: float = 2) -> np.ndarray:
    """Distances of all rows of x and y; differences are held for as many rows of x as 8 MB take."""
    step = max(1, min(256, (1 << 20) // max(1, y.size)))
    if metric in ("euclidean", "2-norm") or (metric in ("minkowski", "p-norm") and p == 2):
        out = np.empty((len(x), len(y)))
        for s in range(0, len(x), step):
            d = x[s : s + step, None, :] - y[None]
            out[s : s + step] = np.sqrt((d * d).sum(axis=2))
        return out
    q = 1.0 if metric in ("manhattan", "1-norm") else float(p)
    out = np.empty((len(x), len(y)))
    for s in range(0, len(x), step):
        d = np.abs(x[s : s + step, None, :] - y[None])
        out[s : s + step] = d.sum(axis=2) if q == 1 else (d**q).sum(axis=2) ** (1 / q)
    return out


def product_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared euclidean distances by one product; where that cancels (under a millionth of the norms), by differences."""
    norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    out = norms - 2 * (x @ y.T)
    i, j = np.nonzero(~(out >= 1e-6 * norms))
    for s in range(0, len(i), 1 << 15):
        d = x[i[s : s + (1 << 15)]] - y[j[s : s + (1 << 15)]]
        out[i[s : s + (1 << 15)], j[s : s + (1 << 15)]] = (d * d).sum(axis=1)
    return out


def closest(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The first nearest row of y for each row of x, by blocks of rows."""
    return np.concatenate([pairwise(x[s : s + 256], y, metric).argmin(axis=1) for s in range(0, len(x), 256)]) if len(x) else np.zeros(0, int)


def kth_distances(x: np.ndarray, k: int, metric: str = "euclidean", p: float = 2) -> np.ndarray:
    """Distance of each row to its k-th nearest row, itself counted, by blocks of rows."""
    k = min(k, len(x)) - 1
    return np.concatenate([np.partition(pairwise(x[s : s + 256], x, metric, p), k, axis=1)[:, k].copy() for s in range(0, len(x), 256)]) if len(x) else np.zeros(0)


def nearest_rows(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest other rows of each row (or of those numbered `of`), ties to the first, by blocks of rows."""

    def block(at):
        d = pairwise(x[at], x)
        d[np.arange(len(at)), at] = np.inf
        return np.argsort(d, axis=1, kind="stable")[:, :k].copy()

    return by_blocks(block, np.arange(len(x)) if of is None else of, width=len(x))


def links(a: np.ndarray, b: np.ndarray, n: int, both: float = 1.0):
    """Products with the symmetric matrix of links (a, b): 1 where a pair is linked from either side, `both` where from both."""
    code, count = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    i, j, v = code // n, code % n, np.where(count > 1, both, 1.0)
    starts = np.searchsorted(i, np.arange(n))

    def times(m):
        parts = np.add.reduceat(np.vstack([m[j] * v[:, None], np.zeros((1, m.shape[1]))]), starts, axis=0)
        parts[np.append(starts[1:], len(i)) == starts] = 0
        return parts

    return times


# --- statistics: aggregates of a column ------------------------------------------


def total(c) -> Column:
    return F.sum(_col(c))


def expected(c) -> Column:
    return F.avg(_col(c))


mean = expected


def variance(c, df: int) -> Column:
    """Sum of squared deviations over the divisor df."""
    return F.var_pop(_col(c)) * F.count(_col(c)) / df


def covariance(a, b) -> Column:
    return F.covar_pop(_col(a), _col(b))


def var_sample(c) -> Column:
    return F.var_samp(_col(c))


def sd_sample(c) -> Column:
    return F.stddev_samp(_col(c))


def var_population(c) -> Column:
    return F.var_pop(_col(c))


def sd_population(c) -> Column:
    return F.stddev_pop(_col(c))


def mode(df: DataFrame, column: str, row: str) -> DataFrame:
    """The most frequent value; of several, the one whose first row comes first."""
    g = df.groupBy(column).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    return g.agg(F.min_by(column, F.struct(-F.col("n"), F.col("first"))).alias("value"))


def frequencies_to_probabilities(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(t)).select(column, (F.col("n") / F.col("t")).alias("p"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Base-2 entropy of a column's values."""
    return frequencies_to_probabilities(df, column).agg((-F.sum(F.col("p") * F.log2("p"))).alias("value"))


def gini(df: DataFrame, column: str) -> DataFrame:
    return frequencies_to_probabilities(df, column).agg((1 - F.sum(F.col("p") * F.col("p"))).alias("value"))


# --- linear algebra ------------------------------------------------------------------


def gaussian_elimination(a: np.ndarray) -> np.ndarray:
    """The row echelon form with partial pivoting and leading ones."""
    a = np.array(a, float)
    row = 0
    for col in range(a.shape[1]):
        if row == len(a):
            break
        pivot = row + int(np.argmax(np.abs(a[row:, col])))
        if abs(a[pivot, col]) < 1e-12:
            continue
        a[[row, pivot]] = a[[pivot, row]]
        a[row] /= a[row, col]
        for r in range(len(a)):
            if r != row:
                a[r] -= a[r, col] * a[row]
        row += 1
    return a


def identity_matrix(n: int) -> np.ndarray:
    return np.eye(n)


def transpose(df: DataFrame) -> DataFrame:
    """Of a matrix in long form (i, j, value)."""
    return df.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def augment_matrix(a, b) -> np.ndarray:
    return np.hstack([a, b])


def det(a) -> float:
    return float(np.linalg.det(np.asarray(a, float)))


def cofactor_matrix(a, i: int, j: int) -> np.ndarray:
    return np.delete(np.delete(np.asarray(a, float), i, axis=0), j, axis=1)


def elementary_inverse(a) -> np.ndarray | bool:
    """The inverse, or False where there is none."""
    a = np.asarray(a, float)
    return np.linalg.inv(a) if np.linalg.matrix_rank(a) == len(a) else False


def lstsq(a, b) -> np.ndarray | bool:
    """Least squares by QR, or False if the columns are dependent."""
    q, r = np.linalg.qr(np.asarray(a, float))
    d = np.abs(np.diag(r))
    return np.linalg.solve(r, q.T @ b) if len(d) and d.min() > 1e-10 * max(d.max(), 1e-300) else False


def symmetric_eigen(a, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors (columns), the largest component positive."""
    v, u = np.linalg.eigh(np.asarray(a, float))
    return v[::-1][:k], orient(u[:, ::-1][:, :k])


def orient(u: np.ndarray) -> np.ndarray:
    """Columns with the sign that makes their largest component positive."""
    at = np.abs(u).argmax(axis=0)
    return u * np.where(u[at, np.arange(u.shape[1])] < 0, -1.0, 1.0)


def kernel(x: np.ndarray, y: np.ndarray, name: str, gamma: float = 1.0, degree: float = 3, coef0: float = 0.0) -> np.ndarray:
    if callable(name):
        return name(x, y)
    if name == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
    dot = x @ y.T
    if name == "linear":
        return dot
    if name == "poly":
        return (gamma * dot + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    if name == "cosine":
        return dot / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None], 1e-300)
    raise ValueError(f"no kernel is named {name}")


# --- large symmetric matrices, known by their products alone ---------------------------


def by_blocks(fn, *rows: np.ndarray, width: int) -> np.ndarray:
    """fn of blocks of rows, one below the other; a block times width has about two million numbers."""
    step = max(1, (1 << 21) // max(1, width))
    return np.concatenate([fn(*[r[s : s + step] for r in rows]) for s in range(0, max(1, len(rows[0])), step)])


def top_eigen(times, n: int, k: int, tol: float = 1e-10, width: int = 8, dense: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their vectors (columns) of the symmetric matrix that times() multiplies with.

    Block Lanczos with full orthogonalisation and restarts from the best vectors, until residuals are below
    tol times the largest value.  Small matrices are written out.
    """
    k = min(k, n)
    if n <= max(dense, 20 * (k + width)):
        a = times(np.eye(n))
        v, u = np.linalg.eigh((a + a.T) / 2)
        return v[::-1][:k], u[:, ::-1][:, :k]
    b, rng = k + width, np.random.default_rng(0)
    block = np.linalg.qr(rng.standard_normal((n, b)))[0]
    v, av = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(2000):
        w = times(block)
        v, av = np.hstack([v, block]), np.hstack([av, w])
        h = v.T @ av
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top, a_top = v @ s[:, :b], av @ s[:, :b]
        rest = a_top - top * theta[:b]
        if np.linalg.norm(rest[:, :k], axis=0).max() <= tol * max(np.abs(theta).max(), 1e-300):
            return theta[:k], top[:, :k]
        if v.shape[1] >= 30 * b:
            keep = s[:, : 3 * b]
            v, av = v @ keep, av @ keep
            w = rest
        for _ in range(2):
            w = w - v @ (v.T @ w)
            w = w / np.maximum(np.linalg.norm(w, axis=0), 1e-300)
        q, r = np.linalg.qr(w)
        weak = np.abs(np.diag(r)) < 1e-8
        if weak.any():
            q[:, weak] = rng.standard_normal((n, int(weak.sum())))
            q = np.linalg.qr(q - v @ (v.T @ q))[0]
            q = np.linalg.qr(q - v @ (v.T @ q))[0]
        block = q
    raise ValueError("the eigenvectors did not settle")


def solve_positive(times, y: np.ndarray, tol: float = 1e-12, max_iter: int = 5000) -> np.ndarray:
    """Conjugate gradients for each column of y; the matrix is positive definite."""
    b = y.reshape(len(y), -1)
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), (r * r).sum(axis=0)
    least = tol**2 * np.maximum(rr, 1e-300)
    for _ in range(max_iter):
        if (rr <= least).all():
            return x.reshape(y.shape)
        ap = times(p)
        a = np.where(rr > least, rr / np.maximum((p * ap).sum(axis=0), 1e-300), 0)
        x, r = x + a * p, r - a * ap
        new = (r * r).sum(axis=0)
        p, rr = r + np.where(rr > least, new / np.maximum(rr, 1e-300), 0) * p, new
    raise ValueError("the linear system did not settle")
