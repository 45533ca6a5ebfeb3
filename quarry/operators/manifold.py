"""Manifold learning: dense n x n methods, on bounded tables."""

from __future__ import annotations

import numpy as np

from quarry.functions.distances import by_blocks, links, nearest_rows, orient, pairwise, top_eigen
from quarry.operators.base import MAX_ROWS, ArrayEstimator
from quarry.plans.together import cholesky_solver, together


class _Embedding(ArrayEstimator):
    params = {"n_components": 2, "max_rows": 5000}

    def fit_transform_arrays(self, x):
        return self.fit_arrays(x).embedding_

    def fit_transform(self, df, features, row="row_id"):
        """(row, embedding) of the fitted rows."""
        from quarry.operators.base import gather

        m = gather(df, [*features, row], self.max_rows, row)
        self.features_ = list(features)
        e = self.fit_arrays(m[:, :-1]).embedding_
        return df.sparkSession.createDataFrame([(int(r), v.tolist()) for r, v in zip(m[:, -1], e, strict=True)], f"{row} long, embedding array<double>")


def classical_scaling(d: np.ndarray, k: int) -> np.ndarray:
    s = d * d
    b = -0.5 * (s - s.mean(axis=0)[None] - s.mean(axis=1)[:, None] + s.mean())
    v, u = np.linalg.eigh(b)
    return orient(u[:, ::-1][:, :k]) * np.sqrt(np.maximum(v[::-1][:k], 0))


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's component."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = new[new]
        if (new == least).all():
            return least
        least = new


class MDS(_Embedding):
    """Classical scaling.

    Of euclidean distances it is the projection on the main axes of the rows: their doubly centred
    squares are the products of the centred rows.
    """

    params = {"dissimilarity": "euclidean", "max_rows": MAX_ROWS}

    def fit_arrays(self, x, y=None, w=None):
        if self.dissimilarity == "precomputed":
            self.embedding_ = classical_scaling(x, self.n_components)
            return self
        c, k = x - x.mean(axis=0), min(self.n_components, len(x))
        _, u = np.linalg.eigh(c.T @ c)
        e = orient(c @ u[:, ::-1][:, :k])
        self.embedding_ = np.hstack([e, np.zeros((len(x), k - e.shape[1]))])
        return self


def shortest_paths(starts, j, w, d: np.ndarray) -> np.ndarray:
    """The least of d (nodes x sources) and of detours by links, which are sorted by node: node i has links starts[i] to starts[i + 1]."""
    while True:
        new = np.minimum(d, np.minimum.reduceat(d[j] + w[:, None], starts[:-1], axis=0))
        if (new == d).all():
            return d
        d = new


class Isomap(_Embedding):
    """Tables above DENSE_ROWS are dealt by rows to tasks that run at once; the model then keeps links in place of all paths."""

    params = {"n_neighbors": 5, "max_rows": MAX_ROWS}
    DENSE_ROWS = 5000

    def _in_tasks(self, team, x):
        n, mine = len(x), team.rows(len(x))
        near = team.joined(nearest_rows(x, self.n_neighbors, mine))
        i, j = np.repeat(np.arange(n), near.shape[1]), near.ravel()
        part = components(i, j, n)
        bridges, out = [], part != part[0]
        far, by = np.full(n, np.inf), np.full(n, n)  # the nearest reached row of each row outside
        new = np.flatnonzero(~out)
        while out.any():  # bridge components at their closest pair
            for b in [mine[out[mine]][s : s + 32] for s in range(0, len(mine), 32)]:
                for c in [new[s : s + 4096] for s in range(0, len(new), 4096)] if len(b) else []:
                    d = pairwise(b_x := x[b], x[c])
                    at = d.argmin(axis=1)
                    least, first = d[np.arange(len(b_x)), at], c[at]
                    better = (least < far[b]) | ((least == far[b]) & (first < by[b]))
                    far[b], by[b] = np.where(better, least, far[b]), np.where(better, first, by[b])
            ours = mine[out[mine]]
            best = min(team.share(min(((far[r], by[r], r) for r in ours), default=(np.inf, n, n))))
            bridges.append(best[1:])
            new = np.flatnonzero(part == part[best[2]])
            out[new] = False
        if bridges:
            i, j = np.append(i, [a for a, _ in bridges]), np.append(j, [b for _, b in bridges])
        code = np.unique(np.concatenate([i * n + j, j * n + i]))
        i, j = code // n, code % n
        w = np.concatenate([np.sqrt(((x[i[s : s + 8192]] - x[j[s : s + 8192]]) ** 2).sum(axis=1)) for s in range(0, len(i), 8192)])
        starts = np.searchsorted(i, np.arange(n + 1))
        s = np.empty((len(mine), n))
        for at in range(0, len(mine), 16):
            d = np.full((n, len(s[at : at + 16])), np.inf)
            d[mine[at : at + 16], np.arange(d.shape[1])] = 0
            s[at : at + 16] = (shortest_paths(starts, j, w, d) ** 2).T
        rows = team.joined(s.mean(axis=1))
        mean = rows.mean()

        def product(m):
            total = m.sum(axis=0)
            return -0.5 * (s @ m - (rows @ m)[None] - rows[mine][:, None] * total[None] + mean * total[None])

        found = team.top_eigen(product, n, self.n_components)
        return found and (*found, rows, mean, (starts, j, w))

    def fit_arrays(self, x, y=None, w=None):
        if len(x) > self.DENSE_ROWS:
            self.values_, u, self.rows_, self.all_, self.links_ = together(self._in_tasks, x, pair_bytes=8)
            self.x_, self.vectors_ = x, orient(u)
            self.embedding_ = self.vectors_ * np.sqrt(np.maximum(self.values_, 0))
            return self
        d = pairwise(x, x)
        near = nearest(d, self.n_neighbors)
        g = np.full_like(d, np.inf)
        i = np.repeat(np.arange(len(x)), near.shape[1])
        g[i, near.ravel()] = d[i, near.ravel()]
        g = np.minimum(g, g.T)
        np.fill_diagonal(g, 0)
        while True:  # bridge components at their closest pair
            part = np.isfinite(g)
            reach = np.zeros(len(x), bool)
            reach[0] = True
            while True:
                more = part[reach].any(axis=0)
                if (more == reach).all():
                    break
                reach = more
            if reach.all():
                break
            sub = np.where(reach[:, None] & ~reach[None], d, np.inf)
            a, b = np.unravel_index(sub.argmin(), d.shape)
            g[a, b] = g[b, a] = d[a, b]
        for k in range(len(x)):
            np.minimum(g, g[:, k : k + 1] + g[k : k + 1], out=g)
        self.x_, self.dist_matrix_ = x, g
        s = g * g
        self.rows_, self.all_ = s.mean(axis=0), s.mean()
        b = -0.5 * (s - self.rows_[None] - self.rows_[:, None] + self.all_)
        v, u = np.linalg.eigh(b)
        self.values_, self.vectors_ = v[::-1][: self.n_components], orient(u[:, ::-1][:, : self.n_components])
        self.embedding_ = self.vectors_ * np.sqrt(np.maximum(self.values_, 0))
        return self

    def transform_arrays(self, x):
        if len(self.x_) > self.DENSE_ROWS and len(x) > 16:
            return np.concatenate([self.transform_arrays(x[s : s + 16]) for s in range(0, len(x), 16)])
        d = pairwise(x, self.x_)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.n_neighbors]
        if len(self.x_) > self.DENSE_ROWS:
            g = np.full(d.shape, np.inf)
            np.put_along_axis(g, near, np.take_along_axis(d, near, axis=1), axis=1)
            g = shortest_paths(*self.links_, g.T).T
        else:
            g = np.min(np.take_along_axis(d, near, axis=1)[:, :, None] + self.dist_matrix_[near], axis=1)
        s = g * g
        b = -0.5 * (s - s.mean(axis=1, keepdims=True) - self.rows_[None] + self.all_)
        return b @ self.vectors_ / np.sqrt(np.maximum(self.values_, 1e-300))


class SpectralEmbedding(_Embedding):
    """The graph is held as links; its vectors come from products with them."""

    params = {"n_neighbors": 10, "random_state": None, "max_rows": MAX_ROWS}

    def fit_arrays(self, x, y=None, w=None):
        near = nearest_rows(x, self.n_neighbors)
        times = links(np.repeat(np.arange(len(x)), near.shape[1]), near.ravel(), len(x), both=2.0)
        deg = np.sqrt(np.maximum(times(np.ones((len(x), 1))) / 2, 1e-300))
        _, u = top_eigen(lambda m: times(m / deg) / (2 * deg), len(x), self.n_components + 1)
        self.embedding_ = orient(u[:, 1 : self.n_components + 1] / deg)
        return self


def barycentre_weights(x: np.ndarray, near: np.ndarray, reg: float) -> np.ndarray:
    z = near - x[:, None]
    g = np.einsum("nkd,nld->nkl", z, z)
    t = np.trace(g, axis1=1, axis2=2)
    g += (reg * np.where(t > 0, t, 1))[:, None, None] * np.eye(near.shape[1])[None]
    w = np.linalg.solve(g, np.ones((len(x), near.shape[1], 1)))[:, :, 0]
    return w / w.sum(axis=1, keepdims=True)


class LocallyLinearEmbedding(_Embedding):
    """Tables above DENSE_ROWS are dealt by rows to tasks that run at once, which factor the matrix of the weights together.

    Its vectors come from inverse products there, orthogonal to the constant one.  A graph with several closed parts has
    several vectors of value 0, of which any may come.
    """

    params = {"n_neighbors": 5, "reg": 1e-3, "random_state": None, "max_rows": MAX_ROWS}
    DENSE_ROWS = 5000

    def _in_tasks(self, team, x):
        n, mine = len(x), team.rows(len(x))
        near = team.joined(nearest_rows(x, self.n_neighbors, mine))
        i = np.repeat(np.arange(n)[:, None], near.shape[1] + 1, axis=1)
        j = np.hstack([i[:, :1], near])
        v = np.hstack([np.ones((n, 1)), -barycentre_weights(x, x[near], self.reg)])
        a, b = (np.repeat(j, j.shape[1], axis=1).ravel(), np.tile(j, (1, j.shape[1])).ravel())
        c = (np.repeat(v, v.shape[1], axis=1) * np.tile(v, (1, v.shape[1]))).ravel()
        own = c[a == b].sum() / n
        solve = cholesky_solver(team, np.append(a, np.arange(n)), np.append(b, np.arange(n)), np.append(c, np.full(n, 1e-10 * own)), n)
        free = lambda m: m - m.mean(axis=0)
        found = team.top_eigen(lambda m: free(solve(free(m)))[mine], n, self.n_components, tol=1e-8)
        if found is None:
            return None
        u = np.linalg.qr(free(found[1]))[0]
        left = np.einsum("nk,nkd->nd", v, u[j])
        return u @ np.linalg.eigh(left.T @ left)[1]

    def fit_arrays(self, x, y=None, w=None):
        if len(x) > self.DENSE_ROWS:
            self.x_, self.embedding_ = x, orient(together(self._in_tasks, x, pair_bytes=5))
            return self
        near = nearest(pairwise(x, x), self.n_neighbors)
        b = np.eye(len(x))
        np.subtract.at(b, (np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()), barycentre_weights(x, x[near], self.reg).ravel())
        _, u = np.linalg.eigh(b.T @ b)
        self.x_, self.embedding_ = x, orient(u[:, 1 : self.n_components + 1])
        return self

    def transform_arrays(self, x):
        near = by_blocks(lambda r: np.argsort(pairwise(r, self.x_), axis=1, kind="stable")[:, : self.n_neighbors].copy(), x, width=len(self.x_))
        return np.einsum("nk,nkd->nd", barycentre_weights(x, self.x_[near], self.reg), self.embedding_[near])


LLE = LocallyLinearEmbedding


class TSNE(_Embedding):
    """Exact gradients with early exaggeration.

    Tables above DENSE_ROWS are dealt by rows to tasks that run at once; gradients stay exact.
    """

    params = {"perplexity": 30.0, "learning_rate": 200.0, "n_iter": 250, "random_state": 0, "max_rows": MAX_ROWS}
    DENSE_ROWS = 5000

    def _in_tasks(self, team, x):
        n, mine = len(x), team.rows(len(x))
        blocks = [slice(s, min(s + 32, len(mine))) for s in range(0, len(mine), 32)]
        want = np.log(min(self.perplexity, max(2.0, (n - 1) / 3)))
        p, beta, least, sums = np.empty((len(mine), n)), np.ones(len(mine)), np.empty(len(mine)), np.empty(len(mine))
        for b in blocks:
            d = p[b]
            d[:] = pairwise(x[mine[b]], x) ** 2
            d[np.arange(len(d)), mine[b]] = np.inf
            least[b] = d.min(axis=1)
            above = d - least[b][:, None]
            spread = np.where(np.isfinite(above), above, 0)
            lo, hi, try_ = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            for _ in range(60):
                beta[b] = try_
                e = np.exp(-above * try_[:, None])
                sums[b] = e.sum(axis=1)
                h = np.log(sums[b]) + try_ * np.einsum("ij,ij->i", e, spread) / sums[b]
                wide = h > want
                lo, hi = np.where(wide, try_, lo), np.where(wide, hi, try_)
                try_ = np.where(np.isinf(hi), try_ * 2, (lo + hi) / 2)
                if (try_ == beta[b]).all():
                    break
        betas, leasts, all_sums = team.joined(beta), team.joined(least), team.joined(sums)
        for b in blocks:
            d = p[b].copy()
            p[b] = np.exp(-(d - least[b][:, None]) * beta[b][:, None]) / sums[b][:, None]
            p[b] += np.exp(-(d - leasts[None]) * betas[None]) / all_sums[None]
            p[b] = np.maximum(p[b] / (2 * n), 1e-12)
        z = np.random.default_rng(self.random_state).standard_normal((n, self.n_components)) * 1e-2
        z = team.share(z)[0]
        q, g = np.empty_like(p), np.empty((len(mine), z.shape[1]))
        move, gain, early = np.zeros_like(z), np.ones_like(z), min(100, self.n_iter // 2)
        for it in range(self.n_iter):
            for b in blocks:
                near = np.ones((b.stop - b.start, n))
                for c in z.T.copy():
                    step = c[mine[b]][:, None] - c[None]
                    step *= step
                    near += step
                np.divide(1, near, out=q[b])
                q[b][np.arange(b.stop - b.start), mine[b]] = 0
            every = team.total(q.sum())
            for b in blocks:
                f = np.maximum(q[b] / every, 1e-12)
                np.subtract((4.0 * p[b]) if it < early else p[b], f, out=f)
                f *= q[b]
                g[b] = 4 * (f.sum(axis=1)[:, None] * z[mine[b]] - f @ z)
            z, move, gain = self._step(z, move, gain, team.joined(g), it < early)
        return z

    def _step(self, z, move, gain, g, early):
        gain = np.maximum(np.where(np.sign(g) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if early else 0.8) * move - min(self.learning_rate, max(10.0, len(z) / 4)) * gain * g
        z = z + move
        return z - z.mean(axis=0), move, gain

    def fit_arrays(self, x, y=None, w=None):
        n = len(x)
        if n > self.DENSE_ROWS:
            self.embedding_ = together(self._in_tasks, x, pair_bytes=16)
            return self
        d = pairwise(x, x) ** 2
        np.fill_diagonal(d, np.inf)
        want = np.log(min(self.perplexity, max(2.0, (n - 1) / 3)))
        lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
        for _ in range(60):
            e = np.exp(-(d - d.min(axis=1, keepdims=True)) * beta[:, None])
            p = e / e.sum(axis=1, keepdims=True)
            h = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
            wide = h > want
            lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
            beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        z = np.random.default_rng(self.random_state).standard_normal((n, self.n_components)) * 1e-2
        move, gain, early = np.zeros_like(z), np.ones_like(z), min(100, self.n_iter // 2)
        for it in range(self.n_iter):
            q = 1 / (1 + pairwise(z, z) ** 2)
            np.fill_diagonal(q, 0)
            f = ((4.0 if it < early else 1.0) * p - np.maximum(q / q.sum(), 1e-12)) * q
            g = 4 * (f.sum(axis=1)[:, None] * z - f @ z)
            z, move, gain = self._step(z, move, gain, g, it < early)
        self.embedding_ = z
        return self
