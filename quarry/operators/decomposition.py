"""Decompositions.  Linear ones come from one Gram matrix; the rest from partial sums or bounded matrices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from quarry.functions.distances import by_blocks, kernel, orient, top_eigen
from quarry.operators.base import MAX_ROWS, ArrayEstimator, BaseEstimator, Transformer, score_column
from quarry.operators.feature_selection import digamma
from quarry.plans.aggregate import gram, partial_sums


class PCA(Transformer, BaseEstimator):
    params = {"n_components": None}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        n, self.mean_, s = gram(df, features)
        v, u = np.linalg.eigh(s / (n - 1))
        k = self.n_components or len(features)
        self.explained_variance_, self.components_ = np.maximum(v[::-1][:k], 0), orient(u[:, ::-1][:, :k]).T
        self.explained_variance_ratio_ = self.explained_variance_ / max(v.sum(), 1e-300)
        return self

    def transform_arrays(self, x):
        return (x - self.mean_) @ self.components_.T

    def inverse_arrays(self, z):
        return z @ self.components_ + self.mean_

    def inverse_transform(self, df, column="transformed", output="restored"):
        c, m = self.components_.tolist(), self.mean_.tolist()
        parts = [sum((F.col(column)[k] * c[k][i] for k in range(len(c))), F.lit(m[i])) for i in range(len(m))]
        return df.withColumn(output, F.array(*parts))


class TruncatedSVD(PCA):
    """Without centring."""

    params = {"n_components": 2}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        n, mean, s = gram(df, features)
        whole = s + n * np.outer(mean, mean)
        v, u = np.linalg.eigh(whole)
        k = self.n_components
        self.components_ = orient(u[:, ::-1][:, :k]).T
        self.singular_values_ = np.sqrt(np.maximum(v[::-1][:k], 0))
        self.mean_ = np.zeros(len(mean))
        self.explained_variance_ = np.array([c @ s @ c / n for c in self.components_])
        self.explained_variance_ratio_ = self.explained_variance_ / max(np.trace(s) / n, 1e-300)
        return self


class SparsePCA(PCA):
    """Soft-thresholded power iterations with deflation."""

    params = {"alpha": 1.0, "max_iter": 100, "tol": 1e-8}

    def fit(self, df, features, label=None):
        super().fit(df, features)
        n, _, s = gram(df, features)
        c, parts = s / (n - 1), []
        for k in range(self.n_components or len(features)):
            v = self.components_[k].copy()
            for _ in range(self.max_iter):
                z = c @ v
                z = np.sign(z) * np.maximum(np.abs(z) - self.alpha, 0)
                norm = np.linalg.norm(z)
                if norm == 0:
                    v = np.zeros_like(v)
                    break
                new = z / norm
                done = np.linalg.norm(new - v) < self.tol
                v = new
                if done:
                    break
            parts.append(v)
            c = c - (v @ c @ v) * np.outer(v, v)
        self.components_ = orient(np.array(parts).T).T
        return self


class IncrementalPCA(PCA):
    """Batches of rows merged by singular value decompositions with a correction for the moved mean.

    ``partial_fit`` also takes the batches of a stream (``foreachBatch``).
    """

    params = {"batch_size": None}

    def partial_arrays(self, x):
        n0 = getattr(self, "n_", 0)
        m, k = x.mean(axis=0), self.n_components or x.shape[1]
        if n0 == 0:
            stack = x - m
            mean = m
        else:
            mean = (self.mean_ * n0 + m * len(x)) / (n0 + len(x))
            stack = np.vstack([self.singular_values_[:, None] * self.components_, x - m, math.sqrt(n0 * len(x) / (n0 + len(x))) * (self.mean_ - m)])
        _, s, vt = np.linalg.svd(stack, full_matrices=False)
        self.n_, self.mean_ = n0 + len(x), mean
        self.components_, self.singular_values_ = orient(vt[:k].T).T, s[:k]
        self.explained_variance_ = self.singular_values_**2 / max(self.n_ - 1, 1)
        return self

    def partial_fit(self, df, features, order="row_id"):
        from quarry.operators.base import gather

        self.features_ = list(features)
        x = gather(df, features, order=order)
        size = self.batch_size or 5 * x.shape[1]
        for s in range(0, len(x), size):
            self.partial_arrays(x[s : s + size])
        return self

    def fit(self, df, features, label=None, order="row_id"):
        self.__dict__.pop("n_", None)
        return self.partial_fit(df, features, order)


class KernelPCA(Transformer, ArrayEstimator):
    params = {"n_components": None, "kernel": "linear", "gamma": None, "degree": 3, "coef0": 1.0, "alpha": 1.0, "fit_inverse_transform": False, "max_rows": MAX_ROWS}
    DENSE_ROWS = 5000

    def _k(self, a, b):
        return kernel(a, b, self.kernel, self.gamma if self.gamma is not None else 1 / a.shape[1], self.degree, self.coef0)

    def fit_arrays(self, x, y=None, w=None):
        self.x_ = x
        if len(x) > self.DENSE_ROWS:
            if not self.n_components or self.fit_inverse_transform:
                raise ValueError(f"all components and inverse transforms are for at most {self.DENSE_ROWS} rows")
            times = lambda m: by_blocks(lambda r: self._k(r, x) @ m, x, width=len(x))
            self.rows_ = times(np.ones((len(x), 1)))[:, 0] / len(x)
            self.all_ = self.rows_.mean()

            def centred(m):
                out = times(m - m.mean(axis=0))
                return out - out.mean(axis=0)

            v, u = top_eigen(centred, len(x), self.n_components)
            keep = np.flatnonzero(v > 1e-10 * max(v.max(), 1e-300))
            self.eigenvalues_, self.vectors_ = v[keep], orient(u[:, keep])
            return self
        k = self._k(x, x)
        self.rows_, self.all_ = k.mean(axis=0), k.mean()
        c = k - self.rows_[None] - self.rows_[:, None] + self.all_
        v, u = np.linalg.eigh(c)
        keep = np.flatnonzero(v > 1e-10 * max(v.max(), 1e-300))[::-1][: self.n_components or len(x)]
        self.eigenvalues_, self.vectors_ = v[keep], orient(u[:, keep])
        if self.fit_inverse_transform:
            z = self.transform_arrays(x)
            self.back_ = np.linalg.solve(kernel(z, z, self.kernel, self.gamma or 1 / z.shape[1], self.degree, self.coef0) + self.alpha * np.eye(len(z)), x)
            self.z_ = z
        return self

    def transform_arrays(self, x):
        def block(r):
            k = self._k(r, self.x_)
            c = k - k.mean(axis=1, keepdims=True) - self.rows_[None] + self.all_
            return c @ self.vectors_ / np.sqrt(self.eigenvalues_)

        return by_blocks(block, x, width=len(self.x_))

    def inverse_arrays(self, z):
        return kernel(z, self.z_, self.kernel, self.gamma or 1 / z.shape[1], self.degree, self.coef0) @ self.back_


class FastICA(Transformer, BaseEstimator):
    """Whitening from one Gram matrix; each fixed-point step is one pass of partial sums."""

    params = {"n_components": None, "algorithm": "parallel", "whiten": "unit-variance", "fun": "logcosh", "max_iter": 200, "tol": 1e-4, "random_state": 0}

    def _g(self, u):
        if self.fun == "logcosh":
            t = np.tanh(u)
            return t, 1 - t * t
        if self.fun == "exp":
            e = np.exp(-u * u / 2)
            return u * e, (1 - u * u) * e
        return u**3, 3 * u * u

    def fit(self, df, features, label=None):
        self.features_, k = list(features), self.n_components or len(features)
        n, self.mean_, s = gram(df, features)
        v, u = np.linalg.eigh(s / n)
        v, u = v[::-1][:k], u[:, ::-1][:, :k]
        white = np.eye(len(features))[:k] if self.whiten is False else (u / np.sqrt(np.maximum(v, 1e-300))).T
        w = np.random.default_rng(self.random_state).standard_normal((k, k))
        even = lambda m: (lambda a, b: a @ b)(*(lambda q: (q[0], q[2]))(np.linalg.svd(m)))
        mean = self.mean_

        def moments(w):
            def f(m):
                z = (m - mean) @ white.T
                g, d = self._g(z @ w.T)
                return np.concatenate([(g.T @ z).ravel(), d.sum(axis=0)])

            out = partial_sums(df, features, f)
            return out[: len(w) * k].reshape(len(w), k) / n - (out[len(w) * k :] / n)[:, None] * w

        if self.algorithm == "parallel":
            w = even(w)
            for _ in range(self.max_iter):
                new = even(moments(w))
                done = np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1)) < self.tol
                w = new
                if done:
                    break
        else:
            for i in range(k):
                v_ = w[i] / np.linalg.norm(w[i])
                for _ in range(self.max_iter):
                    new = moments(v_[None])[0]
                    new = new - w[:i].T @ (w[:i] @ new)
                    new /= np.linalg.norm(new)
                    done = abs(abs(new @ v_) - 1) < self.tol
                    v_ = new
                    if done:
                        break
                w[i] = v_
        self.components_ = w @ white
        self.mixing_ = np.linalg.pinv(self.components_)
        return self

    def transform_arrays(self, x):
        return (x - self.mean_) @ self.components_.T

    def inverse_arrays(self, z):
        return z @ self.mixing_.T + self.mean_


class NMF(Transformer, BaseEstimator):
    """Multiplicative updates.  Rows' weights W are row-local, so an update of H needs two small sums: one pass."""

    params = {"n_components": 2, "max_iter": 200, "tol": 1e-4, "alpha_w": 0.0, "alpha_h": 0.0, "l1_ratio": 0.0, "random_state": 0, "inner_iter": 20}

    def _w(self, x, h, steps):
        l1, l2 = self.alpha_w * self.l1_ratio * x.shape[1], self.alpha_w * (1 - self.l1_ratio) * x.shape[1]
        w = np.full((len(x), len(h)), np.sqrt(max(x.mean(), 1e-12) / len(h))) if len(x) else np.zeros((0, len(h)))
        xh, hh = x @ h.T, h @ h.T
        for _ in range(steps):
            w = w * xh / np.maximum(w @ hh + l1 + l2 * w, 1e-12)
        return w

    def fit(self, df, features, label=None):
        self.features_, k, p = list(features), self.n_components, len(features)
        rng = np.random.default_rng(self.random_state)
        n, mean, s = gram(df, features)
        v, u = np.linalg.eigh(s + n * np.outer(mean, mean))
        h = np.abs(u[:, ::-1][:, :k]).T * np.sqrt(np.maximum(v[::-1][:k], 1e-12) / n)[:, None] + 1e-3 * mean.mean() * rng.random((k, p))
        l1, l2 = self.alpha_h * self.l1_ratio * n, self.alpha_h * (1 - self.l1_ratio) * n
        last = None
        for it in range(self.max_iter):
            def f(m, h=h):
                w = self._w(m, h, self.inner_iter)
                return np.concatenate([(w.T @ m).ravel(), (w.T @ w).ravel(), [((m - w @ h) ** 2).sum()]])

            out = partial_sums(df, features, f)
            wx, ww, err = out[: k * p].reshape(k, p), out[k * p : -1].reshape(k, k), math.sqrt(out[-1])
            for _ in range(5):
                h = h * wx / np.maximum(ww @ h + l1 + l2 * h, 1e-12)
            if it % 10 == 9:
                if last is not None and (last - err) < self.tol * max(last, 1e-300):
                    break
                last = err
        self.components_, self.reconstruction_error_ = h, err
        return self

    def transform_arrays(self, x):
        return self._w(x, self.components_, 200)


class FactorAnalysis(Transformer, BaseEstimator):
    params = {"n_components": None, "tol": 1e-2, "max_iter": 1000, "noise_variance_init": None, "rotation": None}

    def fit(self, df, features, label=None):
        self.features_, p = list(features), len(features)
        k = self.n_components or p
        n, self.mean_, s = gram(df, features)
        c, var = s / n, np.maximum(np.diag(s) / n, 1e-12)
        psi = np.ones(p) if self.noise_variance_init is None else np.array(self.noise_variance_init, float)
        old, self.loglike_ = -math.inf, []
        for _ in range(self.max_iter):
            r = np.sqrt(psi) + 1e-12
            v, u = np.linalg.eigh(c / np.outer(r, r))
            v, u = v[::-1], u[:, ::-1]
            w = np.sqrt(np.maximum(v[:k] - 1, 0))[:, None] * u[:, :k].T * r
            ll = -n / 2 * (p * math.log(2 * math.pi) + np.log(np.maximum(v[:k], 1e-300)).sum() + k + v[k:].sum() + np.log(psi).sum())
            self.loglike_.append(float(ll))
            if ll - old < self.tol:
                break
            old = ll
            psi = np.maximum(var - (w * w).sum(axis=0), 1e-12)
        self.components_, self.noise_variance_ = self._rotated(w), psi
        return self

    def _rotated(self, w):
        if not self.rotation:
            return w
        a, (p, k) = w.T, w.T.shape
        rot, old = np.eye(k), 0.0
        for _ in range(500):
            b = a @ rot
            t = a.T @ (b**3 - (b * (b * b).sum(axis=0) / p if self.rotation == "varimax" else 0))
            u, s, vt = np.linalg.svd(t)
            rot, new = u @ vt, s.sum()
            if old and new < old * (1 + 1e-6):
                break
            old = new
        return (a @ rot).T

    def transform_arrays(self, x):
        w, psi = self.components_, self.noise_variance_
        return (x - self.mean_) / psi @ w.T @ np.linalg.inv(np.eye(len(w)) + w / psi @ w.T)


class LatentDirichletAllocation(Transformer, BaseEstimator):
    """Batch variational EM: rows' steps are row-local, topics' sums one pass."""

    params = {"n_components": 10, "doc_topic_prior": None, "topic_word_prior": None, "max_iter": 10, "max_doc_update_iter": 100, "mean_change_tol": 1e-3, "random_state": 0}

    def _docs(self, x, beta):
        a = self.doc_topic_prior or 1 / self.n_components
        gamma = np.ones((len(x), self.n_components))
        for _ in range(self.max_doc_update_iter):
            theta = np.exp(digamma(gamma.ravel()).reshape(gamma.shape) - digamma(gamma.sum(axis=1))[:, None])
            new = a + theta * ((x / (theta @ beta + 1e-100)) @ beta.T)
            done = np.abs(new - gamma).mean(axis=1).max(initial=0) < self.mean_change_tol
            gamma = new
            if done:
                break
        theta = np.exp(digamma(gamma.ravel()).reshape(gamma.shape) - digamma(gamma.sum(axis=1))[:, None])
        return gamma, theta

    def fit(self, df, features, label=None):
        self.features_, k, p = list(features), self.n_components, len(features)
        lam = np.random.default_rng(self.random_state).gamma(100, 0.01, (k, p))
        for _ in range(self.max_iter):
            beta = np.exp(digamma(lam.ravel()).reshape(k, p) - digamma(lam.sum(axis=1))[:, None])

            def f(m, beta=beta):
                _, theta = self._docs(m, beta)
                return (theta.T @ (m / (theta @ beta + 1e-100)) * beta).ravel()

            lam = (self.topic_word_prior or 1 / k) + partial_sums(df, features, f).reshape(k, p)
        self.components_ = lam
        return self

    def transform_arrays(self, x):
        lam = self.components_
        beta = np.exp(digamma(lam.ravel()).reshape(lam.shape) - digamma(lam.sum(axis=1))[:, None])
        gamma, _ = self._docs(x, beta)
        return gamma / gamma.sum(axis=1, keepdims=True)


class _PLS(BaseEstimator):
    """NIPALS on cross products alone, so on one Gram matrix of both sides' columns."""

    params = {"n_components": 2, "scale": True, "max_iter": 500, "tol": 1e-6}
    canonical = False

    def fit(self, df, features, labels):
        self.features_, self.labels_ = list(features), [labels] if isinstance(labels, str) else list(labels)
        p = len(features)
        n, mean, s = gram(df, [*features, *self.labels_])
        sd = np.sqrt(np.diag(s) / (n - 1))
        sd = np.where((sd > 0) & self.scale, sd, 1.0)
        c = s / np.outer(sd, sd)
        self.x_mean_, self.y_mean_, self.x_std_, self.y_std_ = mean[:p], mean[p:], sd[:p], sd[p:]
        xx, xy, yy = c[:p, :p].copy(), c[:p, p:].copy(), c[p:, p:].copy()
        ws, ps, qs, cs = [], [], [], []
        for _ in range(self.n_components):
            w, v = self._weights(xx, xy, yy)
            at = np.abs(w).argmax()
            if w[at] < 0:
                w, v = -w, -v
            tt = w @ xx @ w
            load = xx @ w / tt
            ws.append(w)
            ps.append(load)
            cs.append(v)
            if self.canonical:
                uu = v @ yy @ v
                q = yy @ v / uu
                a, b = np.eye(p) - np.outer(w, load), np.eye(len(v)) - np.outer(v, q)
                xx, xy, yy = a.T @ xx @ a, a.T @ xy @ b, b.T @ yy @ b
            else:
                q = xy.T @ w / tt
                xx, xy, yy = xx - tt * np.outer(load, load), xy - tt * np.outer(load, q), yy - tt * np.outer(q, q)
            qs.append(q)
        w, load, q, v = (np.array(m).T for m in (ws, ps, qs, cs))
        self.rotations_ = w @ np.linalg.pinv(load.T @ w)
        self.y_rotations_ = v @ np.linalg.pinv(q.T @ v)
        self.coef_ = (self.rotations_ @ (q.T if not self.canonical else np.linalg.lstsq(self.rotations_.T @ c[:p, :p] @ self.rotations_, self.rotations_.T @ c[:p, p:], rcond=None)[0])) * self.y_std_ / self.x_std_[:, None]
        return self

    def _weights(self, xx, xy, yy):
        v = np.ones(xy.shape[1]) if xy.shape[1] == 1 else np.linalg.svd(xy)[2][0]
        ix, iy = (np.linalg.pinv(xx, rcond=1e-10), np.linalg.pinv(yy, rcond=1e-10)) if self.canonical else (None, None)
        w = None
        for _ in range(self.max_iter):
            new = xy @ v if ix is None else ix @ xy @ v
            new = new / max(np.linalg.norm(new), 1e-300)
            v = xy.T @ new if iy is None else iy @ xy.T @ new
            v = v / max(np.linalg.norm(v), 1e-300)
            if w is not None and np.linalg.norm(new - w) < self.tol:
                break
            w = new
        return new, v

    def transform_arrays(self, x):
        return (x - self.x_mean_) / self.x_std_ @ self.rotations_

    def transform(self, df, output="transformed"):
        return score_column(df, self.features_, self.transform_arrays, output, "array<double>")

    def predict_arrays(self, x):
        return (x - self.x_mean_) @ self.coef_ + self.y_mean_

    def predict(self, df, output="prediction"):
        return score_column(df, self.features_, self.predict_arrays, output, "array<double>")


class PLSRegression(_PLS):
    pass


class CCA(_PLS):
    canonical = True


def johnson_lindenstrauss(n: int, eps: float) -> int:
    return int(4 * math.log(n) / (eps**2 / 2 - eps**3 / 3))


class GaussianRandomProjection(Transformer, BaseEstimator):
    params = {"n_components": "auto", "eps": 0.1, "random_state": 0}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        k = johnson_lindenstrauss(max(df.count(), 2), self.eps) if self.n_components == "auto" else self.n_components
        self.components_ = self._draw(np.random.default_rng(self.random_state), k, len(features))
        return self

    def _draw(self, rng, k, p):
        return rng.standard_normal((k, p)) / math.sqrt(k)

    def transform_arrays(self, x):
        return x @ self.components_.T


class SparseRandomProjection(GaussianRandomProjection):
    params = {"density": "auto"}

    def _draw(self, rng, k, p):
        d = 1 / math.sqrt(p) if self.density == "auto" else self.density
        u = rng.random((k, p))
        return np.where(u < d / 2, -1.0, np.where(u < d, 1.0, 0.0)) * math.sqrt(1 / d / k)
