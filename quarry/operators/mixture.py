"""Mixtures and discriminant analysis."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from quarry.operators.base import BaseEstimator, Classifier, Clusterer, Transformer, gather, score_column
from quarry.operators.cluster import KMeans
from quarry.operators.feature_selection import digamma
from quarry.operators.linear import softmax
from quarry.plans.aggregate import gram, partial_sums


def log_gaussian(x: np.ndarray, means: np.ndarray, chols: np.ndarray) -> np.ndarray:
    """Log densities; chols: Cholesky factors of the precisions (upper), or their diagonals."""
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, chols, strict=True)):
        z = (x - m) * c if c.ndim == 1 else (x - m) @ c
        out[:, k] = -0.5 * (x.shape[1] * math.log(2 * math.pi) + (z * z).sum(axis=1)) + np.log(c if c.ndim == 1 else np.diag(c)).sum()
    return out


def logsumexp(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=1)
    return m + np.log(np.exp(a - m[:, None]).sum(axis=1))


class GaussianMixture(Clusterer, BaseEstimator):
    """Expectation-maximisation; a step is one pass for counts, sums and sums of products by component."""

    params = {"n_components": 1, "covariance_type": "full", "tol": 1e-3, "reg_covar": 1e-6, "max_iter": 100, "n_init": 1, "random_state": 0, "weights_init": None, "means_init": None, "sample": 10_000}

    def _statistics(self, df, resp):
        p, k = len(self.features_), self.n_components

        def f(m):
            r, extra = resp(m)
            sq = (r.T @ (m * m)).ravel() if self.covariance_type in ("diag", "spherical") else np.einsum("nk,ni,nj->kij", r, m, m).ravel()
            return np.concatenate([[len(m), extra], r.sum(axis=0), (r.T @ m).ravel(), sq])

        s = partial_sums(df, self.features_, f)
        return s[0], s[1], s[2 : 2 + k], s[2 + k : 2 + k + k * p].reshape(k, p), s[2 + k + k * p :]

    def _maximise(self, n, nk, sums, sq):
        k, p = sums.shape
        nk = nk + 10 * np.finfo(float).eps
        self.means_ = sums / nk[:, None]
        self.weights_ = nk / n
        self._set_covariances(nk, sq, k, p)

    def _set_covariances(self, nk, sq, k, p):
        m = self.means_
        if self.covariance_type in ("diag", "spherical"):
            v = sq.reshape(k, p) / nk[:, None] - m * m + self.reg_covar
            if self.covariance_type == "spherical":
                v = np.repeat(v.mean(axis=1, keepdims=True), p, axis=1)
            self.covariances_ = v
            self.chols_ = 1 / np.sqrt(v)
            return
        c = sq.reshape(k, p, p) / nk[:, None, None] - np.einsum("ki,kj->kij", m, m)
        if self.covariance_type == "tied":
            c = np.tile((c * nk[:, None, None]).sum(axis=0) / nk.sum(), (k, 1, 1))
        self.covariances_ = c + self.reg_covar * np.eye(p)
        self.chols_ = np.array([np.linalg.inv(np.linalg.cholesky(v)).T for v in self.covariances_])

    def joint_arrays(self, x):
        return log_gaussian(x, self.means_, self.chols_) + np.log(self.weights_)

    def _responsible(self, m):
        j = self.joint_arrays(m)
        e = logsumexp(j)
        return np.exp(j - e[:, None]), e.sum()

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        data = df.select(*[F.col(c).cast("double").alias(c) for c in features]).persist()
        best = None
        for seed in range(self.n_init):
            if self.means_init is not None:
                c = np.array(self.means_init, float)
            else:
                x = gather(data.orderBy(F.xxhash64(*features)).limit(self.sample), features)
                c = KMeans(n_clusters=self.n_components, n_init=1, random_state=self.random_state + seed).fit_arrays(x).cluster_centers_

            def hard(m, c=c):
                at = ((m[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                return (at[:, None] == np.arange(len(c))).astype(float), 0.0

            n, _, nk, sums, sq = self._statistics(data, hard)
            self._maximise(n, nk, sums, sq)
            if self.means_init is not None:
                self.means_ = c
            if self.weights_init is not None:
                self.weights_ = np.array(self.weights_init, float)
            last, self.bounds_ = -math.inf, []
            for it in range(1, self.max_iter + 1):
                n, ll, nk, sums, sq = self._statistics(data, self._responsible)
                self.bounds_.append(float(self._bound(ll, n, nk)))
                self._maximise(n, nk, sums, sq)
                if abs(self.bounds_[-1] - last) < self.tol:
                    break
                last = self.bounds_[-1]
            state = {k: v for k, v in vars(self).items() if k.endswith("_")} | {"n_iter_": it, "lower_bound_": self.bounds_[-1]}
            best = state if best is None or state["lower_bound_"] > best["lower_bound_"] else best
        vars(self).update(best)
        data.unpersist()
        return self

    def _bound(self, ll, n, nk):
        return ll / n

    def proba_arrays(self, x):
        return self._responsible(x)[0]

    def predict_arrays(self, x):
        return self.joint_arrays(x).argmax(axis=1).astype(float)

    def score_samples(self, df, output="log_likelihood"):
        return score_column(df, self.features_, lambda x: logsumexp(self.joint_arrays(x)), output)

    def score(self, df):
        return float(self.score_samples(df).agg(F.avg("log_likelihood")).first()[0])

    def _parameters(self):
        p, k = len(self.features_), self.n_components
        cov = {"full": k * p * (p + 1) / 2, "tied": p * (p + 1) / 2, "diag": k * p, "spherical": k}[self.covariance_type]
        return cov + k * p + k - 1

    def aic(self, df):
        return -2 * self.score(df) * df.count() + 2 * self._parameters()

    def bic(self, df):
        n = df.count()
        return -2 * self.score(df) * n + self._parameters() * math.log(n)


class BayesianGaussianMixture(GaussianMixture):
    """Variational updates of the same sums; weights by a Dirichlet process or distribution."""

    params = {"weight_concentration_prior_type": "dirichletProcess", "weight_concentration_prior": None, "mean_precision_prior": 1.0, "degrees_of_freedom_prior": None}

    def fit(self, df, features, label=None):
        n, mean, s = gram(df, features)
        self.prior_mean_, self.prior_cov_ = mean, s / max(n - 1, 1)
        return super().fit(df, features)

    def _maximise(self, n, nk, sums, sq):
        k, p = sums.shape
        nk = nk + 10 * np.finfo(float).eps
        a0 = self.weight_concentration_prior or 1 / k
        b0, v0 = self.mean_precision_prior, self.degrees_of_freedom_prior or p
        if self.weight_concentration_prior_type == "dirichletProcess":
            self.concentration_ = np.array([1 + nk, a0 + np.append(np.cumsum(nk[::-1])[-2::-1], 0)])
            a, b = self.concentration_
            stick = a / (a + b)
            w = stick * np.append(1, np.cumprod(1 - stick)[:-1])
        else:
            self.concentration_ = a0 + nk
            w = self.concentration_ / self.concentration_.sum()
        xbar = sums / nk[:, None]
        self.mean_precision_ = b0 + nk
        self.means_ = (b0 * self.prior_mean_ + sums) / self.mean_precision_[:, None]
        self.dof_ = v0 + nk
        d = xbar - self.prior_mean_
        shift = nk * b0 / self.mean_precision_
        if self.covariance_type in ("diag", "spherical"):
            sk = sq.reshape(k, p) - nk[:, None] * xbar**2 + nk[:, None] * self.reg_covar
            self.covariances_ = (np.diag(self.prior_cov_) + sk + shift[:, None] * d * d) / self.dof_[:, None]
            self.chols_ = 1 / np.sqrt(self.covariances_)
        else:
            sk = sq.reshape(k, p, p) - nk[:, None, None] * np.einsum("ki,kj->kij", xbar, xbar) + nk[:, None, None] * self.reg_covar * np.eye(p)
            self.covariances_ = (self.prior_cov_ + sk + shift[:, None, None] * np.einsum("ki,kj->kij", d, d)) / self.dof_[:, None, None]
            self.chols_ = np.array([np.linalg.inv(np.linalg.cholesky(v)).T for v in self.covariances_])
        self.weights_ = w

    def joint_arrays(self, x):
        p = x.shape[1]
        lg = log_gaussian(x, self.means_, self.chols_) - 0.5 * p * np.log(self.dof_)
        lam = p * math.log(2) + digamma(0.5 * (self.dof_[:, None] - np.arange(p)).ravel()).reshape(len(self.means_), p).sum(axis=1)
        if self.weight_concentration_prior_type == "dirichletProcess":
            a, b = self.concentration_
            e, f, t = digamma(a), digamma(b), digamma(a + b)
            lw = e - t + np.append(0, np.cumsum(f - t)[:-1])
        else:
            lw = digamma(self.concentration_) - digamma(np.array([self.concentration_.sum()]))
        return lg + 0.5 * (lam - p / self.mean_precision_) + lw


# --- discriminant analysis ------------------------------------------------------------


def _class_sums(df, features, label):
    """Classes, counts, means and within-class sums of products."""
    p = len(features)
    classes = np.array(sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()))
    _, centre, _ = gram(df, features)

    def f(m):
        out = []
        for c in classes:
            x = m[m[:, p] == c][:, :p] - centre
            out.append(np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]))
        return np.concatenate(out)

    s = partial_sums(df, [*features, label], f).reshape(len(classes), -1)
    n, sums = s[:, 0], s[:, 1 : p + 1]
    within = s[:, p + 1 :].reshape(-1, p, p) - np.einsum("ki,kj->kij", sums, sums) / n[:, None, None]
    return classes, n, centre + sums / n[:, None], within


class LinearDiscriminantAnalysis(Classifier, Transformer, BaseEstimator):
    params = {"solver": "svd", "shrinkage": None, "priors": None, "n_components": None, "tol": 1e-4}

    def fit(self, df, features, label):
        if self.shrinkage is not None and self.solver != "eigen":
            raise ValueError("shrinkage needs the solver eigen")
        self.features_ = list(features)
        self.classes_, n, self.means_, within = _class_sums(df, features, label)
        k, p, total = len(n), len(features), n.sum()
        self.priors_ = n / total if self.priors is None else np.array(self.priors, float) / np.sum(self.priors)
        self.xbar_ = self.priors_ @ self.means_
        most = min(self.n_components or k - 1, k - 1, p)
        pooled = within.sum(axis=0)
        if self.solver == "svd":
            sd = np.sqrt(np.diag(pooled) / total)
            sd = np.where(sd > 0, sd, 1.0)
            v, u = np.linalg.eigh(pooled / np.outer(sd, sd) / (total - k))
            keep = np.sqrt(np.maximum(v, 0)) > self.tol
            white = (u[:, keep] / np.sqrt(v[keep])) / sd[:, None]
            between = np.sqrt(total * self.priors_ / (k - 1))[:, None] * (self.means_ - self.xbar_) @ white
            _, s, vt = np.linalg.svd(between, full_matrices=False)
            rank = int((s > self.tol * s[0]).sum()) if len(s) else 0
            self.scalings_ = white @ vt.T[:, :rank]
            self.explained_variance_ratio_ = (s**2 / max((s**2).sum(), 1e-300))[:most]
            z = (self.means_ - self.xbar_) @ self.scalings_
            self.intercept_ = -0.5 * (z * z).sum(axis=1) + np.log(self.priors_)
            self.coef_ = z @ self.scalings_.T
            self.intercept_ = self.intercept_ - self.xbar_ @ self.coef_.T
        else:
            cov = np.einsum("k,kij->ij", self.priors_, within / n[:, None, None])
            a = float(self.shrinkage or 0)
            cov = (1 - a) * cov + a * np.trace(cov) / p * np.eye(p)
            d = self.means_ - self.xbar_
            sb = np.einsum("k,ki,kj->ij", self.priors_, d, d)
            low = np.linalg.inv(np.linalg.cholesky(cov))
            v, u = np.linalg.eigh(low @ sb @ low.T)
            self.scalings_ = (low.T @ u)[:, ::-1]
            self.explained_variance_ratio_ = (v[::-1] / max(v.sum(), 1e-300))[:most]
            self.coef_ = np.linalg.solve(cov, self.means_.T).T
            self.intercept_ = -0.5 * (self.means_ * self.coef_).sum(axis=1) + np.log(self.priors_)
        self.most_ = most
        return self

    def decision_arrays(self, x):
        return x @ self.coef_.T + self.intercept_

    def proba_arrays(self, x):
        return softmax(self.decision_arrays(x))

    def transform_arrays(self, x):
        return ((x - self.xbar_) @ self.scalings_)[:, : self.most_]


LDA = LinearDiscriminantAnalysis


class QuadraticDiscriminantAnalysis(Classifier, BaseEstimator):
    params = {"priors": None, "reg_param": 0.0, "tol": 1e-4}

    def fit(self, df, features, label):
        self.features_ = list(features)
        self.classes_, n, self.means_, within = _class_sums(df, features, label)
        self.priors_ = n / n.sum() if self.priors is None else np.array(self.priors, float)
        self.values_, self.axes_ = [], []
        for k in range(len(n)):
            v, u = np.linalg.eigh(within[k] / (n[k] - 1))
            v = (1 - self.reg_param) * np.maximum(v, 0) + self.reg_param
            keep = v > (self.tol * np.sqrt(max(v.max(), 1e-300))) ** 2
            self.values_.append(v[keep])
            self.axes_.append(u[:, keep])
        return self

    def decision_arrays(self, x):
        out = np.empty((len(x), len(self.classes_)))
        for k, (m, v, u) in enumerate(zip(self.means_, self.values_, self.axes_, strict=True)):
            z = (x - m) @ u
            out[:, k] = -0.5 * ((z * z / v).sum(axis=1) + np.log(v).sum()) + math.log(self.priors_[k])
        return out

    def proba_arrays(self, x):
        return softmax(self.decision_arrays(x))


QDA = QuadraticDiscriminantAnalysis
