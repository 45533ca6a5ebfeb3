"""Covariance estimators from one Gram matrix, and robust ones."""

from __future__ import annotations

import math

import numpy as np

from quarry.operators.base import ArrayEstimator, BaseEstimator, OutlierDetector, score_column
from quarry.operators.linear import coordinate_descent
from quarry.plans.aggregate import gram, partial_sums


class EmpiricalCovariance(BaseEstimator):
    params = {"assume_centered": False}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        n, mean, s = gram(df, features)
        if self.assume_centered:
            s, mean = s + n * np.outer(mean, mean), np.zeros(len(mean))
        self.n_, self.location_ = n, mean
        self.covariance_ = self._estimate(df, n, mean, s / n)
        self.precision_ = np.linalg.pinv(self.covariance_, hermitian=True)
        return self

    def _estimate(self, df, n, mean, s):
        return s

    def mahalanobis_arrays(self, x):
        d = x - self.location_
        return np.einsum("ij,jk,ik->i", d, self.precision_, d)

    def mahalanobis(self, df, output="mahalanobis"):
        return score_column(df, self.features_, self.mahalanobis_arrays, output)

    def score(self, df) -> float:
        """Mean Gaussian log likelihood."""
        n, mean, s = gram(df, self.features_)
        d = mean - self.location_
        s = s / n + np.outer(d, d)
        p = len(mean)
        return float((-(s * self.precision_).sum() + np.linalg.slogdet(self.precision_)[1] - p * math.log(2 * math.pi)) / 2)

    def error_norm(self, other: np.ndarray) -> float:
        return float(((other - self.covariance_) ** 2).sum())


def shrink(s: np.ndarray, a: float) -> np.ndarray:
    return (1 - a) * s + a * np.trace(s) / len(s) * np.eye(len(s))


class ShrunkCovariance(EmpiricalCovariance):
    params = {"shrinkage": 0.1}

    def _estimate(self, df, n, mean, s):
        self.shrinkage_ = self.shrinkage
        return shrink(s, self.shrinkage)


class LedoitWolf(EmpiricalCovariance):
    """The shrinkage of least expected squared error; needs the mean of squared norms' squares: one pass more."""

    def _estimate(self, df, n, mean, s):
        p = len(mean)
        fourth = partial_sums(df, self.features_, lambda m: np.array([(((m - mean) ** 2).sum(axis=1) ** 2).sum()]))[0]
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        beta = min((fourth / n - (s * s).sum()) / (n * p), delta)
        self.shrinkage_ = 0.0 if beta <= 0 or delta == 0 else float(beta / delta)
        return shrink(s, self.shrinkage_)


class OAS(EmpiricalCovariance):
    def _estimate(self, df, n, mean, s):
        p = len(mean)
        alpha, mu2 = (s * s).mean(), (np.trace(s) / p) ** 2
        den = (n + 1) * (alpha - mu2 / p)
        self.shrinkage_ = 1.0 if den == 0 else float(min((alpha + mu2) / den, 1.0))
        return shrink(s, self.shrinkage_)


class GraphicalLasso(EmpiricalCovariance):
    params = {"alpha": 0.01, "max_iter": 100, "tol": 1e-4, "enet_tol": 1e-4}

    def _estimate(self, df, n, mean, s):
        p = len(s)
        w, beta = s.copy(), np.zeros((p, p))
        self.costs_ = []
        for _ in range(self.max_iter):
            for j in range(p):
                rest = np.arange(p) != j
                b = coordinate_descent(w[np.ix_(rest, rest)], s[rest, j], self.alpha, 0.0, 1000, self.enet_tol * 1e-3)
                beta[rest, j] = b
                w[rest, j] = w[j, rest] = w[np.ix_(rest, rest)] @ b
            prec = np.zeros((p, p))
            for j in range(p):
                rest = np.arange(p) != j
                prec[j, j] = 1 / (w[j, j] - w[rest, j] @ beta[rest, j])
                prec[rest, j] = -prec[j, j] * beta[rest, j]
            prec = (prec + prec.T) / 2
            gap = (s * prec).sum() - p + self.alpha * (np.abs(prec).sum() - np.abs(np.diag(prec)).sum())
            self.costs_.append(float(gap))
            if abs(gap) < self.tol:
                break
        return w


class MinCovDet(ArrayEstimator):
    """The subset of least covariance determinant by concentration steps from random starts, then reweighted."""

    params = {"support_fraction": None, "random_state": 0, "assume_centered": False}

    def _step(self, x, who):
        m = np.zeros(x.shape[1]) if self.assume_centered else x[who].mean(axis=0)
        d = x[who] - m
        return m, d.T @ d / len(who)

    def _distance(self, x, m, c):
        d = x - m
        return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(c, hermitian=True), d)

    def fit_arrays(self, x, y=None, w=None):
        rng, (n, p) = np.random.default_rng(self.random_state), x.shape
        h = math.ceil((n + p + 1) / 2) if self.support_fraction is None else int(self.support_fraction * n)

        def concentrate(who, steps):
            det = math.inf
            for _ in range(steps):
                m, c = self._step(x, who)
                who = np.argsort(self._distance(x, m, c), kind="stable")[:h]
                new = np.linalg.slogdet(self._step(x, who)[1])[1]
                if new >= det - 1e-12:
                    break
                det = new
            return det, who

        starts = [concentrate(rng.permutation(n)[: p + 1], 2) for _ in range(30 if n > 500 else 100)]
        starts.sort(key=lambda t: t[0])
        _, who = min((concentrate(s[1], 100) for s in starts[:10]), key=lambda t: t[0])
        m, c = self._step(x, who)
        d = self._distance(x, m, c)
        self.raw_location_, self.raw_covariance_ = m, c * (np.median(d) / chi2_quantile(p, 0.5))
        self.support_ = self._distance(x, m, self.raw_covariance_) < chi2_quantile(p, 0.975)
        self.location_, self.covariance_ = self._step(x, np.flatnonzero(self.support_))
        self.precision_ = np.linalg.pinv(self.covariance_, hermitian=True)
        return self

    mahalanobis_arrays = EmpiricalCovariance.mahalanobis_arrays
    mahalanobis = EmpiricalCovariance.mahalanobis


def chi2_quantile(k: int, p: float) -> float:
    from quarry.operators.feature_selection import gamma_q

    lo, hi = 0.0, k + 40 * math.sqrt(2 * k) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - gamma_q(k / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


class EllipticEnvelope(OutlierDetector, MinCovDet):
    """-1 for the share `contamination` of rows that lie farthest out."""

    params = {"contamination": 0.1}

    def fit_arrays(self, x, y=None, w=None):
        super().fit_arrays(x)
        self.offset_ = float(np.quantile(-self.mahalanobis_arrays(x), self.contamination))
        return self

    def decision_arrays(self, x):
        return -self.mahalanobis_arrays(x) - self.offset_

    def predict_arrays(self, x):
        return np.where(self.decision_arrays(x) >= 0, 1.0, -1.0)
