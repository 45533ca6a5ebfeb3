"""Linear models.

Least-squares models need one pass for the Gram matrix; iterative ones one pass of
partial sums for each step.  Only the small SGD family is sequential by nature
and takes its rows on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.base import ArrayEstimator, BaseEstimator, Classifier, Regressor, classes_of
from quarry.plans.aggregate import gram, partial_sums


class _Linear(Regressor, BaseEstimator):
    """Predictions coef . x + intercept, as a generated expression."""

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        c = sum((F.col(f).cast("double") * float(w) for f, w in zip(self.features_, self.coef_, strict=True)), F.lit(float(self.intercept_)))
        return df.withColumn(output, self._mean(c))

    def _mean(self, c):
        return c

    def predict_arrays(self, x):
        return x @ self.coef_ + self.intercept_

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None):
        self.features_ = list(features)
        n, mean, s = gram(df, [*features, label], weight)
        self._solve(n, mean, s)
        return self

    def fit_arrays(self, x, y, w=None):
        w = np.ones(len(y)) if w is None else w
        m = np.column_stack([x, y])
        mean = (m * w[:, None]).sum(axis=0) / w.sum()
        d = m - mean
        self._solve(w.sum(), mean, (d * w[:, None]).T @ d)
        return self

    def _centred(self, n, mean, s):
        """X'X, X'y, y'y and means, of deviations unless fit_intercept is off."""
        if not getattr(self, "fit_intercept", True):
            s, mean = s + n * np.outer(mean, mean), np.zeros_like(mean)
        return s[:-1, :-1], s[:-1, -1], s[-1, -1], mean

    def _finish(self, coef, mean):
        self.coef_ = np.asarray(coef)
        self.intercept_ = float(mean[-1] - mean[:-1] @ self.coef_)


class LinearRegression(_Linear):
    def _solve(self, n, mean, s):
        a, b, _, mean = self._centred(n, mean, s)
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        if n <= len(b) or np.linalg.cond(a / np.outer(scale, scale)) > 1e13:
            raise ValueError("the columns are collinear")
        self._finish(np.linalg.solve(a / np.outer(scale, scale), b / scale) / scale, mean)


class RidgeRegression(_Linear):
    params = {"alpha": 1.0, "fit_intercept": True}

    def _solve(self, n, mean, s):
        a, b, _, mean = self._centred(n, mean, s)
        self._finish(np.linalg.solve(a + self.alpha * np.eye(len(b)), b), mean)


class Ridge(RidgeRegression):
    pass


def coordinate_descent(a: np.ndarray, b: np.ndarray, l1: float, l2: float, max_iter: int, tol: float) -> np.ndarray:
    """Minimises w'aw/2 - b'w + l1 |w|_1 + l2/2 |w|^2 from the Gram form, one coordinate after another."""
    w = np.zeros(len(b))
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(b)):
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            down = a[j, j] + l2
            new = math.copysign(max(abs(rest) - l1, 0.0), rest) / down if down else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    return w


class LassoRegression(_Linear):
    params = {"alpha": 1.0, "fit_intercept": True, "max_iter": 1000, "tol": 1e-6}

    def _solve(self, n, mean, s):
        a, b, _, mean = self._centred(n, mean, s)
        self._finish(coordinate_descent(a / n, b / n, self.alpha, 0.0, self.max_iter, self.tol), mean)


class Lasso(LassoRegression):
    pass


class ElasticNet(_Linear):
    params = {"alpha": 1.0, "l1_ratio": 0.5, "fit_intercept": True, "max_iter": 1000, "tol": 1e-6}

    def _solve(self, n, mean, s):
        a, b, _, mean = self._centred(n, mean, s)
        if self.l1_ratio == 0:
            w = np.linalg.solve(a + n * self.alpha * np.eye(len(b)), b)
        else:
            w = coordinate_descent(a / n, b / n, self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio), self.max_iter, self.tol)
        self._finish(w, mean)


class PolynomialRegression(_Linear):
    """Powers of each column up to degree, without cross terms."""

    params = {"degree": 2}

    def fit(self, df, features, label, weight=None):
        powers = {f"__{c}_{d}": F.col(c).cast("double") ** d for c in features for d in range(1, self.degree + 1)}
        super().fit(df.withColumns(powers), list(powers), label, weight)
        self.features_ = list(features)
        return self

    _solve = LinearRegression._solve

    def predict(self, df, output="prediction"):
        terms = [F.col(c).cast("double") ** d for c in self.features_ for d in range(1, self.degree + 1)]
        return df.withColumn(output, sum((t * float(w) for t, w in zip(terms, self.coef_, strict=True)), F.lit(self.intercept_)))


class RidgeClassifier(Classifier, BaseEstimator):
    """A ridge regression on +1/-1 for each class, all from one Gram matrix."""

    params = {"alpha": 1.0, "fit_intercept": True}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        self.classes_ = np.array(sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()))
        marks = {f"__y{i}": F.when(F.col(label) == float(c), 1.0).otherwise(-1.0) for i, c in enumerate(self.classes_)}
        n, mean, s = gram(df.withColumns(marks), [*features, *marks], weight)
        p = len(features)
        if not self.fit_intercept:
            s, mean = s + n * np.outer(mean, mean), np.zeros_like(mean)
        self.coef_ = np.linalg.solve(s[:p, :p] + self.alpha * np.eye(p), s[:p, p:]).T
        self.intercept_ = mean[p:] - self.coef_ @ mean[:p]
        return self

    def decision_arrays(self, x):
        return x @ self.coef_.T + self.intercept_

    def predict_arrays(self, x):
        return self.classes_[self.decision_arrays(x).argmax(axis=1)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class LogisticRegression(Classifier, BaseEstimator):
    """Gradient descent from zeros with a fixed number of steps; each is one pass over the rows.

    solver 'newton' goes to the optimum instead (two classes).
    """

    params = {"learning_rate": 0.1, "max_iter": 1000, "c": None, "solver": "gd", "tol": 1e-8}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        classes = sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect())
        df = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__y")).persist()
        try:
            self._descend(len(features), np.array(classes), lambda kernel: partial_sums(df, [*features, "__y"], kernel))
        finally:
            df.unpersist()
        return self

    def fit_arrays(self, x, y, w=None):
        m = np.column_stack([x, y])
        self._descend(x.shape[1], np.unique(y), lambda kernel: np.asarray(kernel(m)).ravel())
        return self

    def _descend(self, p, classes, sums):
        self.classes_ = classes
        k = 1 if len(classes) == 2 else len(classes)
        theta = np.zeros((k, p + 1))

        def step(m, theta):
            x = np.column_stack([m[:, :p], np.ones(len(m))])
            if k == 1:
                e = 1 / (1 + np.exp(-x @ theta[0])) - (m[:, p] == classes[1])
                return np.concatenate([[len(m)], x.T @ e])
            e = softmax(x @ theta.T) - (m[:, p][:, None] == classes[None])
            return np.concatenate([[len(m)], (e.T @ x).ravel()])

        if self.solver == "newton" and k == 1:
            ridge = 1 / self.c if self.c else 0.0

            def second(m, theta):
                x = np.column_stack([m[:, :p], np.ones(len(m))])
                q = 1 / (1 + np.exp(-x @ theta[0]))
                return np.concatenate([x.T @ (q - (m[:, p] == classes[1])), ((x * (q * (1 - q))[:, None]).T @ x).ravel()])

            for _ in range(100):
                s = sums(lambda m, t=theta.copy(): second(m, t))
                pen = np.append(np.full(p, ridge), 0.0)
                move = np.linalg.lstsq(s[p + 1 :].reshape(p + 1, p + 1) + np.diag(pen), s[: p + 1] + pen * theta[0], rcond=None)[0]
                theta[0] -= move
                if np.abs(move).max() < self.tol:
                    break
        else:
            for _ in range(self.max_iter):
                s = sums(lambda m, t=theta.copy(): step(m, t))
                g = s[1:].reshape(k, p + 1) / s[0]
                if self.c:  # the penalty as an implicit step
                    theta = theta - self.learning_rate * g
                    theta[:, :p] /= 1 + self.learning_rate / (self.c * s[0])
                else:
                    theta = theta - self.learning_rate * g
        self.coef_, self.intercept_ = theta[:, :p], theta[:, p]
        if k == 1:
            self.coef_ = self.coef_[0]

    def decision_arrays(self, x):
        return x @ self.coef_ + self.intercept_[0] if self.coef_.ndim == 1 else x @ self.coef_.T + self.intercept_

    def proba_arrays(self, x):
        z = self.decision_arrays(x)
        if z.ndim == 1:
            p = 1 / (1 + np.exp(-z))
            return np.column_stack([1 - p, p])
        return softmax(z)


class BayesianRidge(_Linear):
    """Evidence maximisation on the eigenvalues of one Gram matrix."""

    params = {"max_iter": 300, "tol": 1e-3, "alpha1": 1e-6, "alpha2": 1e-6, "lambda1": 1e-6, "lambda2": 1e-6, "fit_intercept": True}

    def _solve(self, n, mean, s):
        a, b, yy, mean = self._centred(n, mean, s)
        ev, u = np.linalg.eigh(a)
        ev = np.maximum(ev, 0)
        noise, lam = n / max(yy, 1e-300), 1.0
        old = None
        for _ in range(self.max_iter):
            w = u @ ((u.T @ b) / (ev + lam / noise))
            error = max(yy - 2 * b @ w + w @ a @ w, 0)
            gamma = float((noise * ev / (lam + noise * ev)).sum())
            lam = (gamma + 2 * self.lambda1) / (w @ w + 2 * self.lambda2)
            noise = (n - gamma + 2 * self.alpha1) / (error + 2 * self.alpha2)
            if old is not None and np.abs(old - w).sum() < self.tol:
                break
            old = w
        self.alpha_, self.lambda_ = float(noise), float(lam)
        self.sigma_ = u @ np.diag(1 / (lam + noise * ev)) @ u.T
        self.mean_ = mean[:-1]
        self._finish(u @ ((u.T @ b) / (ev + lam / noise)), mean)

    def std_arrays(self, x):
        d = x - self.mean_
        return np.sqrt(np.einsum("ij,jk,ik->i", d, self.sigma_, d) + 1 / self.alpha_)


class ARDRegression(_Linear):
    """A precision for each column; columns above the threshold are dropped."""

    params = {"max_iter": 300, "tol": 1e-3, "alpha1": 1e-6, "alpha2": 1e-6, "lambda1": 1e-6, "lambda2": 1e-6, "threshold_lambda": 1e4, "fit_intercept": True}

    def _solve(self, n, mean, s):
        a, b, yy, mean = self._centred(n, mean, s)
        p = len(b)
        lam, noise, keep, w = np.ones(p), n / max(yy, 1e-300), np.ones(p, bool), np.zeros(p)
        for _ in range(self.max_iter):
            old = w.copy()
            sigma = np.linalg.inv(noise * a[np.ix_(keep, keep)] + np.diag(lam[keep]))
            w = np.zeros(p)
            w[keep] = noise * sigma @ b[keep]
            gamma = 1 - lam[keep] * np.diag(sigma)
            error = max(yy - 2 * b @ w + w @ a @ w, 0)
            lam[keep] = (gamma + 2 * self.lambda1) / (w[keep] ** 2 + 2 * self.lambda2)
            noise = (n - gamma.sum() + 2 * self.alpha1) / (error + 2 * self.alpha2)
            keep = lam < self.threshold_lambda
            w[~keep] = 0
            if np.abs(old - w).sum() < self.tol or not keep.any():
                break
        self.lambda_, self.alpha_ = lam, float(noise)
        self._finish(w, mean)


class TweedieRegressor(_Linear):
    """Newton steps with halving on half the mean unit deviance plus alpha/2 |w|^2; each evaluation is one pass."""

    params = {"power": 0.0, "alpha": 1.0, "fit_intercept": True, "link": "auto", "max_iter": 100, "tol": 1e-4}

    def _log(self):
        return self.link == "log" or (self.link == "auto" and self.power > 0)

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        p, power, log = len(features), self.power, self._log()
        cols = [*features, label, *([weight] if weight else [])]
        df = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()

        def kernel(m, t):
            x = np.column_stack([m[:, :p], np.full(len(m), float(self.fit_intercept))])
            y, w = m[:, p], (m[:, p + 1] if weight else np.ones(len(m)))
            eta = x @ t
            mu = np.exp(np.clip(eta, -500, 500)) if log else eta
            d1 = mu if log else np.ones_like(mu)
            with np.errstate(all="ignore"):
                dev = w * _half_deviance(y, mu, power)
                g = w * (mu - y) * mu**-power * d1
                h = w * mu**-power * d1 * d1
            return np.concatenate([[w.sum(), dev.sum()], x.T @ g, ((x * h[:, None]).T @ x).ravel()])

        theta = np.zeros(p + 1)
        first = partial_sums(df, cols, lambda m: np.array([(m[:, p + 1] if weight else np.ones(len(m))).sum(), (m[:, p] * (m[:, p + 1] if weight else 1)).sum()]))
        if self.fit_intercept:
            theta[p] = math.log(max(first[1] / first[0], 1e-10)) if log else first[1] / first[0]
        pen = np.append(np.full(p, self.alpha), 0.0)
        at = lambda t: partial_sums(df, cols, lambda m, t=t.copy(): kernel(m, t))
        s = at(theta)
        loss = s[1] / s[0] + pen @ theta**2 / 2
        for _ in range(self.max_iter):
            g = s[2 : p + 3] / s[0] + pen * theta
            if np.abs(g).max() <= self.tol:
                break
            h = s[p + 3 :].reshape(p + 1, p + 1) / s[0] + np.diag(pen)
            move = np.linalg.lstsq(h, g, rcond=None)[0]
            for k in range(20):
                new = theta - move * 0.5**k
                s2 = at(new)
                new_loss = s2[1] / s2[0] + pen @ new**2 / 2
                if np.isfinite(new_loss) and new_loss <= loss + 1e-15 * abs(loss):
                    break
            if not new_loss <= loss:
                break
            theta, s, loss = new, s2, new_loss
        df.unpersist()
        self.coef_, self.intercept_ = theta[:p], float(theta[p])
        return self

    def _mean(self, c):
        return F.exp(c) if self._log() else c

    def predict_arrays(self, x):
        eta = x @ self.coef_ + self.intercept_
        return np.exp(eta) if self._log() else eta


def _half_deviance(y, mu, p):
    if p == 0:
        return (y - mu) ** 2 / 2
    if p == 1:
        return np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - y + mu
    if p == 2:
        return np.log(mu / y) + y / mu - 1
    return np.maximum(y, 0) ** (2 - p) / ((1 - p) * (2 - p)) - y * mu ** (1 - p) / (1 - p) + mu ** (2 - p) / (2 - p)


class PoissonRegressor(TweedieRegressor):
    params = {"power": 1.0}


class GammaRegressor(TweedieRegressor):
    params = {"power": 2.0}


class HuberRegressor(_Linear):
    """Joint fit of coefficients and scale; Newton-like reweighting, one pass for each step."""

    params = {"epsilon": 1.35, "max_iter": 100, "alpha": 1e-4, "tol": 1e-5, "fit_intercept": True}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        p, eps = len(features), self.epsilon
        cols = [*features, label]
        start = RidgeRegression(alpha=max(self.alpha, 1e-8), fit_intercept=self.fit_intercept).fit(df, features, label)
        theta = np.append(start.coef_, start.intercept_)
        df = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()

        def kernel(m, t, sigma):
            x = np.column_stack([m[:, :p], np.full(len(m), float(self.fit_intercept))])
            r = m[:, p] - x @ t
            far = np.abs(r) > eps * sigma
            w = np.where(far, eps * sigma / np.maximum(np.abs(r), 1e-300), 1.0)
            return np.concatenate([[len(m), far.sum(), (r[~far] ** 2).sum()], x.T @ (w * m[:, p]), ((x * w[:, None]).T @ x).ravel()])

        sigma = float(df.agg(F.stddev_pop(label)).first()[0] or 1.0)
        for _ in range(self.max_iter * 5):
            s = partial_sums(df, cols, lambda m, t=theta.copy(), g=sigma: kernel(m, t, g))
            near = max(s[0] - s[1] * eps * eps, 1e-12)
            new_sigma = math.sqrt(max(s[2] / near, 1e-20))  # stationary scale of n s + sum of squares / s + linear tails
            pen = np.append(np.full(p, self.alpha * sigma), 0 if self.fit_intercept else 1.0)
            new = np.linalg.solve(s[p + 4 :].reshape(p + 1, p + 1) + np.diag(pen), s[3 : p + 4])
            done = np.abs(new - theta).max() < self.tol * 1e-2 and abs(new_sigma - sigma) < self.tol * 1e-2
            theta, sigma = new, new_sigma
            if done:
                break
        df.unpersist()
        self.coef_, self.intercept_, self.scale_ = theta[:p], float(theta[p]), sigma
        return self


class QuantileRegressor(_Linear):
    """Pinball loss plus alpha |w|_1, by smoothed reweighting: one pass for each step."""

    params = {"quantile": 0.5, "alpha": 1.0, "fit_intercept": True, "max_iter": 200, "tol": 1e-7}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        p, q = len(features), self.quantile
        cols = [*features, label]
        df = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()
        theta = np.zeros(p + 1)
        if self.fit_intercept:
            theta[p] = df.agg(F.percentile(label, q)).first()[0]
        scale = float(df.agg(F.stddev_pop(label)).first()[0] or 1.0)
        eps = scale * 0.1

        def kernel(m, t, eps):
            x = np.column_stack([m[:, :p], np.full(len(m), float(self.fit_intercept))])
            r = m[:, p] - x @ t
            w = 1 / (2 * np.maximum(np.abs(r), eps))  # |r| as a parabola through the last residual
            return np.concatenate([[len(m)], x.T @ (w * m[:, p] + (q - 0.5)), ((x * w[:, None]).T @ x).ravel()])

        for _ in range(self.max_iter):
            s = partial_sums(df, cols, lambda m, t=theta.copy(), e=eps: kernel(m, t, e))
            n = s[0]
            pen = np.append(self.alpha * n / np.maximum(np.abs(theta[:p]), 1e-9), 0 if self.fit_intercept else 1.0)
            new = np.linalg.solve(s[p + 2 :].reshape(p + 1, p + 1) + np.diag(pen), s[1 : p + 2])
            moved = np.abs(new - theta).max()
            theta = new
            if eps <= scale * 1e-8 and moved < self.tol * max(1, np.abs(theta).max()):
                break
            eps = max(eps * 0.7, scale * 1e-8)
        df.unpersist()
        theta[:p][np.abs(theta[:p]) < 1e-7] = 0
        self.coef_, self.intercept_ = theta[:p], float(theta[p])
        return self


class RANSACRegressor(Regressor, ArrayEstimator):
    params = {"estimator": None, "min_samples": None, "residual_threshold": None, "max_trials": 100, "stop_probability": 0.99, "random_state": 0}

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        base = self.estimator or LinearRegression()
        size = self.min_samples or x.shape[1] + 1
        limit = self.residual_threshold if self.residual_threshold is not None else np.median(np.abs(y - np.median(y)))
        best, trials, k = None, self.max_trials, 0
        while k < trials:
            k += 1
            try:
                pick = rng.choice(len(y), size, replace=False)
                res = np.abs(y - base.clone().fit_arrays(x[pick], y[pick]).predict_arrays(x))
            except (ValueError, np.linalg.LinAlgError):
                continue
            inl = res <= limit
            key = (inl.sum(), -res[inl].sum())
            if best is None or key > best[0]:
                best = (key, inl)
                share = inl.mean() ** size
                if 0 < share < 1:
                    trials = min(self.max_trials, math.ceil(math.log(1 - self.stop_probability) / math.log(1 - share)))
                elif share == 1:
                    break
        if best is None or best[0][0] < size:
            raise ValueError("no consensus was found")
        self.inlier_mask_ = best[1]
        self.estimator_ = base.clone().fit_arrays(x[best[1]], y[best[1]])
        return self

    def predict_arrays(self, x):
        return self.estimator_.predict_arrays(x)


class TheilSenRegressor(Regressor, ArrayEstimator):
    """The spatial median of least-squares fits to random subsets."""

    params = {"fit_intercept": True, "max_subpopulation": 10_000, "n_subsamples": None, "max_iter": 300, "tol": 1e-3, "random_state": 0}

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        a = np.column_stack([x, np.ones(len(y))]) if self.fit_intercept else x
        size = self.n_subsamples or a.shape[1]
        fits = []
        if math.comb(len(y), size) <= self.max_subpopulation:
            import itertools

            picks = itertools.combinations(range(len(y)), size)
        else:
            picks = (rng.choice(len(y), size, replace=False) for _ in range(self.max_subpopulation))
        for s in picks:
            s = list(s)
            fits.append(np.linalg.lstsq(a[s], y[s], rcond=None)[0])
        fits = np.array(fits)
        m = np.median(fits, axis=0)
        for _ in range(self.max_iter):
            d = np.maximum(np.linalg.norm(fits - m, axis=1), 1e-12)
            new = (fits / d[:, None]).sum(axis=0) / (1 / d).sum()
            done = np.linalg.norm(new - m) < self.tol * 1e-3
            m = new
            if done:
                break
        self.coef_, self.intercept_ = (m[:-1], float(m[-1])) if self.fit_intercept else (m, 0.0)
        return self

    def predict_arrays(self, x):
        return x @ self.coef_ + self.intercept_


# --- stochastic gradient descent ------------------------------------------------


def plain_sgd(x, y, loss_grad, *, penalty, alpha, l1_ratio, fit_intercept, max_iter, tol, shuffle, learning_rate, eta0, power_t, n_iter_no_change, rng, w=None):
    """One weight vector by rows in turn; l1 is applied as a cumulative penalty."""
    n, p = x.shape
    coef, b, t = np.zeros(p), 0.0, 1.0
    l2 = {"l2": 1.0, "l1": 0.0, "elasticnet": 1 - l1_ratio, None: 0.0}[penalty] * alpha
    l1 = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, None: 0.0}[penalty] * alpha
    typical = math.sqrt(1 / math.sqrt(alpha)) if alpha else 1.0
    offset = 1 / (typical / max(1.0, abs(float(loss_grad(-typical, 1.0)[1]))) * alpha) if learning_rate == "optimal" and alpha else 1.0
    eta, best, idle, u, q = eta0, math.inf, 0, 0.0, np.zeros(p)
    order = np.arange(n)
    for _ in range(max_iter):
        if shuffle:
            rng.shuffle(order)
        total = 0.0
        for i in order:
            z = float(x[i] @ coef + b)
            loss, g = loss_grad(z, y[i])
            weight = 1.0 if w is None else w[i]
            total += loss * weight
            if learning_rate == "optimal":
                eta = 1 / (alpha * (offset + t - 1)) if alpha else eta0
            elif learning_rate == "invscaling":
                eta = eta0 / t**power_t
            g = min(max(g, -1e12), 1e12) * weight
            coef *= max(0.0, 1 - eta * l2)
            if g:
                coef -= eta * g * x[i]
                if fit_intercept:
                    b -= eta * g
            if l1:
                u += eta * l1
                old = coef.copy()
                coef = np.where(old > 0, np.maximum(0, old - (u + q)), np.where(old < 0, np.minimum(0, old + (u - q)), old))
                q += coef - old
            t += 1
        mean = total / n
        idle = idle + 1 if mean > best - tol else 0
        best = min(best, mean)
        if idle >= n_iter_no_change:
            if learning_rate == "adaptive" and eta > 1e-6:
                eta, idle = eta / 5, 0
            else:
                break
    return coef, b


def _classification_loss(name):
    def f(z, y):
        m = z * y
        if name == "hinge":
            return (1 - m, -y) if m < 1 else (0.0, 0.0)
        if name == "perceptron":
            return (-m, -y) if m <= 0 else (0.0, 0.0)
        if name == "squaredHinge":
            return ((1 - m) ** 2, -2 * y * (1 - m)) if m < 1 else (0.0, 0.0)
        if name == "modifiedHuber":
            return (0.0, 0.0) if m >= 1 else ((1 - m) ** 2, -2 * y * (1 - m)) if m >= -1 else (-4 * m, -4 * y)
        e = math.exp(-m) if m > -30 else math.inf
        return (math.log1p(e) if e < math.inf else -m), -y * (1 - 1 / (1 + e) if e < math.inf else 1.0)

    return f


def _regression_loss(name, eps):
    def f(z, y):
        r = z - y
        if name == "squaredError":
            return r * r / 2, r
        if name == "huber":
            return (r * r / 2, r) if abs(r) <= eps else (eps * abs(r) - eps * eps / 2, math.copysign(eps, r))
        over = abs(r) - eps
        if name == "epsilonInsensitive":
            return (over, math.copysign(1, r)) if over > 0 else (0.0, 0.0)
        return (over * over, 2 * math.copysign(over, r)) if over > 0 else (0.0, 0.0)

    return f


_SGD = {"penalty": "l2", "alpha": 1e-4, "l1_ratio": 0.15, "fit_intercept": True, "max_iter": 1000, "tol": 1e-3, "shuffle": True, "random_state": 0, "n_iter_no_change": 5}


class _SGD_:
    def _run(self, x, y, loss, w):
        keys = ("penalty", "alpha", "l1_ratio", "fit_intercept", "max_iter", "tol", "shuffle", "learning_rate", "eta0", "power_t", "n_iter_no_change")
        return plain_sgd(x, y, loss, rng=np.random.default_rng(self.random_state), w=w, **{k: getattr(self, k) for k in keys})


class SGDClassifier(_SGD_, Classifier, ArrayEstimator):
    params = {**_SGD, "loss": "hinge", "learning_rate": "optimal", "eta0": 0.0, "power_t": 0.5}

    def fit_arrays(self, x, y, w=None):
        self.classes_ = np.unique(y)
        loss = _classification_loss(self.loss)
        shown = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        got = [self._run(x, np.where(y == c, 1.0, -1.0), loss, w) for c in shown]
        self.coef_, self.intercept_ = np.array([c for c, _ in got]), np.array([b for _, b in got])
        return self

    def decision_arrays(self, x):
        z = x @ self.coef_.T + self.intercept_
        return z[:, 0] if z.shape[1] == 1 else z

    def predict_arrays(self, x):
        z = self.decision_arrays(x)
        return self.classes_[(z > 0).astype(int)] if z.ndim == 1 else self.classes_[z.argmax(axis=1)]

    def proba_arrays(self, x):
        z = np.atleast_2d(self.decision_arrays(x).T).T
        p = 1 / (1 + np.exp(-z))
        if p.shape[1] == 1:
            return np.column_stack([1 - p, p])
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.maximum(total, 1e-300), 1 / p.shape[1])


class Perceptron(SGDClassifier):
    params = {"loss": "perceptron", "penalty": None, "learning_rate": "constant", "eta0": 1.0}


class SGDRegressor(_SGD_, Regressor, ArrayEstimator):
    params = {**_SGD, "loss": "squaredError", "epsilon": 0.1, "learning_rate": "invscaling", "eta0": 0.01, "power_t": 0.25}

    def fit_arrays(self, x, y, w=None):
        self.coef_, self.intercept_ = self._run(x, y, _regression_loss(self.loss, self.epsilon), w)
        return self

    def predict_arrays(self, x):
        return x @ self.coef_ + self.intercept_


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and not n.startswith("_")] + ["classes_of"]
