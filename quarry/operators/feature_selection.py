"""Univariate scores as aggregates, and selectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.base import BaseEstimator, Transformer, importances, resolve_subset_size
from quarry.plans.aggregate import class_moments


def select_columns(df: DataFrame, features: list[str], kept: list[int]) -> DataFrame:
    return df.drop(*[c for i, c in enumerate(features) if i not in set(kept)])


def f_regression(df: DataFrame, features: list[str], label: str) -> np.ndarray:
    """F = r2 / (1 - r2) (n - 2) for each column; 0 where constant, infinite where perfect."""
    y = F.col(label).cast("double")
    row = df.agg(F.count("*").alias("n"), *[F.corr(F.col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        r = row[f"r{i}"]
        r2 = 0.0 if r is None or math.isnan(r) else r * r
        out.append(math.inf if r2 >= 1 else r2 / (1 - r2) * (row.n - 2))
    return np.array(out)


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def f_survival(f: float, d1: float, d2: float) -> float:
    return 0.0 if math.isinf(f) else 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores and p-values of counts by class against what the class shares would give."""
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)]).collect()
    n = np.array([r.n for r in rows], float)
    seen = np.array([[r[f"s{i}"] for i in range(len(features))] for r in rows])
    want = np.outer(n / n.sum(), seen.sum(axis=0))
    with np.errstate(all="ignore"):
        s = ((seen - want) ** 2 / want).sum(axis=0)
    return s, np.array([math.nan if math.isnan(v) else gamma_q((len(n) - 1) / 2, v / 2) for v in s])


def f_classif(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """One-way analysis of variance from class moments."""
    rows = class_moments(df, features, label).collect()
    n = np.array([r.n for r in rows], float)
    m = np.array([[r[f"mean_{i}"] for i in range(len(features))] for r in rows])
    v = np.array([[r[f"var_{i}"] for i in range(len(features))] for r in rows])
    grand = (n[:, None] * m).sum(axis=0) / n.sum()
    d1, d2 = len(n) - 1, n.sum() - len(n)
    with np.errstate(all="ignore"):
        f = (n[:, None] * (m - grand) ** 2).sum(axis=0) / d1 / ((n[:, None] * v).sum(axis=0) / d2)
    return f, np.array([math.nan if math.isnan(x) else f_survival(x, d1, d2) for x in f])


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def mutual_info_discrete(df: DataFrame, feature: str, label: str) -> DataFrame:
    from quarry.operators.metrics import mutual_info_score

    return mutual_info_score(df, feature, label)


def _within(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many values lie closer to each value than its radius, itself included."""
    s = np.sort(x)
    return np.searchsorted(s, x + r, side="left") - np.searchsorted(s, x - r, side="right")


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each value to its k-th nearest other value."""
    o = np.argsort(x, kind="stable")
    s = x[o]
    pad = np.concatenate([np.full(k, -np.inf), s, np.full(k, np.inf)])
    d = np.stack([np.maximum(s - pad[i : i + len(s)], pad[i + k : i + k + len(s)] - s) for i in range(k + 1)])
    out = np.empty_like(s)
    out[o] = np.nanmin(d, axis=0)
    return out


def _kth_in_plane(v: np.ndarray, t: np.ndarray, k: int, cell: int = 32) -> np.ndarray:
    """Distance (largest coordinate) of each point to its k-th nearest other one.

    Strips of v are cut into cells of t; the k-th distance within a cell bounds how far around it to look.
    """
    n, cell = len(v), max(cell, k + 1)
    out = np.empty(n)
    strip = max(cell, int(np.sqrt(n * cell)))
    by_v = np.argsort(v, kind="stable")
    strips = [by_v[s : s + strip] for s in range(0, n, strip)]
    strips = [s[np.argsort(t[s], kind="stable")] for s in strips]
    low, high = np.array([v[s].min() for s in strips]), np.array([v[s].max() for s in strips])
    vs, ts = [v[s] for s in strips], [t[s] for s in strips]
    for h, points in enumerate(strips):
        for c in range(0, len(points), cell):
            a, b = vs[h][c : c + cell], ts[h][c : c + cell]
            if len(a) > k:
                d = np.maximum(np.abs(a[:, None] - a[None]), np.abs(b[:, None] - b[None]))
                far = float(np.partition(d, k, axis=1)[:, k].max()) * (1 + 1e-12)
            else:
                far = np.inf
            cv, ct = [], []
            for g in range(int(np.searchsorted(high, a.min() - far)), int(np.searchsorted(low, a.max() + far, side="right"))):
                i, j = np.searchsorted(ts[g], b.min() - far), np.searchsorted(ts[g], b.max() + far, side="right")
                cv.append(vs[g][i:j])
                ct.append(ts[g][i:j])
            cv, ct = np.concatenate(cv), np.concatenate(ct)
            inside = (cv >= a.min() - far) & (cv <= a.max() + far)
            cv, ct = cv[inside], ct[inside]
            d = np.maximum(np.abs(a[:, None] - cv[None]), np.abs(b[:, None] - ct[None]))
            out[points[c : c + cell]] = np.partition(d, k, axis=1)[:, k]
    return out


def mutual_info_arrays(x: np.ndarray, y: np.ndarray, discrete_target: bool, n_neighbors: int = 3, seed: int = 0, only: int | None = None) -> np.ndarray:
    """Nearest-neighbour estimates (Ross for discrete, Kraskov for continuous targets) of each column, or of one."""
    rng = np.random.default_rng(seed)
    out = []
    for j in range(x.shape[1]):
        if only is not None and j != only:  # the noise of the other columns is drawn, so that each has its own
            rng.standard_normal(len(x) * (1 if discrete_target else 2))
            continue
        v = x[:, j] / (x[:, j].std() or 1)
        v = v + 1e-10 * max(1.0, np.abs(v).mean()) * rng.standard_normal(len(v))
        if discrete_target:
            r, k, c = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
            for u in np.unique(y):
                who = np.flatnonzero(y == u)
                if len(who) > 1:
                    kk = min(n_neighbors, len(who) - 1)
                    r[who], k[who], c[who] = _kth(v[who], kk), kk, len(who)
            ok = c > 1
            v, r, k, c = v[ok], np.nextafter(r[ok], 0), k[ok], c[ok]
            m = _within(v, r)
            mi = digamma(np.array([len(v)]))[0] + digamma(k).mean() - digamma(c).mean() - digamma(np.maximum(m, 1)).mean()
        else:
            t = y / (y.std() or 1)
            t = t + 1e-10 * max(1.0, np.abs(t).mean()) * rng.standard_normal(len(t))
            r = np.nextafter(_kth_in_plane(v, t, n_neighbors), 0)
            mi = digamma(np.array([len(v)]))[0] + digamma(np.array([n_neighbors]))[0] - digamma(np.maximum(_within(v, r), 1)).mean() - digamma(np.maximum(_within(t, r), 1)).mean()
        out.append(max(0.0, float(mi)))
    return np.array(out)


def mutual_info_classif(df, features, label, discrete_features=False, n_neighbors=3, random_state=0):
    from quarry.operators.base import gather

    if discrete_features:
        return np.array([mutual_info_discrete(df, c, label).first()[0] for c in features])
    m = gather(df, [*features, label])
    return mutual_info_arrays(m[:, :-1], m[:, -1], True, n_neighbors, random_state)


def mutual_info_regression(df, features, label, n_neighbors=3, random_state=0):
    """One task for each column, over one broadcast of the rows."""
    from quarry.operators.base import MAX_ROWS
    from quarry.operators.trees import fit_members

    one = lambda m, j: mutual_info_arrays(m[:, :-1], m[:, -1], False, n_neighbors, random_state, j)[0]
    return np.array(fit_members(df, [*features, label], list(range(len(features))), one, MAX_ROWS))


class _Selector(Transformer, BaseEstimator):
    def transform(self, df):
        return df.drop(*[c for c in self.features_ if c not in self.kept_])

    def transform_arrays(self, x):
        return x[:, [self.features_.index(c) for c in self.kept_]]


class SelectKBest(_Selector):
    params = {"k": 10, "score_func": "fRegression"}

    def fit(self, df, features, label):
        self.features_ = list(features)
        s = (f_regression if self.score_func == "fRegression" else self.score_func)(df, features, label)
        self.scores_ = np.asarray(s[0] if isinstance(s, tuple) else s)
        top = sorted(range(len(features)), key=lambda i: (-self.scores_[i], i))[: self.k]
        self.kept_ = [features[i] for i in sorted(top)]
        return self


class SelectFromModel(_Selector):
    params = {"estimator": None, "threshold": "mean", "max_features": None}

    def fit(self, df, features, label):
        self.features_ = list(features)
        self.estimator_ = self.estimator.clone()
        self.estimator_.fit(df, features, label)
        imp = importances(self.estimator_)
        t = self.threshold
        if isinstance(t, str):
            scale, _, name = t.rpartition("*")
            t = float(scale or 1) * (np.mean(imp) if name.strip() == "mean" else np.median(imp))
        self.threshold_ = -math.inf if self.threshold is None else float(t)
        order = sorted(range(len(imp)), key=lambda i: (-imp[i], i))
        order = [i for i in order if imp[i] >= self.threshold_]
        self.kept_ = [features[i] for i in sorted(order[: self.max_features] if self.max_features else order)]
        return self


class RFE(_Selector):
    params = {"estimator": None, "n_features_to_select": None, "step": 1}

    def fit(self, df, features, label):
        self.features_ = list(features)
        want = resolve_subset_size(self.n_features_to_select, len(features)) if self.n_features_to_select else max(1, len(features) // 2)
        step = max(1, int(self.step * len(features))) if isinstance(self.step, float) and self.step < 1 else int(self.step)
        kept, self.ranking_ = list(features), dict.fromkeys(features, 1)
        while True:
            self.estimator_ = self.estimator.clone()
            self.estimator_.fit(df, kept, label)
            if len(kept) <= want:
                break
            imp = importances(self.estimator_, squared=True)
            out = {kept[i] for i in sorted(range(len(kept)), key=lambda i: (imp[i], i))[: min(step, len(kept) - want)]}
            kept = [c for c in kept if c not in out]
            for c in features:
                if c not in kept:
                    self.ranking_[c] += 1
        self.kept_ = kept
        return self

    def predict(self, df, output="prediction"):
        return self.estimator_.predict(df, output)

    def score(self, df, label):
        return self.estimator_.score(df, label)


class RFECV(RFE):
    params = {"min_features_to_select": 1, "cv": 5}

    def fit(self, df, features, label, row="row_id"):
        from quarry.operators.model_selection import KFold, StratifiedKFold

        folds = (StratifiedKFold if getattr(self.estimator, "kind", "") == "classifier" else KFold)(n_splits=self.cv)
        assigned = folds.assign(df, row, label).persist()
        counts = list(range(self.min_features_to_select, len(features) + 1))
        scores = {}
        for k in counts:
            parts = []
            for f in range(self.cv):
                r = RFE(estimator=self.estimator, n_features_to_select=k, step=self.step).fit(assigned.where(F.col("fold") != f), features, label)
                parts.append(r.score(assigned.where(F.col("fold") == f), label))
            scores[k] = float(np.mean(parts))
        assigned.unpersist()
        self.cv_scores_ = scores
        best = max(counts, key=lambda k: (scores[k], -k))
        r = RFE(estimator=self.estimator, n_features_to_select=best, step=self.step).fit(df, features, label)
        self.features_, self.kept_, self.estimator_, self.ranking_ = r.features_, r.kept_, r.estimator_, r.ranking_
        return self
