"""Naive Bayes: one grouped aggregate to fit, a small table of parameters to score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.base import BaseEstimator, Classifier
from quarry.plans.aggregate import class_moments


class _NaiveBayes(Classifier, BaseEstimator):
    def proba_arrays(self, x: np.ndarray) -> np.ndarray:
        j = self.joint_arrays(x)
        e = np.exp(j - j.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict_arrays(self, x):
        return self.classes_[self.joint_arrays(x).argmax(axis=1)]

    def _priors(self, counts: np.ndarray) -> np.ndarray:
        given = getattr(self, "class_prior", None)
        if given is not None:
            if len(given) != len(counts) or abs(sum(given) - 1) > 1e-8:
                raise ValueError("class priors: one for each class, 1 in all")
            return np.log(np.array(given, float))
        if not getattr(self, "fit_prior", True):
            return np.full(len(counts), -np.log(len(counts)))
        return np.log(counts / counts.sum())

    def _alpha(self) -> float:
        return self.alpha if getattr(self, "force_alpha", True) else max(self.alpha, 1e-10)


class GaussianNB(_NaiveBayes):
    params = {"priors": None, "var_smoothing": 1e-9}

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None):
        self.features_ = list(features)
        rows = sorted(class_moments(df, features, label, weight).collect(), key=lambda r: r.label)
        largest = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(features)]).first()
        self.classes_ = np.array([float(r.label) for r in rows])
        self.theta_ = np.array([[r[f"mean_{i}"] for i in range(len(features))] for r in rows])
        self.epsilon_ = self.var_smoothing * max(largest)
        self.var_ = np.array([[r[f"var_{i}"] for i in range(len(features))] for r in rows]) + self.epsilon_
        self.class_prior = self.priors
        self.log_prior_ = self._priors(np.array([float(r.n) for r in rows]))
        del self.class_prior
        return self

    def joint_arrays(self, x):
        d = x[:, None, :] - self.theta_[None]
        return self.log_prior_ - 0.5 * (np.log(2 * np.pi * self.var_).sum(axis=1) + (d * d / self.var_).sum(axis=2))

    def score_columns(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Prediction by generated expressions: the class of the largest joint log likelihood, ties to the smaller."""
        return df.withColumn(output, _best(self.classes_, [sum(((F.col(c).cast("double") - float(m)) ** 2 * float(-0.5 / v) for c, m, v in zip(self.features_, ms, vs, strict=True)), F.lit(float(p - 0.5 * np.log(2 * np.pi * vs).sum()))) for ms, vs, p in zip(self.theta_, self.var_, self.log_prior_, strict=True)]))


def _best(classes, scores):
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.coalesce(*[F.when(s == top, F.lit(float(c))) for c, s in zip(classes, scores, strict=True)])


class _Counting(_NaiveBayes):
    def _sums(self, df, features, label, each, weight):
        w = F.col(weight) if weight else F.lit(1.0)
        rows = sorted(df.groupBy(F.col(label).cast("double").alias("label")).agg(F.sum(w).alias("n"), *[F.sum(each(c) * w).alias(f"s{i}") for i, c in enumerate(features)]).collect(), key=lambda r: r.label)
        self.features_ = list(features)
        self.classes_ = np.array([r.label for r in rows])
        return np.array([float(r.n) for r in rows]), np.array([[r[f"s{i}"] for i in range(len(features))] for r in rows], float)


def _counts(c):
    x = F.col(c).cast("double")
    return F.when(x >= 0, x).otherwise(F.raise_error(F.lit("negative count")).cast("double"))


class MultinomialNB(_Counting):
    params = {"alpha": 1.0, "force_alpha": True, "fit_prior": True, "class_prior": None}

    def fit(self, df, features, label, weight=None):
        n, s = self._sums(df, features, label, _counts, weight)
        s = s + self._alpha()
        self.log_prob_, self.log_prior_ = np.log(s) - np.log(s.sum(axis=1, keepdims=True)), self._priors(n)
        return self

    def joint_arrays(self, x):
        return x @ self.log_prob_.T + self.log_prior_


class ComplementNB(_Counting):
    params = {"alpha": 1.0, "force_alpha": True, "fit_prior": True, "class_prior": None, "norm": False}

    def fit(self, df, features, label, weight=None):
        n, s = self._sums(df, features, label, _counts, weight)
        rest = s.sum(axis=0) + self._alpha() - s
        w = np.log(rest / rest.sum(axis=1, keepdims=True))
        self.weights_ = w / w.sum(axis=1, keepdims=True) if self.norm else -w
        self.log_prior_ = self._priors(n)
        return self

    def joint_arrays(self, x):
        j = x @ self.weights_.T
        return j + self.log_prior_ if len(self.classes_) == 1 else j


class BernoulliNB(_Counting):
    params = {"alpha": 1.0, "force_alpha": True, "binarize": 0.0, "fit_prior": True, "class_prior": None}

    def fit(self, df, features, label, weight=None):
        on = (lambda c: F.col(c).cast("double")) if self.binarize is None else (lambda c: (F.col(c) > self.binarize).cast("double"))
        n, s = self._sums(df, features, label, on, weight)
        a = self._alpha()
        p = (s + a) / (n + 2 * a)[:, None]
        self.on_, self.off_, self.log_prior_ = np.log(p), np.log(1 - p), self._priors(n)
        return self

    def joint_arrays(self, x):
        b = x if self.binarize is None else (x > self.binarize).astype(float)
        return b @ (self.on_ - self.off_).T + self.off_.sum(axis=1) + self.log_prior_


class CategoricalNB(_NaiveBayes):
    """Columns of category codes; a category never seen adds nothing."""

    params = {"alpha": 1.0, "force_alpha": True, "fit_prior": True, "class_prior": None, "min_categories": None}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        w = F.col(weight) if weight else F.lit(1.0)
        y = F.col(label).cast("double").alias("label")
        n = {r.label: r.n for r in df.groupBy(y).agg(F.sum(w).alias("n")).collect()}
        self.classes_ = np.array(sorted(n))
        counts = np.array([n[c] for c in self.classes_])
        cell = df.select(y, w.alias("w"), F.posexplode(F.array(*[F.col(c).cast("int") for c in features]))).groupBy("label", "pos", "col").agg(F.sum("w").alias("n")).collect()
        self.tables_ = []
        for i in range(len(features)):
            mine = [r for r in cell if r.pos == i]
            least = self.min_categories[i] if isinstance(self.min_categories, (list, tuple)) else self.min_categories or 0
            size = max(max((r.col for r in mine), default=-1) + 1, least)
            t = np.full((len(counts), size), self._alpha())
            for r in mine:
                t[np.searchsorted(self.classes_, r.label), r.col] += r.n
            self.tables_.append(np.log(t) - np.log(t.sum(axis=1, keepdims=True)))
        self.log_prior_ = self._priors(counts)
        return self

    def joint_arrays(self, x):
        j = np.tile(self.log_prior_, (len(x), 1))
        for i, t in enumerate(self.tables_):
            v = x[:, i].astype(int)
            ok = (v >= 0) & (v < t.shape[1])
            j[ok] += t[:, v[ok]].T
        return j
