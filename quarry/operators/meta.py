"""Composition: pipelines, column transformers, voting, stacking, multiclass and multi-output wrappers, calibration, baselines, semi-supervised learning."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.distances import by_blocks, kernel, links, nearest_rows, pairwise
from quarry.operators.base import MAX_ROWS, ArrayEstimator, BaseEstimator, Classifier, Predictor, Regressor, classes_of, score_column


class Pipeline(BaseEstimator):
    """Named steps; all but the last transform.  Lazily planned: a step only adds expressions or joins."""

    params = {"steps": None}

    def __init__(self, **params):
        super().__init__(**params)
        names = [n for n, _ in self.steps or []]
        if len(set(names)) != len(names) or any("__" in n for n in names):
            raise ValueError("steps need distinct names without __")
        for n, s in (self.steps or [])[:-1]:
            if not hasattr(s, "transform"):
                raise ValueError(f"step {n} can't transform")

    @property
    def named_steps(self):
        return dict(self.steps)

    @property
    def kind(self):
        return getattr(self.steps[-1][1], "kind", "transformer")

    def get_step(self, name):
        return self.named_steps[name]

    def _child(self, name):
        return self.named_steps[name]

    def _features(self, df, before, features):
        kept = [c for c in features if c in df.columns]
        return kept + [c for c in df.columns if c not in before and not c.startswith("__")]

    def fit(self, df, features, label=None, **kw):
        self.inputs_, cols = list(features), list(features)
        for _, s in self.steps[:-1]:
            before = set(df.columns)
            s.fit(df, cols, label) if _takes_label(s) else s.fit(df, cols)
            df = s.transform(df)
            cols = self._features(df, before, cols)
        last = self.steps[-1][1]
        last.fit(df, cols, label, **kw) if label is not None and not hasattr(last, "transform") or hasattr(last, "predict") else last.fit(df, cols)
        self.features_ = cols
        return self

    def _through(self, df):
        for _, s in self.steps[:-1]:
            df = s.transform(df)
        return df

    def predict(self, df, output="prediction"):
        return self.steps[-1][1].predict(self._through(df), output)

    def predict_proba(self, df, output="probability"):
        return self.steps[-1][1].predict_proba(self._through(df), output)

    def transform(self, df):
        return self.steps[-1][1].transform(self._through(df))

    def fit_transform(self, df, features, label=None):
        return self.fit(df, features, label).transform(df)

    def score(self, df, label):
        return self.steps[-1][1].score(self._through(df), label)


def _takes_label(step) -> bool:
    import inspect

    return "label" in inspect.signature(step.fit).parameters


def make_pipeline(*steps) -> Pipeline:
    names = [type(s).__name__.lower() for s in steps]
    seen: dict[str, int] = {}
    out = []
    for n, s in zip(names, steps, strict=True):
        if names.count(n) > 1:
            seen[n] = seen.get(n, 0) + 1
            n = f"{n}-{seen[n]}"
        out.append((n, s))
    return Pipeline(steps=out)


class ColumnTransformer(BaseEstimator):
    """(name, estimator | 'passthrough' | 'drop', columns) in turn, each on its columns; other columns dropped or passed."""

    params = {"transformers": None, "remainder": "drop"}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        for _, t, cols in self.transformers:
            if not isinstance(t, str):
                t.fit(df, cols)
        return self

    def transform(self, df):
        used = {c for _, _, cols in self.transformers for c in cols}
        order = []
        for _, t, cols in self.transformers:
            before = set(df.columns)
            if t == "drop":
                df = df.drop(*cols)
                continue
            if t != "passthrough":
                df = t.transform(df)
            order += [c for c in cols if c in df.columns] + [c for c in df.columns if c not in before]
        rest = [c for c in self.features_ if c not in used]
        others = [c for c in df.columns if c not in order and c not in self.features_]
        return df.select(*others, *order, *(rest if self.remainder == "passthrough" else []))


def hstack(df: DataFrame, arrays: list[str], output: str) -> DataFrame:
    return df.withColumn(output, F.concat(*arrays))


class FeatureUnion(BaseEstimator):
    """Every transformer's output of the same columns, side by side, as name_column."""

    params = {"transformer_list": None}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        for _, t in self.transformer_list:
            t.fit(df, features)
        return self

    def transform(self, df, row="row_id"):
        out = df
        for name, t in self.transformer_list:
            copies = df.select(row, *self.features_)
            got = t.transform(copies)
            out = out.join(got.select(row, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in got.columns if c != row]), row)
        return out.drop(*self.features_)


class TransformedTargetRegressor(Regressor, BaseEstimator):
    """func and inverse_func: names (identity, log1p, expm1) or functions of a Column."""

    params = {"regressor": None, "func": "identity", "inverse_func": "identity"}

    def fit(self, df, features, label, weight=None):
        from quarry.operators.linear import LinearRegression
        from quarry.operators.preprocessing import FunctionTransformer as T

        f = T.named[self.func] if isinstance(self.func, str) else self.func
        self.regressor_ = (self.regressor or LinearRegression()).clone()
        self.regressor_.fit(df.withColumn("__y", f(F.col(label).cast("double"))), features, "__y")
        return self

    def predict(self, df, output="prediction"):
        from quarry.operators.preprocessing import FunctionTransformer as T

        f = T.named[self.inverse_func] if isinstance(self.inverse_func, str) else self.inverse_func
        out = self.regressor_.predict(df, output)
        return out.withColumn(output, f(F.col(output)))


# --- several models ---------------------------------------------------------------------


def _members(df, models, output="prediction"):
    """df with one prediction column for each member: member_0, member_1, ..."""
    for i, m in enumerate(models):
        df = m.predict(df, f"__m{i}")
    return df


class VotingClassifier(Classifier, BaseEstimator):
    params = {"estimators": None, "voting": "hard", "weights": None}

    def fit(self, df, features, label, weight=None):
        self.classes_ = np.array(sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()))
        self.estimators_ = [e.clone().fit(df, features, label) for _, e in self.estimators]
        return self

    def predict(self, df, output="prediction"):
        w = self.weights or [1.0] * len(self.estimators_)
        scores = []
        if self.voting == "hard":
            out = _members(df, self.estimators_)
            scores = [sum((F.when(F.col(f"__m{i}") == float(c), float(v)).otherwise(0.0) for i, v in enumerate(w)), F.lit(0.0)) for c in self.classes_]
        else:
            out = df
            for i, m in enumerate(self.estimators_):
                out = m.predict_proba(out, f"__m{i}")
            scores = [sum((F.col(f"__m{i}")[k] * float(v) for i, v in enumerate(w)), F.lit(0.0)) for k in range(len(self.classes_))]
        top = F.greatest(*scores)
        best = F.coalesce(*[F.when(s == top, float(c)) for s, c in zip(scores, self.classes_, strict=True)])
        return out.withColumn(output, best).drop(*[f"__m{i}" for i in range(len(self.estimators_))])


class VotingRegressor(Regressor, BaseEstimator):
    params = {"estimators": None, "weights": None}

    def fit(self, df, features, label, weight=None):
        self.estimators_ = [e.clone().fit(df, features, label) for _, e in self.estimators]
        return self

    def predict(self, df, output="prediction"):
        w = self.weights or [1.0] * len(self.estimators_)
        out = _members(df, self.estimators_)
        mean = sum((F.col(f"__m{i}") * float(v) for i, v in enumerate(w)), F.lit(0.0)) / float(sum(w))
        return out.withColumn(output, mean).drop(*[f"__m{i}" for i in range(len(w))])


class _Stacking(BaseEstimator):
    params = {"estimators": None, "final_estimator": None, "cv": 5, "passthrough": False}

    def _meta(self, df, models):
        names = []
        for i, m in enumerate(models):
            if self.kind == "classifier" and hasattr(m, "proba_arrays"):
                df = m.predict_proba(df, f"__p{i}")
                ks = range(1, 2) if len(self.classes_) == 2 else range(len(self.classes_))
                df = df.withColumns({f"__s{i}_{k}": F.col(f"__p{i}")[k] for k in ks}).drop(f"__p{i}")
                names += [f"__s{i}_{k}" for k in ks]
            else:
                df = m.predict(df, f"__s{i}")
                names.append(f"__s{i}")
        return df, names

    def fit(self, df, features, label, weight=None, row="row_id"):
        from quarry.operators.linear import LogisticRegression, Ridge
        from quarry.operators.model_selection import KFold, StratifiedKFold

        self.features_ = list(features)
        if self.kind == "classifier":
            self.classes_ = np.array(sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()))
        folds = (StratifiedKFold if self.kind == "classifier" else KFold)(n_splits=self.cv).assign(df, row, label).persist()
        parts = None
        for f in range(self.cv):
            models = [e.clone().fit(folds.where(F.col("fold") != f), features, label) for _, e in self.estimators]
            part, names = self._meta(folds.where(F.col("fold") == f), models)
            parts = part if parts is None else parts.unionByName(part)
        self.names_ = names + (list(features) if self.passthrough else [])
        default = LogisticRegression(solver="newton", c=1.0) if self.kind == "classifier" and len(self.classes_) == 2 else LogisticRegression() if self.kind == "classifier" else Ridge()
        self.final_ = (self.final_estimator or default).clone()
        self.final_.fit(parts, self.names_, label)
        self.estimators_ = [e.clone().fit(df, features, label) for _, e in self.estimators]
        folds.unpersist()
        return self

    def predict(self, df, output="prediction"):
        out, names = self._meta(df, self.estimators_)
        return self.final_.predict(out, output).drop(*names)


class StackingClassifier(_Stacking, Classifier):
    predict = _Stacking.predict


class StackingRegressor(_Stacking, Regressor):
    predict = _Stacking.predict


class OneVsRestClassifier(Classifier, BaseEstimator):
    params = {"estimator": None}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        self.classes_ = np.array(sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()))
        if type(self.estimator).fit is ArrayEstimator.fit and not weight:  # one task for each class, over one broadcast of the rows
            from quarry.operators.trees import fit_members

            p, classes, estimator = len(features), self.classes_, self.estimator
            one = lambda m, i: estimator.clone().fit_arrays(m[:, :p], (m[:, p] == classes[i]).astype(float))
            self.estimators_ = fit_members(df, [*features, label], list(range(len(classes))), one, estimator.max_rows)
            for e in self.estimators_:
                e.features_ = list(features)
            return self
        self.estimators_ = [self.estimator.clone().fit(df.withColumn("__y", (F.col(label) == float(c)).cast("double")), features, "__y") for c in self.classes_]
        return self

    def decision_arrays(self, x):
        return np.column_stack([_member_score(e, x) for e in self.estimators_])

    def predict_arrays(self, x):
        return self.classes_[self.decision_arrays(x).argmax(axis=1)]

    def proba_arrays(self, x):
        p = np.column_stack([e.proba_arrays(x)[:, -1] for e in self.estimators_])
        t = p.sum(axis=1, keepdims=True)
        return np.where(t > 0, p / np.maximum(t, 1e-300), 1 / p.shape[1])


def _member_score(e, x):
    if hasattr(e, "decision_arrays"):
        d = np.asarray(e.decision_arrays(x))
        return d if d.ndim == 1 else d[:, -1] - (d[:, 0] if d.shape[1] == 2 else 0)
    return e.proba_arrays(x)[:, -1] if hasattr(e, "proba_arrays") else e.predict_arrays(x)


def ovr_decision(predictions: np.ndarray, confidences: np.ndarray, k: int) -> np.ndarray:
    """Votes of all pairs of classes plus their summed confidences, scaled below a third of a vote."""
    votes, sums = np.zeros((len(predictions), k)), np.zeros((len(predictions), k))
    for c, (i, j) in enumerate(itertools.combinations(range(k), 2)):
        sums[:, i] -= confidences[:, c]
        sums[:, j] += confidences[:, c]
        votes[predictions[:, c] == 0, i] += 1
        votes[predictions[:, c] == 1, j] += 1
    return votes + sums / (3 * (np.abs(sums) + 1))


class OneVsOneClassifier(Classifier, BaseEstimator):
    params = {"estimator": None}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        self.classes_ = np.array(sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()))
        self.estimators_ = []
        for a, b in itertools.combinations(self.classes_, 2):
            two = df.where(F.col(label).isin(float(a), float(b))).withColumn("__y", (F.col(label) == float(b)).cast("double"))
            self.estimators_.append(self.estimator.clone().fit(two, features, "__y"))
        return self

    def decision_arrays(self, x):
        p = np.column_stack([e.predict_arrays(x) for e in self.estimators_])
        return ovr_decision(p, np.column_stack([_member_score(e, x) for e in self.estimators_]), len(self.classes_))

    def predict_arrays(self, x):
        return self.classes_[self.decision_arrays(x).argmax(axis=1)]


class _MultiOutput(BaseEstimator):
    params = {"estimator": None}

    def fit(self, df, features, labels, weight=None):
        self.labels_ = list(labels)
        self.estimators_ = [self.estimator.clone().fit(df, features, c) for c in labels]
        return self

    def predict(self, df, output="prediction"):
        for c, e in zip(self.labels_, self.estimators_, strict=True):
            df = e.predict(df, f"{output}_{c}")
        return df


class MultiOutputClassifier(_MultiOutput):
    kind = "classifier"

    def score(self, df) -> float:
        hit = F.lit(True)
        for c in self.labels_:
            hit = hit & (F.col(f"prediction_{c}") == F.col(c))
        return float(self.predict(df).agg(F.avg(hit.cast("double"))).first()[0])


class MultiOutputRegressor(_MultiOutput):
    kind = "regressor"


class ClassifierChain(BaseEstimator):
    """Each model also sees the targets before its own: the true ones (or cross-validated guesses) in fitting, its own guesses later."""

    params = {"estimator": None, "order": None, "cv": None, "random_state": 0}
    kind = "classifier"

    def fit(self, df, features, labels, weight=None):
        order = list(range(len(labels)))
        if self.order == "random":
            order = np.random.default_rng(self.random_state).permutation(len(labels)).tolist()
        elif self.order is not None:
            order = list(self.order)
        self.labels_, self.chain_, self.features_, self.estimators_ = list(labels), [labels[i] for i in order], list(features), []
        cols = list(features)
        for c in self.chain_:
            self.estimators_.append(self.estimator.clone().fit(df, cols, c))
            if self.cv:
                from quarry.operators.model_selection import cross_val_predict

                df = cross_val_predict(self.estimator, df, cols, c, self.cv).withColumnRenamed("prediction", f"prediction_{c}").drop("fold")
            else:
                df = df.withColumn(f"prediction_{c}", F.col(c).cast("double"))
            cols = [*cols, f"prediction_{c}"]
        return self

    def predict(self, df):
        for c, e in zip(self.chain_, self.estimators_, strict=True):
            df = e.predict(df, f"prediction_{c}")
        return df


class RegressorChain(ClassifierChain):
    kind = "regressor"


# --- calibration ------------------------------------------------------------------------


class SigmoidCalibration(BaseEstimator):
    """Platt scaling with smoothed targets by Newton's method with halving."""

    def fit_arrays(self, s, y, w=None):
        w = np.ones(len(s)) if w is None else w
        pos, neg = w[y > 0].sum(), w[y <= 0].sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 0.0, math.log((neg + 1) / (pos + 1))

        def loss(a, b):
            z = a * s + b
            return float((w * (np.logaddexp(0, z) - (1 - t) * z)).sum())

        for _ in range(100):
            q = 1 / (1 + np.exp(a * s + b))
            d = w * (t - q)
            h = w * q * (1 - q)
            g = np.array([(d * s).sum(), d.sum()])
            if np.abs(g).max() < 1e-7:
                break
            step = np.linalg.solve(np.array([[(h * s * s).sum() + 1e-12, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-12]]), -g)
            size, old = 1.0, loss(a, b)
            while size > 1e-10 and loss(a + size * step[0], b + size * step[1]) > old:
                size /= 2
            a, b = a + size * step[0], b + size * step[1]
        self.a_, self.b_ = float(a), float(b)
        return self

    def predict_arrays(self, s):
        return 1 / (1 + np.exp(self.a_ * np.asarray(s) + self.b_))


def pava_non_decreasing(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence in weighted squares: neighbouring blocks are pooled."""
    value, weight, size = [], [], []
    for v, u in zip(y, w, strict=True):
        value.append(float(v))
        weight.append(float(u))
        size.append(1)
        while len(value) > 1 and value[-2] > value[-1]:
            v2, u2, n2 = value.pop(), weight.pop(), size.pop()
            total = weight[-1] + u2
            value[-1] = (value[-1] * weight[-1] + v2 * u2) / total
            weight[-1], size[-1] = total, size[-1] + n2
    return np.repeat(value, size)


class IsotonicRegression(Regressor, BaseEstimator):
    """On distinct x: a grouped mean for each, pooled on the driver (one number for each distinct x, at most max_rows)."""

    params = {"y_min": None, "y_max": None, "increasing": True, "out_of_bounds": "clip", "max_rows": 1_000_000}

    def fit(self, df, features, label, weight=None):
        c = features if isinstance(features, str) else features[0]
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        g = df.groupBy(F.col(c).cast("double").alias("x")).agg((F.sum(w * F.col(label)) / F.sum(w)).alias("y"), F.sum(w).alias("w"))
        rows = g.orderBy("x").limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise ValueError("too many distinct values")
        self.features_ = [c]
        return self._pool(*(np.array([r[k] for r in rows]) for k in ("x", "y", "w")))

    def fit_arrays(self, x, y, w=None):
        x = np.asarray(x).reshape(len(y))
        w = np.ones(len(y)) if w is None else w
        u, at = np.unique(x, return_inverse=True)
        s = np.bincount(at, w)
        self._pool(u, np.bincount(at, w * y) / s, s)
        return self

    def _pool(self, x, y, w):
        up = self.increasing
        if up == "auto":
            r = lambda v: np.argsort(np.argsort(v)).astype(float)
            up = len(x) < 2 or np.corrcoef(r(x), r(y))[0, 1] >= 0
        v = pava_non_decreasing(y, w) if up else -pava_non_decreasing(-y, w)
        lo, hi = -np.inf if self.y_min is None else self.y_min, np.inf if self.y_max is None else self.y_max
        self.x_, self.y_ = x, np.clip(v, lo, hi)
        return self

    def predict_arrays(self, x):
        v = np.asarray(x, float).reshape(len(x))
        out = np.interp(v, self.x_, self.y_)
        far = (v < self.x_[0]) | (v > self.x_[-1])
        if far.any() and self.out_of_bounds == "raise":
            raise ValueError("a value lies outside the fitted range")
        return np.where(far, np.nan, out) if self.out_of_bounds == "nan" else out


class CalibratedClassifierCV(Classifier, BaseEstimator):
    """The scores of one fold at a time come to the driver, where the curve is fitted; more than max_rows are refused."""

    params = {"estimator": None, "method": "sigmoid", "cv": 5, "ensemble": True, "max_rows": 5_000_000}

    def _new(self):
        return SigmoidCalibration() if self.method == "sigmoid" else IsotonicRegression(y_min=0.0, y_max=1.0)

    def _scores(self, model, df, label):
        """(k, 2, n): score and label of each class, from one column of scores for each."""
        k = len(self.classes_)
        arrays = score_column(df, self.features_, lambda x: np.column_stack([_class_score(model, x, i, k) for i in range(k)]), "__s", "array<double>")
        rows = arrays.select("__s", F.col(label).cast("double").alias("y")).limit(self.max_rows + 1).toPandas()
        if len(rows) > self.max_rows:
            raise ValueError(f"a calibration curve takes at most {self.max_rows} scores")
        return np.array(rows["__s"].tolist()).reshape(len(rows), k), rows["y"].to_numpy(np.float64)

    def fit(self, df, features, label, weight=None, row="row_id"):
        from quarry.operators.model_selection import StratifiedKFold

        self.features_ = list(features)
        self.classes_ = np.array(sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()))
        k = len(self.classes_)
        folds = StratifiedKFold(n_splits=self.cv).assign(df, row, label).persist()
        self.pairs_, every = [], []
        for f in range(self.cv):
            model = self.estimator.clone().fit(folds.where(F.col("fold") != f), features, label)
            s, y = self._scores(model, folds.where(F.col("fold") == f), label)
            if self.ensemble:
                self.pairs_.append((model, self._calibrators(s, y, k)))
            every.append((s, y))
        if not self.ensemble:
            s, y = np.concatenate([a for a, _ in every]), np.concatenate([b for _, b in every])
            self.pairs_ = [(self.estimator.clone().fit(df, features, label), self._calibrators(s, y, k))]
        folds.unpersist()
        return self

    def _calibrators(self, s, y, k):
        which = range(1, 2) if k == 2 else range(k)
        return [self._new().fit_arrays(s[:, i], (y == self.classes_[i]).astype(float)) for i in which]

    def proba_arrays(self, x):
        k, total = len(self.classes_), 0.0
        for model, cals in self.pairs_:
            if k == 2:
                p = cals[0].predict_arrays(_class_score(model, x, 1, 2))
                p = np.column_stack([1 - p, p])
            else:
                p = np.column_stack([c.predict_arrays(_class_score(model, x, i, k)) for i, c in enumerate(cals)])
                t = p.sum(axis=1, keepdims=True)
                p = np.where(t > 0, p / np.maximum(t, 1e-300), 1 / k)
            total = total + p
        return total / len(self.pairs_)


def _class_score(model, x, i, k):
    if hasattr(model, "decision_arrays"):
        d = np.asarray(model.decision_arrays(x))
        return (d if i else -d) if d.ndim == 1 else d[:, i]
    return model.proba_arrays(x)[:, i]


# --- baselines --------------------------------------------------------------------------


class DummyClassifier(Classifier, BaseEstimator):
    params = {"strategy": "prior", "constant": None, "random_state": 0}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        w = F.col(weight) if weight else F.lit(1.0)
        rows = sorted((r.c, r.n) for r in df.groupBy(F.col(label).cast("double").alias("c")).agg(F.sum(w).alias("n")).collect())
        self.classes_, n = np.array([c for c, _ in rows]), np.array([float(v) for _, v in rows])
        self.prior_ = n / n.sum()
        return self

    def predict(self, df, output="prediction", row="row_id"):
        if self.strategy in ("prior", "mostFrequent", "constant"):
            v = self.constant if self.strategy == "constant" else self.classes_[self.prior_.argmax()]
            return df.withColumn(output, F.lit(float(v)))
        u = F.pmod(F.xxhash64(F.lit(self.random_state), row), F.lit(1 << 31)) / float(1 << 31)
        cuts = np.cumsum(self.prior_) if self.strategy == "stratified" else np.arange(1, len(self.classes_) + 1) / len(self.classes_)
        out = F.lit(float(self.classes_[-1]))
        for c, t in reversed(list(zip(self.classes_, cuts, strict=True))[:-1]):
            out = F.when(u < float(t), float(c)).otherwise(out)
        return df.withColumn(output, out)

    def proba_arrays(self, x):
        hot = np.zeros(len(self.classes_))
        hot[self.prior_.argmax() if self.strategy != "constant" else int(np.searchsorted(self.classes_, self.constant))] = 1
        p = self.prior_ if self.strategy in ("prior", "stratified") else hot if self.strategy != "uniform" else np.full(len(hot), 1 / len(hot))
        return np.tile(p, (len(x), 1))


class DummyRegressor(Regressor, BaseEstimator):
    params = {"strategy": "mean", "quantile": 0.5, "constant": None}

    def fit(self, df, features, label, weight=None):
        y = F.col(label).cast("double")
        self.features_ = list(features)
        self.value_ = float(self.constant) if self.strategy == "constant" else float(df.agg({"mean": F.avg(y), "median": F.median(y), "quantile": F.percentile(y, float(self.quantile))}[self.strategy]).first()[0])
        return self

    def predict(self, df, output="prediction"):
        return df.withColumn(output, F.lit(self.value_))


# --- semi-supervised ----------------------------------------------------------------------


class LabelPropagation(Classifier, ArrayEstimator):
    """Labels (-1: none) spread over a row-normalised graph; given labels are put back after each step."""

    params = {"kernel": "rbf", "gamma": 20.0, "n_neighbors": 7, "max_iter": 1000, "tol": 1e-3, "max_rows": MAX_ROWS}

    def _graph(self, x, loops=True):
        """Products with the graph; kernel values are made by blocks of rows each time."""
        if self.kernel == "knn":
            near = nearest_rows(x, self.n_neighbors)
            return (lambda f: f[near].sum(axis=1)) if loops else links(np.repeat(np.arange(len(x)), near.shape[1]), near.ravel(), len(x))

        def block(at, f):
            k = kernel(x[at], x, self.kernel, self.gamma)
            if not loops:
                k[np.arange(len(at)), at] = 0
            return k @ f

        return lambda f: by_blocks(lambda at: block(at, f), np.arange(len(x)), width=len(x))

    def _start(self, x, y):
        self.x_ = x
        self.classes_ = np.unique(y[y != -1])
        f = (y[:, None] == self.classes_[None]).astype(float)
        return f, y != -1

    def fit_arrays(self, x, y, w=None):
        given, known = self._start(x, y)
        times = self._graph(x)
        total = np.maximum(times(np.ones((len(x), 1))), 1e-300)
        f = given.copy()
        for _ in range(self.max_iter):
            new = times(f) / total
            new = new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
            new[known] = given[known]
            done = np.abs(new - f).sum() < self.tol
            f = new
            if done:
                break
        self.distributions_ = f
        self.transduction_ = self.classes_[f.argmax(axis=1)]
        return self

    def proba_arrays(self, x):
        if self.kernel == "knn":
            near = by_blocks(lambda r: np.argsort(pairwise(r, self.x_), axis=1, kind="stable")[:, : self.n_neighbors], x, width=len(self.x_))
            p = self.distributions_[near].sum(axis=1)
        else:
            p = by_blocks(lambda r: kernel(r, self.x_, self.kernel, self.gamma) @ self.distributions_, x, width=len(self.x_))
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


class LabelSpreading(LabelPropagation):
    """Symmetric normalised graph without self-loops; alpha is the share that rows take from their neighbours."""

    params = {"alpha": 0.2, "max_iter": 30}

    def fit_arrays(self, x, y, w=None):
        given, _ = self._start(x, y)
        times = self._graph(x, loops=False)
        d = np.sqrt(np.maximum(times(np.ones((len(x), 1))), 1e-300))
        f = given.copy()
        for _ in range(self.max_iter):
            new = self.alpha * times(f / d) / d + (1 - self.alpha) * given
            done = np.abs(new - f).sum() < self.tol
            f = new
            if done:
                break
        self.distributions_ = f / np.maximum(f.sum(axis=1, keepdims=True), 1e-300)
        self.transduction_ = self.classes_[f.argmax(axis=1)]
        return self


class SelfTrainingClassifier(Classifier, BaseEstimator):
    """Rows labelled -1 get the model's label where it is sure; refit until nothing is added, and once more at the end."""

    params = {"estimator": None, "threshold": 0.75, "criterion": "threshold", "k_best": 10, "max_iter": 10}

    def fit(self, df, features, label, weight=None, row="row_id"):
        from quarry.plans.iterate import checkpointed

        self.features_ = list(features)
        work = df.withColumn("__y", F.col(label).cast("double"))
        for _ in range(self.max_iter):
            model = self.estimator.clone().fit(work.where("__y <> -1"), features, "__y")
            guess = model.predict_proba(work.where("__y = -1"), "__p")
            guess = guess.withColumn("__top", F.array_max("__p"))
            classes = F.array(*[F.lit(float(c)) for c in model.classes_])
            guess = guess.withColumn("__new", F.element_at(classes, F.array_position("__p", F.col("__top")).cast("int")))
            chosen = guess.where(F.col("__top") > self.threshold) if self.criterion == "threshold" else guess.orderBy(F.desc("__top"), row).limit(self.k_best)
            chosen = checkpointed(chosen.select(row, "__new"))
            if chosen.isEmpty():
                break
            work = work.join(chosen, row, "left").withColumn("__y", F.coalesce("__new", "__y")).drop("__new")
        self.estimator_ = self.estimator.clone().fit(work.where("__y <> -1"), features, "__y")
        self.classes_ = self.estimator_.classes_
        return self

    def predict(self, df, output="prediction"):
        return self.estimator_.predict(df, output)

    def predict_proba(self, df, output="probability"):
        return self.estimator_.predict_proba(df, output)


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and not n.startswith("_")] + ["Predictor", "W", "classes_of"]
