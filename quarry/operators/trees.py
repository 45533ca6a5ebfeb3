"""Exact decision trees and ensembles of them, as numpy kernels.

A fitted tree is a few arrays, so scoring is vectorised over Arrow batches.  The
members of a forest are grown by executors, one task for each, over a training
table that is broadcast behind the size check of ``max_rows``.
"""

from __future__ import annotations

import math

import numpy as np

from quarry.operators.base import ArrayEstimator, BaseEstimator, Classifier, OutlierDetector, Regressor, classes_of, register_serializable_class, resolve_subset_size


@register_serializable_class
class Tree:
    """Arrays by node: feature (-1 in leaves), threshold (x <= threshold goes left), children, value, gain."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list = []
        self.gain: list[float] = []
        self.size: list[float] = []

    def add(self, value, size: float) -> int:
        for col, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0), (self.size, size)):
            col.append(v)
        return len(self.feature) - 1

    def done(self) -> Tree:
        for k, v in vars(self).items():
            setattr(self, k, np.array(v))
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            f = self.feature[at]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                return at
            go = x[live, f[live]] <= self.threshold[at[live]]
            at[live] = np.where(go, self.left[at[live]], self.right[at[live]])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.apply(x)]

    def importances(self, p: int, normalize: bool = True) -> np.ndarray:
        out = np.zeros(p)
        inner = self.feature >= 0
        np.add.at(out, self.feature[inner], self.gain[inner])
        return out / out.sum() if normalize and out.sum() > 0 else out


def average_importances(rows: np.ndarray) -> np.ndarray:
    m = np.mean(rows, axis=0)
    return m / m.sum() if m.sum() > 0 else m


def weighted_importances(rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    m = np.average(rows, axis=0, weights=weights)
    return m / m.sum() if m.sum() > 0 else m


def _impurity(w: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times weight of rows of class weights."""
    n = w.sum(axis=-1)
    p = w / np.maximum(n, 1e-300)[..., None]
    if criterion == "gini":
        return n * (1 - (p * p).sum(axis=-1))
    return -n * np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=-1)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, *, criterion: str, max_depth: float, min_samples_split: int, max_features, rng, random_threshold: bool = False, n_classes: int = 0, leaf=None) -> Tree:
    """A tree by greedy splits at midpoints, or at one random threshold for each candidate column.

    criterion 'gini' and 'entropy' take y as class indices; 'squared' as numbers.
    """
    tree, p = Tree(), x.shape[1]
    k = resolve_subset_size(max_features, p)
    onehot = np.eye(n_classes)[y.astype(int)] * w[:, None] if n_classes else np.column_stack([w, w * y, w * y * y])

    def cost(s: np.ndarray) -> np.ndarray:
        return _impurity(s, criterion) if n_classes else s[..., 2] - s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)

    def value(who: np.ndarray):
        if leaf is not None:
            return leaf(who)
        s = onehot[who].sum(axis=0)
        return s / max(s.sum(), 1e-300) if n_classes else s[1] / max(s[0], 1e-300)

    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        who, depth, parent, is_right = todo.pop()
        at = tree.add(value(who), float(w[who].sum()))
        if parent >= 0:
            (tree.right if is_right else tree.left)[parent] = at
        whole = float(cost(onehot[who].sum(axis=0)))
        if depth >= max_depth or len(who) < min_samples_split or whole <= 1e-12:
            continue
        best = None
        columns = np.arange(p) if k == p and rng is None else rng.permutation(p)
        for seen, f in enumerate(columns):
            if seen >= k and best is not None:
                break
            v = x[who, f]
            if random_threshold:
                lo, hi = v.min(), v.max()
                if lo == hi:
                    continue
                t = float(rng.uniform(lo, hi))
                left = onehot[who[v <= t]].sum(axis=0)
                gain = whole - float(cost(left) + cost(onehot[who].sum(axis=0) - left))
            else:
                order = np.argsort(v, kind="stable")
                s = v[order]
                cuts = np.flatnonzero(s[1:] > s[:-1])
                if not len(cuts):
                    continue
                sums = np.cumsum(onehot[who[order]], axis=0)
                gains = whole - cost(sums[cuts]) - cost(sums[-1] - sums[cuts])
                c = int(gains.argmax())
                gain, t = float(gains[c]), float((s[cuts[c]] + s[cuts[c] + 1]) / 2)
                if not s[cuts[c]] <= t < s[cuts[c] + 1]:
                    t = float(s[cuts[c]])
            if best is None or gain > best[0] + 1e-12:
                best = (gain, int(f), t)
        if best is None or (best[0] <= 0 and not random_threshold):
            continue
        gain, f, t = best
        go = x[who, f] <= t
        if go.all() or not go.any():
            continue
        tree.feature[at], tree.threshold[at], tree.gain[at] = f, t, gain
        todo += [(who[~go], depth + 1, at, True), (who[go], depth + 1, at, False)]
    return tree.done()


_TREE = {"max_depth": math.inf, "min_samples_split": 2, "max_features": None, "random_state": None}


class _TreeBase(ArrayEstimator):
    random_threshold = False

    def _grow(self, x, y, w, **kw):
        seed = self.random_state
        rng = np.random.default_rng(seed) if seed is not None or self.random_threshold or self.max_features is not None else None
        self.tree_ = grow(x, y, np.ones(len(y)) if w is None else w, max_depth=self.max_depth, min_samples_split=self.min_samples_split, max_features=self.max_features, rng=rng, random_threshold=self.random_threshold, **kw)
        self.feature_importances_ = self.tree_.importances(x.shape[1])

    def apply_arrays(self, x):
        return self.tree_.apply(x)


class DecisionTreeClassifier(Classifier, _TreeBase):
    params = {**_TREE, "criterion": "gini"}

    def fit_arrays(self, x, y, w=None):
        self.classes_, at = classes_of(y)
        self._grow(x, at, w, criterion=self.criterion, n_classes=len(self.classes_))
        return self

    def proba_arrays(self, x):
        return self.tree_.predict(x)


class DecisionTreeRegressor(Regressor, _TreeBase):
    params = dict(_TREE)

    def fit_arrays(self, x, y, w=None):
        self._grow(x, y, w, criterion="squared")
        return self

    def set_leaf_values(self, values: dict[int, float]) -> None:
        for k, v in values.items():
            self.tree_.value[k] = v

    def predict_arrays(self, x):
        return self.tree_.predict(x)


class ExtraTreeClassifier(DecisionTreeClassifier):
    random_threshold = True


class ExtraTreeRegressor(DecisionTreeRegressor):
    random_threshold = True


# --- forests ------------------------------------------------------------------------


def fit_members(df, columns: list[str], seeds: list[int], fit_one, max_rows: int):
    """fit_one(matrix, seed) for each seed, by tasks over a broadcast of the rows; returns the fitted members."""
    import pickle

    from quarry.operators.base import gather
    from quarry.plans.shipping import ship

    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(gather(df, columns, max_rows))

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"seed": b["seed"], "member": [pickle.dumps(fit_one(sent.value, int(s))) for s in b["seed"]]})

    rows = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds)).mapInPandas(run, "seed long, member binary").collect()
    by = {r.seed: r.member for r in rows}
    return [pickle.loads(by[s]) for s in seeds]  # written by our own tasks just now


class _Ensemble(ArrayEstimator):
    """n_estimators members, each from its seed."""

    def _member(self, x, y, w, seed):
        raise NotImplementedError

    def _prepare(self, y):
        pass

    def _seeds(self):
        return np.random.default_rng(self.random_state).integers(0, 2**31 - 1, self.n_estimators).tolist()

    def fit_arrays(self, x, y, w=None):
        self._prepare(y)
        self.estimators_ = [self._member(x, y, w, s) for s in self._seeds()]
        self._finish(x.shape[1])
        return self

    def fit(self, df, features, label=None, weight=None, order=None):
        from pyspark.sql import functions as F

        p = len(features)
        self._prepare(np.array([r[0] for r in df.select(F.col(label).cast("double")).distinct().collect()]) if isinstance(self, Classifier) else None)
        member = self._member
        one = lambda m, s: member(m[:, :p], m[:, p], m[:, p + 1] if weight else None, s)
        self.estimators_ = fit_members(df, [*features, label, *([weight] if weight else [])], self._seeds(), one, self.max_rows)
        self.features_ = list(features)
        self._finish(p)
        return self

    def _finish(self, p):
        if all(hasattr(e, "feature_importances_") for e in self.estimators_):
            self.feature_importances_ = average_importances(np.array([e.feature_importances_ for e in self.estimators_]))


def _rows(rng, n, bootstrap, size=None):
    size = n if size is None else resolve_subset_size(size, n)
    return rng.integers(0, n, size) if bootstrap else rng.permutation(n)[:size]


class _Votes(Classifier):
    def _prepare(self, y):
        self.classes_ = np.unique(y)

    def proba_arrays(self, x):
        """Shares of the members' votes."""
        votes = np.stack([e.predict_arrays(x) for e in self.estimators_])
        return np.stack([(votes == c).mean(axis=0) for c in self.classes_], axis=1)


class RandomForestClassifier(_Votes, _Ensemble):
    params = {**_TREE, "n_estimators": 100, "bootstrap": True, "max_features": "sqrt", "criterion": "gini"}
    tree = DecisionTreeClassifier

    def _member(self, x, y, w, seed):
        rng = np.random.default_rng(seed)
        who = _rows(rng, len(y), self.bootstrap) if self.bootstrap else np.arange(len(y))
        t = self.tree(max_depth=self.max_depth, min_samples_split=self.min_samples_split, max_features=self.max_features, criterion=self.criterion, random_state=seed)
        return t.fit_arrays(x[who], y[who], None if w is None else w[who])


class ExtraTreesClassifier(RandomForestClassifier):
    params = {"bootstrap": False}
    tree = ExtraTreeClassifier

    def proba_arrays(self, x):
        out = np.zeros((len(x), len(self.classes_)))
        for e in self.estimators_:
            out[:, np.searchsorted(self.classes_, e.classes_)] += e.proba_arrays(x)
        return out / len(self.estimators_)


class RandomForestRegressor(Regressor, _Ensemble):
    params = {**_TREE, "n_estimators": 100, "bootstrap": True}
    tree = DecisionTreeRegressor

    def _member(self, x, y, w, seed):
        rng = np.random.default_rng(seed)
        who = _rows(rng, len(y), True) if self.bootstrap else np.arange(len(y))
        t = self.tree(max_depth=self.max_depth, min_samples_split=self.min_samples_split, max_features=self.max_features, random_state=seed)
        return t.fit_arrays(x[who], y[who], None if w is None else w[who])

    def predict_arrays(self, x):
        return np.mean([e.predict_arrays(x) for e in self.estimators_], axis=0)


class ExtraTreesRegressor(RandomForestRegressor):
    params = {"bootstrap": False, "max_features": "all"}
    tree = ExtraTreeRegressor


class BaggingClassifier(_Votes, _Ensemble):
    params = {"estimator": None, "n_estimators": 10, "max_samples": None, "bootstrap": True, "random_state": None}

    def _member(self, x, y, w, seed):
        who = _rows(np.random.default_rng(seed), len(y), self.bootstrap, self.max_samples)
        return (self.estimator or DecisionTreeClassifier()).clone().fit_arrays(x[who], y[who])


class BaggingRegressor(Regressor, _Ensemble):
    params = {"estimator": None, "n_estimators": 10, "max_samples": None, "bootstrap": True, "random_state": None}

    def _member(self, x, y, w, seed):
        who = _rows(np.random.default_rng(seed), len(y), self.bootstrap, self.max_samples)
        return (self.estimator or DecisionTreeRegressor()).clone().fit_arrays(x[who], y[who])

    predict_arrays = RandomForestRegressor.predict_arrays


class AdaBoostClassifier(Classifier, ArrayEstimator):
    """SAMME over stumps; stops at a perfect stump or one no better than chance."""

    params = {"n_estimators": 50, "learning_rate": 1.0}

    def fit_arrays(self, x, y, w=None):
        self.classes_, at = classes_of(y)
        k = len(self.classes_)
        w = np.ones(len(y)) if w is None else w
        w = w / w.sum()
        self.estimators_, self.weights_ = [], []
        for _ in range(self.n_estimators):
            stump = DecisionTreeClassifier(max_depth=1).fit_arrays(x, at.astype(float), w)
            miss = stump.predict_arrays(x) != at
            err = float(w[miss].sum())
            if err <= 1e-12:
                self.estimators_.append(stump)
                self.weights_.append(self.learning_rate * (math.log((1 - 1e-10) / 1e-10) + math.log(k - 1)))
                break
            if err >= 1 - 1 / k:
                break
            a = self.learning_rate * (math.log((1 - err) / err) + math.log(k - 1))
            self.estimators_.append(stump)
            self.weights_.append(a)
            w = w * np.exp(a * miss)
            w = w / w.sum()
        if not self.estimators_:
            self.estimators_, self.weights_ = [stump], [1.0]
        self.feature_importances_ = weighted_importances(np.array([e.feature_importances_ for e in self.estimators_]), np.array(self.weights_))
        return self

    def decision_arrays(self, x):
        out = np.zeros((len(x), len(self.classes_)))
        for e, a in zip(self.estimators_, self.weights_, strict=True):
            out[np.arange(len(x)), e.predict_arrays(x).astype(int)] += a
        return out

    def proba_arrays(self, x):
        d = self.decision_arrays(x) / max(sum(self.weights_), 1e-300) * (len(self.classes_) - 1)
        e = np.exp(d - d.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class AdaBoostRegressor(Regressor, ArrayEstimator):
    """AdaBoost.R2 with linear loss; predictions are weighted medians."""

    params = {"estimator": None, "n_estimators": 50, "learning_rate": 1.0, "random_state": 0}

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        w = np.full(len(y), 1 / len(y)) if w is None else w / w.sum()
        self.estimators_, self.weights_ = [], []
        for _ in range(self.n_estimators):
            who = rng.choice(len(y), len(y), p=w)
            e = (self.estimator or DecisionTreeRegressor(max_depth=3)).clone().fit_arrays(x[who], y[who])
            miss = np.abs(e.predict_arrays(x) - y)
            top = miss.max()
            loss = miss / top if top > 0 else miss
            err = float((w * loss).sum())
            if err >= 0.5 and self.estimators_:
                break
            beta = max(err, 1e-12) / max(1 - err, 1e-12)
            self.estimators_.append(e)
            self.weights_.append(self.learning_rate * math.log(1 / beta))
            if err <= 0 or err >= 0.5:
                break
            w = w * beta ** ((1 - loss) * self.learning_rate)
            w = w / w.sum()
        return self

    def predict_arrays(self, x):
        p = np.stack([e.predict_arrays(x) for e in self.estimators_], axis=1)
        order = np.argsort(p, axis=1, kind="stable")
        cum = np.cumsum(np.array(self.weights_)[order], axis=1)
        at = (cum >= 0.5 * cum[:, -1:]).argmax(axis=1)
        return p[np.arange(len(x)), order[np.arange(len(x)), at]]


_BOOST = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_samples_split": 2, "subsample": 1.0, "max_features": None, "random_state": None}


def _boost_tree(self, x, r, rng, leaf):
    who = np.arange(len(x)) if self.subsample >= 1 else rng.permutation(len(x))[: max(1, int(self.subsample * len(x)))]
    return grow(x[who], r[who], np.ones(len(who)), criterion="squared", max_depth=self.max_depth, min_samples_split=self.min_samples_split, max_features=self.max_features, rng=rng if self.max_features is not None else None, leaf=lambda k: leaf(who[k]))


class GradientBoostingRegressor(Regressor, ArrayEstimator):
    params = dict(_BOOST)

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        self.start_ = float(np.average(y, weights=w))
        f = np.full(len(y), self.start_)
        self.trees_ = []
        for _ in range(self.n_estimators):
            r = y - f
            t = _boost_tree(self, x, r, rng, lambda k, r=r: r[k].mean())
            self.trees_.append(t)
            f += self.learning_rate * t.predict(x)
        self.feature_importances_ = average_importances(np.array([t.importances(x.shape[1]) for t in self.trees_]))
        return self

    def predict_arrays(self, x):
        return self.start_ + self.learning_rate * sum(t.predict(x) for t in self.trees_)


class GradientBoostingClassifier(Classifier, ArrayEstimator):
    """Log loss with Newton leaf values; one tree for each class in a round of more than two."""

    params = dict(_BOOST)

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        self.classes_, at = classes_of(y)
        k = 1 if len(self.classes_) == 2 else len(self.classes_)
        hot = (at[:, None] == np.arange(len(self.classes_)))[:, -k:].astype(float)
        share = hot.mean(axis=0)
        self.start_ = np.log(share / (1 - share)) if k == 1 else np.log(share)
        f = np.tile(self.start_, (len(y), 1))
        self.trees_ = []
        for _ in range(self.n_estimators):
            p = self._link(f)[:, -k:]
            r = hot - p
            each = []
            for c in range(k):
                scale = 1.0 if k == 1 else (k - 1) / k
                each.append(_boost_tree(self, x, r[:, c], rng, lambda i, g=r[:, c], s=scale: s * g[i].sum() / max((np.abs(g[i]) * (1 - np.abs(g[i]))).sum(), 1e-12)))
            for c in range(k):
                f[:, c] += self.learning_rate * each[c].predict(x)
            self.trees_.append(each)
        self.feature_importances_ = average_importances(np.array([t.importances(x.shape[1]) for e in self.trees_ for t in e]))
        return self

    def _link(self, f):
        if f.shape[1] == 1:
            p = 1 / (1 + np.exp(-f))
            return np.column_stack([1 - p, p])
        e = np.exp(f - f.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def decision_arrays(self, x):
        return self.start_ + self.learning_rate * sum(np.column_stack([t.predict(x) for t in e]) for e in self.trees_)

    def proba_arrays(self, x):
        return self._link(np.atleast_2d(self.decision_arrays(x)))


_XGB = {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6, "reg_lambda": 1.0, "gamma": 0.0, "min_child_weight": 1.0, "subsample": 1.0, "colsample_by_tree": 1.0, "base_score": 0.5, "random_state": None}


def grow_second_order(x, g, h, columns, max_depth, lam, gamma, min_child) -> Tree:
    """A tree by exact greedy gains of gradients and Hessians: 1/2 (GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) - gamma."""
    tree = Tree()
    todo = [(np.arange(len(x)), 0, -1, False)]
    score = lambda a, b: a * a / (b + lam)
    while todo:
        who, depth, parent, is_right = todo.pop()
        gs, hs = g[who].sum(), h[who].sum()
        at = tree.add(float(-gs / (hs + lam)), float(hs))
        if parent >= 0:
            (tree.right if is_right else tree.left)[parent] = at
        if depth >= max_depth or len(who) < 2:
            continue
        best = (0.0, -1, 0.0)
        for f in columns:
            v = x[who, f]
            order = np.argsort(v, kind="stable")
            s = v[order]
            cuts = np.flatnonzero(s[1:] > s[:-1])
            gl, hl = np.cumsum(g[who[order]])[cuts], np.cumsum(h[who[order]])[cuts]
            ok = (hl >= min_child) & (hs - hl >= min_child)
            if not ok.any():
                continue
            gain = np.where(ok, 0.5 * (score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)) - gamma, -np.inf)
            c = int(gain.argmax())
            if gain[c] > best[0] + 1e-12:
                best = (float(gain[c]), int(f), float((s[cuts[c]] + s[cuts[c] + 1]) / 2))
        if best[1] < 0:
            continue
        tree.gain[at], tree.feature[at], tree.threshold[at] = best
        go = x[who, best[1]] <= best[2]
        todo += [(who[~go], depth + 1, at, True), (who[go], depth + 1, at, False)]
    return tree.done()


class _XGBoost(ArrayEstimator):
    def _round(self, x, g, h, rng):
        n, p = x.shape
        who = np.arange(n) if self.subsample >= 1 else np.sort(rng.permutation(n)[: max(1, int(self.subsample * n))])
        cols = np.arange(p) if self.colsample_by_tree >= 1 else np.sort(rng.permutation(p)[: max(1, int(self.colsample_by_tree * p))])
        return grow_second_order(x[who], g[who], h[who], cols, self.max_depth, self.reg_lambda, self.gamma, self.min_child_weight)

    def margins(self, x):
        return self.start_ + self.learning_rate * sum(np.column_stack([t.predict(x) for t in e]) for e in self.trees_)


class XGBoostRegressor(Regressor, _XGBoost):
    params = dict(_XGB)

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        w = np.ones(len(y)) if w is None else w
        self.start_, self.trees_ = np.array([float(self.base_score)]), []
        f = np.full(len(y), self.start_[0])
        for _ in range(self.n_estimators):
            t = self._round(x, w * (f - y), w, rng)
            self.trees_.append([t])
            f = f + self.learning_rate * t.predict(x)
        self.feature_importances_ = average_importances(np.array([t.importances(x.shape[1]) for e in self.trees_ for t in e]))
        return self

    def predict_arrays(self, x):
        return self.margins(x)[:, 0]


class XGBoostClassifier(Classifier, _XGBoost):
    params = dict(_XGB)

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        w = np.ones(len(y)) if w is None else w
        self.classes_, at = classes_of(y)
        k = len(self.classes_)
        if k == 2:
            self.start_ = np.array([math.log(self.base_score / (1 - self.base_score))])
        else:
            self.start_ = np.full(k, float(self.base_score))
        f, self.trees_ = np.tile(self.start_, (len(y), 1)), []
        for _ in range(self.n_estimators):
            if k == 2:
                p = 1 / (1 + np.exp(-f[:, 0]))
                each = [self._round(x, w * (p - at), w * np.maximum(p * (1 - p), 1e-16), rng)]
            else:
                e = np.exp(f - f.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                each = [self._round(x, w * (p[:, c] - (at == c)), w * np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16), rng) for c in range(k)]
            self.trees_.append(each)
            f = f + self.learning_rate * np.column_stack([t.predict(x) for t in each])
        self.feature_importances_ = average_importances(np.array([t.importances(x.shape[1]) for e in self.trees_ for t in e]))
        return self

    proba_arrays = lambda self, x: GradientBoostingClassifier._link(self, self.margins(x))


class IsolationForest(OutlierDetector, ArrayEstimator):
    """1 for outliers, 0 else; score 2^(-mean depth / c(sample))."""

    params = {"subsampling_size": 256, "n_trees": 100, "contamination": "auto", "random_state": 0}

    @staticmethod
    def _expected(n):
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def fit_arrays(self, x, y=None, w=None):
        rng = np.random.default_rng(self.random_state)
        size = min(self.subsampling_size, len(x))
        limit = math.ceil(math.log2(max(size, 2)))
        self.trees_ = []
        for _ in range(self.n_trees):
            t, todo = Tree(), [(rng.permutation(len(x))[:size], 0, -1, False)]
            while todo:
                who, depth, parent, is_right = todo.pop()
                at = t.add(float(depth + self._expected(len(who))), len(who))
                if parent >= 0:
                    (t.right if is_right else t.left)[parent] = at
                lo, hi = x[who].min(axis=0), x[who].max(axis=0)
                can = np.flatnonzero(hi > lo)
                if depth >= limit or len(who) <= 1 or not len(can):
                    continue
                f = int(rng.choice(can))
                cut = float(rng.uniform(lo[f], hi[f]))
                go = x[who, f] <= cut
                t.feature[at], t.threshold[at] = f, cut
                todo += [(who[~go], depth + 1, at, True), (who[go], depth + 1, at, False)]
            self.trees_.append(t.done())
        self.sample_ = size
        self.threshold_ = 0.5
        if self.contamination != "auto":
            self.threshold_ = float(np.quantile(self.anomaly_arrays(x), 1 - self.contamination))
        return self

    def anomaly_arrays(self, x):
        depth = np.mean([t.predict(x) for t in self.trees_], axis=0)
        return 2.0 ** (-depth / max(float(self._expected(self.sample_)), 1e-300))

    def anomaly_score(self, df, output="anomaly"):
        from quarry.operators.base import score_column

        return score_column(df, self.features_, self.anomaly_arrays, output)

    def predict_arrays(self, x):
        return (self.anomaly_arrays(x) > self.threshold_).astype(float)


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and not n.startswith("_")] + ["BaseEstimator"]
