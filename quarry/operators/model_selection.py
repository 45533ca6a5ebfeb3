"""Splitters, cross-validation and searches.

Splitters give each row a ``fold`` from the order of a row id.  The order is
numbered without a single task for all rows (see :func:`numbered`).
"""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators.base import BaseEstimator, is_classifier_like


def numbered(df: DataFrame, order: list[str | Column], name: str = "nth", by: list[str] | None = None) -> DataFrame:
    """df with the rank of each row (from 0) in the order, over all rows or by groups.

    Rows are range-partitioned on the order; ranks are made within partitions
    and moved by the (small) counts of the partitions before.
    """
    by = by or []
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = df.repartitionByRange(n, *[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("__p", F.spark_partition_id())
    part = part.persist()  # ids of partitions must not change between the two uses
    counts = part.groupBy("__p", *by).agg(F.count("*").alias("__n"))
    ahead = counts.withColumn("__a", F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = part.withColumn("__k", F.row_number().over(W.partitionBy("__p", *by).orderBy(*order)) - 1)
    keys = ["__p", *by]
    return local.join(F.broadcast(ahead), keys).withColumn(name, (F.col("__k") + F.col("__a")).cast("long")).drop("__p", "__k", "__a")


def shuffled(row: str, seed: int | None) -> list[Column]:
    """An order by a seeded hash of the row id: the same for the same seed, whatever the partitions."""
    return [F.xxhash64(F.lit(int(seed or 0)), F.col(row)), F.col(row)]


def _sizes(n: int, test_size, train_size) -> tuple[int, int]:
    """Rows of the test part (rounded up) and of the training part (rounded down)."""
    count = lambda s, up: (math.ceil if up else math.floor)(s * n) if isinstance(s, float) else int(s)
    if test_size is None and train_size is None:
        test_size = 0.25
    test = count(test_size, True) if test_size is not None else n - count(train_size, False)
    train = count(train_size, False) if train_size is not None else n - test
    if test <= 0 or train <= 0 or test + train > n:
        raise ValueError("no such split")
    return train, test


def allocate_proportionally(counts: dict, total: int) -> dict:
    """Largest-remainder shares of total; remainders' ties go to the smaller key."""
    n = sum(counts.values())
    exact = {k: v * total / n for k, v in counts.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def train_test_split(df: DataFrame, row: str = "row_id", test_size=None, train_size=None, shuffle: bool = True, random_state: int | None = None, stratify: str | None = None) -> DataFrame:
    """df with ``part``: 'train', 'test' or, of rows that neither size takes, null."""
    order = shuffled(row, random_state) if shuffle else [row]
    n = df.count()
    train, test = _sizes(n, test_size, train_size)
    if stratify is None:
        out = numbered(df, order, "__nth")
        return out.withColumn("part", F.when(F.col("__nth") < train, "train").when(F.col("__nth") < train + test, "test")).drop("__nth")
    counts = {r[0]: r[1] for r in df.groupBy(stratify).count().collect()}
    a = allocate_proportionally(counts, train)
    b = allocate_proportionally({k: v - a[k] for k, v in counts.items()}, test)
    spark = df.sparkSession
    share = spark.createDataFrame([(k, a[k], b[k]) for k in counts], f"{stratify} {df.schema[stratify].dataType.simpleString()}, __a long, __b long")
    out = numbered(df, order, "__nth", [stratify]).join(F.broadcast(share), stratify)
    return out.withColumn("part", F.when(F.col("__nth") < F.col("__a"), "train").when(F.col("__nth") < F.col("__a") + F.col("__b"), "test")).drop("__nth", "__a", "__b")


def reservoir(df: DataFrame, size: int, row: str = "row_id", seed: int = 0) -> DataFrame:
    """A uniform sample of size rows without replacement."""
    return df.orderBy(*shuffled(row, seed)).limit(size)


class _Splitter(BaseEstimator):
    """``assign`` adds ``fold`` (the fold whose test part the row is in)."""

    def assign(self, df: DataFrame, row: str = "row_id", label: str | None = None, groups: str | None = None) -> DataFrame:
        raise NotImplementedError

    def splits(self, df, row="row_id", label=None, groups=None):
        """Pairs of DataFrames (train, test)."""
        out = self.assign(df, row, label, groups).persist()
        for f in range(self.n_splits):
            yield out.where(F.col("fold") != f).drop("fold"), out.where(F.col("fold") == f).drop("fold")


class KFold(_Splitter):
    params = {"n_splits": 5, "shuffle": False, "random_state": None}

    def assign(self, df, row="row_id", label=None, groups=None):
        n, k = df.count(), self.n_splits
        if not 2 <= k <= n:
            raise ValueError("between two folds and as many as rows")
        small, more = divmod(n, k)
        nth = F.col("__nth")
        cut = more * (small + 1)
        fold = F.when(nth < cut, F.floor(nth / (small + 1))).otherwise(more + F.floor((nth - cut) / max(small, 1)))
        return numbered(df, shuffled(row, self.random_state) if self.shuffle else [row], "__nth").withColumn("fold", fold.cast("int")).drop("__nth")


class StratifiedKFold(_Splitter):
    params = {"n_splits": 5, "shuffle": False, "random_state": None}

    def assign(self, df, row="row_id", label=None, groups=None):
        least = df.groupBy(label).count().agg(F.min("count")).first()[0]
        if least < self.n_splits:
            raise ValueError("each class needs as many rows as there are folds")
        out = numbered(df, shuffled(row, self.random_state) if self.shuffle else [row], "__nth", [label])
        return out.withColumn("fold", (F.col("__nth") % self.n_splits).cast("int")).drop("__nth")


def _deal(sizes: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, list[int]]]:
    """Deals (size, number of groups) in turn, each group to the lightest fold (ties: the first).

    Groups of one size go round: while some folds are lighter than all others by at least the size,
    those alone take turns, so a few runs (size, first rank of the run, folds in turn) tell the fold of every group.
    """
    load, runs = [0] * n_splits, []
    for size, many in sizes:
        at = 0
        while at < many:
            order = sorted(range(n_splits), key=lambda i: (load[i], i))
            # folds that get a group before the lightest one gets its second
            turn = [i for i in order if (load[i], i) < (load[order[0]] + size, order[0])]
            rest = [load[i] for i in order[len(turn) :]]
            # whole turns until a fold outside may be next
            rounds = (many - at) // len(turn)
            if rest:
                rounds = min(rounds, (min(rest) - load[turn[-1]]) // size)
            take = max(1, rounds) * len(turn) if rounds else min(len(turn), many - at)
            runs.append((size, at, turn))
            for j, i in enumerate(turn):
                load[i] += size * (take // len(turn) + (j < take % len(turn)))
            at += take
    return runs


class GroupKFold(_Splitter):
    """Largest groups first (ties: larger id), each to the lightest fold.

    Only the histogram of group sizes reaches the driver (distinct sizes: at most the root of twice the
    rows); groups of one size are numbered on the executors and find their fold in the runs of that size.
    """

    params = {"n_splits": 5}

    def assign(self, df, row="row_id", label=None, groups=None):
        counts = df.groupBy(F.col(groups).alias("__g")).agg(F.count("*").alias("__size"))
        sizes = [(r[0], r[1]) for r in counts.groupBy("__size").count().orderBy(F.desc("__size")).collect()]
        if sum(m for _, m in sizes) < self.n_splits:
            raise ValueError("fewer groups than folds")
        ranked = numbered(counts, [F.desc("__size"), F.desc("__g")], "__rank", ["__size"])
        by_size: dict[int, list] = {}
        for size, at, turn in _deal(sizes, self.n_splits):
            by_size.setdefault(size, []).append((at, turn))
        runs = df.sparkSession.createDataFrame(list(by_size.items()), "__size long, __runs array<struct<at: long, turn: array<int>>>")
        mine = F.element_at(F.filter("__runs", lambda r: r["at"] <= F.col("__rank")), -1)
        turn = F.get(mine["turn"], ((F.col("__rank") - mine["at"]) % F.size(mine["turn"])).cast("int"))
        folds = ranked.join(runs, "__size").select("__g", turn.alias("fold"))
        return df.join(folds, F.col(groups).eqNullSafe(F.col("__g"))).drop("__g")


class StratifiedGroupKFold(_Splitter):
    """Groups of the least even labels first, each to the fold that keeps the classes' spread over folds least.

    Each choice depends on all before it, so the counts by group and label come to the driver; more than max_cells are refused.
    """

    params = {"n_splits": 5, "shuffle": False, "random_state": None, "max_cells": 1_000_000}

    def assign(self, df, row="row_id", label=None, groups=None):
        rows = df.groupBy(groups, label).count().limit(self.max_cells + 1).collect()
        if len(rows) > self.max_cells:
            raise ValueError(f"the greedy order needs the counts of all groups in one place and takes at most {self.max_cells} of them")
        classes = sorted({r[1] for r in rows})
        counts: dict = {}
        for g, c, n in rows:
            counts.setdefault(g, np.zeros(len(classes)))[classes.index(c)] += n
        total = sum(counts.values())
        load, size, fold = np.zeros((self.n_splits, len(classes))), np.zeros(self.n_splits), []
        names = sorted(counts)
        if self.shuffle:
            np.random.default_rng(self.random_state).shuffle(names)
        for g in sorted(names, key=lambda g: -counts[g].std()):
            best = None
            for f in range(self.n_splits):
                load[f] += counts[g]
                key = (float((load / total).std(axis=0).mean()), size[f], f)
                load[f] -= counts[g]
                best = key if best is None or key < best else best
            load[best[2]] += counts[g]
            size[best[2]] += counts[g].sum()
            fold.append((g, best[2]))
        table = df.sparkSession.createDataFrame(fold, f"{groups} {df.schema[groups].dataType.simpleString()}, fold int")
        return df.join(table, groups)


class ShuffleSplit(_Splitter):
    """Independent random splits; ``parts`` gives (split, part) rows for each."""

    params = {"n_splits": 10, "test_size": 0.1, "train_size": None, "random_state": 0}
    by_class = False

    def parts(self, df, row="row_id", label=None, groups=None) -> DataFrame:
        out = None
        for s in range(self.n_splits):
            one = train_test_split(df, row, self.test_size, self.train_size, True, (self.random_state or 0) * 1000 + s, label if self.by_class else None).where("part is not null").withColumn("split", F.lit(s))
            out = one if out is None else out.unionByName(one)
        return out

    def splits(self, df, row="row_id", label=None, groups=None):
        p = self.parts(df, row, label, groups).persist()
        for s in range(self.n_splits):
            one = p.where(F.col("split") == s)
            yield one.where("part = 'train'").drop("part", "split"), one.where("part = 'test'").drop("part", "split")


class StratifiedShuffleSplit(ShuffleSplit):
    by_class = True


class GroupShuffleSplit(ShuffleSplit):
    params = {"n_splits": 5, "test_size": 0.2}

    def parts(self, df, row="row_id", label=None, groups=None):
        ids = ShuffleSplit(**self.get_params()).parts(df.select(groups).distinct(), groups)
        return df.join(ids, groups)


class TimeSeriesSplit(_Splitter):
    """Each split tests a later run of rows than it trains on."""

    params = {"n_splits": 5, "max_train_size": None, "test_size": None, "gap": 0}

    def ranges(self, n: int) -> list[tuple[int, int, int, int]]:
        """(train start, train end, test start, test end) of each split."""
        test = self.test_size or n // (self.n_splits + 1)
        if test < 1 or n - test * self.n_splits - self.gap <= 0:
            raise ValueError("too few rows")
        out = []
        for s in range(self.n_splits):
            a = n - (self.n_splits - s) * test
            end = a - self.gap
            out.append((max(0, end - self.max_train_size) if self.max_train_size else 0, end, a, a + test))
        return out

    def parts(self, df, row="row_id", label=None, groups=None):
        r = self.ranges(df.count())
        spark = df.sparkSession
        table = spark.createDataFrame([(s, *x) for s, x in enumerate(r)], "split int, a long, b long, c long, d long")
        out = numbered(df, [row], "__nth").join(F.broadcast(table), (F.col("__nth") >= F.col("a")) & (F.col("__nth") < F.col("d")) & ((F.col("__nth") < F.col("b")) | (F.col("__nth") >= F.col("c"))))
        return out.withColumn("part", F.when(F.col("__nth") < F.col("b"), "train").otherwise("test")).drop("__nth", "a", "b", "c", "d")

    splits = ShuffleSplit.splits


class RepeatedKFold(_Splitter):
    params = {"n_splits": 5, "n_repeats": 10, "random_state": 0}
    inner = KFold

    def assign_repeats(self, df, row="row_id", label=None, groups=None) -> DataFrame:
        out = None
        for r in range(self.n_repeats):
            one = self.inner(n_splits=self.n_splits, shuffle=True, random_state=(self.random_state or 0) * 1000 + r).assign(df, row, label).withColumn("repeat", F.lit(r))
            out = one if out is None else out.unionByName(one)
        return out

    def splits(self, df, row="row_id", label=None, groups=None):
        for r in range(self.n_repeats):
            yield from self.inner(n_splits=self.n_splits, shuffle=True, random_state=(self.random_state or 0) * 1000 + r).splits(df, row, label)


class RepeatedStratifiedKFold(RepeatedKFold):
    inner = StratifiedKFold


class LeaveOneOut(_Splitter):
    def assign(self, df, row="row_id", label=None, groups=None):
        return numbered(df, [row], "fold")

    def splits(self, df, row="row_id", label=None, groups=None):
        out = self.assign(df, row).persist()
        for f in range(out.count()):
            yield out.where(F.col("fold") != f).drop("fold"), out.where(F.col("fold") == f).drop("fold")


SCORERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "accuracyScore": M.accuracy_score,
    "f1Score": M.f1_score,
    "r2Score": M.r2_score,
    "negMeanSquaredError": lambda df, p, y: M.mean_squared_error(df, p, y).select((-F.col("value")).alias("value")),
}


def resolve_scoring(scoring, estimator) -> Callable[[DataFrame, str, str], float]:
    if callable(scoring):
        return scoring
    name = scoring or ("accuracyScore" if is_classifier_like(estimator) else "r2Score")
    if name not in SCORERS:
        raise ValueError(f"no score is named {name}")
    return lambda df, p, y: float(SCORERS[name](df, p, y).first()[0])


def _cv(cv, estimator, stratify: bool):
    if isinstance(cv, int):
        return (StratifiedKFold if stratify and is_classifier_like(estimator) else KFold)(n_splits=cv)
    return cv


def cross_validate(estimator, df, features, label, cv=5, scoring=None, return_train_score=False, groups=None, row="row_id", stratify=True) -> list[dict]:
    """Scores, seconds and, if asked for, training scores of each fold; scoring: a name or {name: name}."""
    named = scoring if isinstance(scoring, dict) else {"score": scoring}
    out = []
    for train, test in _cv(cv, estimator, stratify).splits(df, row, label, groups):
        est, began = estimator.clone(), time.time()
        est.fit(train, features, label)
        row_out = {"fit_time": time.time() - began}
        for name, s in named.items():
            score = resolve_scoring(s, estimator)
            row_out[f"test_{name}"] = score(est.predict(test), "prediction", label)
            if return_train_score:
                row_out[f"train_{name}"] = score(est.predict(train), "prediction", label)
        out.append(row_out)
    return out


def cross_val_score(estimator, df, features, label, cv=5, scoring=None, groups=None, row="row_id") -> list[float]:
    return [r["test_score"] for r in cross_validate(estimator, df, features, label, cv, scoring, False, groups, row)]


def cross_val_predict(estimator, df, features, label, cv=5, groups=None, row="row_id") -> DataFrame:
    """df with the prediction of the model that didn't see the row."""
    out, n = None, 0
    for train, test in _cv(cv, estimator, True).splits(df, row, label, groups):
        est = estimator.clone()
        est.fit(train, features, label)
        part = est.predict(test)
        out = part if out is None else out.unionByName(part)
        n += test.count()
    if n != df.count():
        raise ValueError("the folds don't cover each row once")
    return out


class GridSearchCV(BaseEstimator):
    params = {"estimator": None, "param_grid": None, "cv": 5, "scoring": None, "refit": True}
    stratify = False

    def candidates(self) -> list[dict]:
        grids = self.param_grid if isinstance(self.param_grid, list) else [self.param_grid]
        return [dict(zip(g, v, strict=True)) for g in grids for v in itertools.product(*g.values())]

    @property
    def kind(self):
        return self.estimator.kind

    def fit(self, df, features, label, row="row_id", groups=None):
        self.results_ = []
        best = None
        for c in self.candidates():
            est = self.estimator.clone()
            est.set_params(**c)
            scores = [r["test_score"] for r in cross_validate(est, df, features, label, self.cv, self.scoring, False, groups, row, stratify=False)]
            mean = float(np.mean(scores))
            self.results_.append({"params": c, "scores": scores, "mean": mean})
            if best is None or mean > best[0]:
                best = (mean, c)
        self.best_score_, self.best_params_ = best
        if self.refit:
            self.best_estimator_ = self.estimator.clone()
            self.best_estimator_.set_params(**self.best_params_)
            self.best_estimator_.fit(df, features, label)
        return self

    def predict(self, df, output="prediction"):
        return self.best_estimator_.predict(df, output)

    def score(self, df, label):
        return self.best_estimator_.score(df, label)


class RandomizedSearchCV(GridSearchCV):
    params = {"n_iter": 10, "random_state": 0}

    def candidates(self):
        grid = super().candidates()
        order = np.random.default_rng(self.random_state).permutation(len(grid))
        return [grid[i] for i in order[: self.n_iter]]


def learning_curve(estimator, df, features, label, train_sizes=(0.1, 0.325, 0.55, 0.775, 1.0), cv=5, scoring=None, row="row_id") -> list[dict]:
    score, out = resolve_scoring(scoring, estimator), []
    for f, (train, test) in enumerate(_cv(cv, estimator, True).splits(df, row, label)):
        n = train.count()
        inner = numbered(train, [row], "__nth").persist()
        for s in train_sizes:
            k = int(s * n) if isinstance(s, float) else int(s)
            est, part = estimator.clone(), inner.where(F.col("__nth") < k).drop("__nth")
            est.fit(part, features, label)
            out.append({"fold": f, "size": k, "train": score(est.predict(part), "prediction", label), "test": score(est.predict(test), "prediction", label)})
    return out


def validation_curve(estimator, df, features, label, param_name, param_range, cv=5, scoring=None, row="row_id") -> list[dict]:
    out = []
    for v in param_range:
        est = estimator.clone()
        est.set_params(**{param_name: v})
        for f, r in enumerate(cross_validate(est, df, features, label, cv, scoring, True, None, row)):
            out.append({"value": v, "fold": f, "train": r["train_score"], "test": r["test_score"]})
    return out


def permutation_importance(estimator, df, features, label, n_repeats=5, random_state=0, scoring=None, row="row_id") -> dict[str, list[float]]:
    """Drops of the score when one column is dealt anew; the new order pairs rows by their ranks in two orders."""
    score = resolve_scoring(scoring, estimator)
    base = score(estimator.predict(df), "prediction", label)
    out = {}
    plain = numbered(df, [row], "__nth").persist()
    for c in features:
        drops = []
        for r in range(n_repeats):
            other = numbered(df.select(row, c), shuffled(row, random_state * 1000 + r), "__nth").select("__nth", F.col(c).alias("__v"))
            dealt = plain.join(other, "__nth").withColumn(c, F.col("__v")).drop("__v", "__nth")
            drops.append(base - score(estimator.predict(dealt), "prediction", label))
        out[c] = drops
    plain.unpersist()
    return out


def partial_dependence(estimator, df, features: list[str], grid_resolution=100, percentiles=(0.05, 0.95)) -> DataFrame:
    """Mean prediction on a grid of one or two columns: a broadcast of the grid, one grouped mean."""
    axes = []
    for c in features:
        values = [r[0] for r in df.select(F.col(c).cast("double")).distinct().limit(grid_resolution).collect()]
        if len(values) < grid_resolution:
            axes.append(sorted(values))
        else:
            lo, hi = df.agg(F.percentile(c, F.array(F.lit(percentiles[0]), F.lit(percentiles[1])))).first()[0]
            axes.append(np.linspace(lo, hi, grid_resolution).tolist())
    grid = df.sparkSession.createDataFrame([tuple(map(float, v)) for v in itertools.product(*axes)], ", ".join(f"__g{i} double" for i in range(len(features))))
    cross = df.drop(*features).crossJoin(F.broadcast(grid)).withColumns({c: F.col(f"__g{i}") for i, c in enumerate(features)})
    return estimator.predict(cross).groupBy(*features).agg(F.avg("prediction").alias("value"))
