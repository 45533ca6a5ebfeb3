"""Neighbour operators.

Searches compare every query with every fitted row.  The fitted rows are dealt to
blocks and the queries to chunks; a task compares one chunk with one block and keeps
the k best, so nothing is limited by a task's memory and only k rows for each
(query, block) are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.distances import pairwise, product_squares
from quarry.operators.base import MAX_ROWS, BaseEstimator, Classifier, Clusterer, OutlierDetector, Regressor, classes_of
from quarry.plans.aggregate import class_moments
from quarry.plans.shipping import ship

BLOCK, CHUNK = 8192, 4096
#: The label of a neighbour, under a name that can't be one of its other columns.
LABEL = "__label"


def _vectors(df: DataFrame, row: str, features: list[str], extra: list[str]) -> DataFrame:
    return df.select(F.col(row).cast("long").alias("row"), F.array(*[F.col(c).cast("double") for c in features]).alias("__v"), *[F.col(c).cast("double").alias(c) for c in extra])


def neighbour_pairs(queries: DataFrame, base: DataFrame, features: list[str], row: str = "row_id", k: int | None = None, radius: float | None = None, metric: str = "euclidean", p: float = 2, skip_self: bool = False, extra: list[str] | None = None) -> DataFrame:
    """(query, neighbour, d, *extra of the neighbour): the k nearest by (distance, row), or all within the radius."""
    extra = extra or []
    ship(queries.sparkSession)
    n, m = base.count(), queries.count()
    rows, cols = -(-n // BLOCK) or 1, -(-m // CHUNK) or 1
    left = _vectors(queries, row, features, []).select("row", "__v", F.pmod(F.xxhash64("row"), F.lit(cols)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("b"))
    right = _vectors(base, row, features, extra).select("row", "__v", *extra, F.pmod(F.xxhash64("row"), F.lit(rows)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "neighbour": [], "d": [], **{c: [] for c in extra}}).astype({"query": "int64", "neighbour": "int64"})
        b = b.sort_values("row", kind="stable")
        ids, base_v, q = b["row"].to_numpy(), np.stack(b["__v"].to_list()), np.stack(a["__v"].to_list())
        qs, at, ds = [], [], []
        for s in range(0, len(q), 256):
            d = pairwise(q[s : s + 256], base_v, metric, p)
            if skip_self:
                d[a["row"].to_numpy()[s : s + 256, None] == ids[None]] = np.nan
            if k is not None:
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(d)), near.shape[1]), near.ravel()
                ok = ~np.isnan(d[i, j])
                i, j = i[ok], j[ok]
            else:
                i, j = np.nonzero(d <= radius)
            qs.append(a["row"].to_numpy()[s + i])
            at.append(j)
            ds.append(d[i, j])
        j = np.concatenate(at)
        return pd.DataFrame({"query": np.concatenate(qs), "neighbour": ids[j], "d": np.concatenate(ds), **{c: b[c].to_numpy()[j] for c in extra}})

    ddl = "query long, neighbour long, d double" + "".join(f", {c} double" for c in extra)
    pairs = left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInPandas(cell, ddl)
    if k is None:
        return pairs
    best = pairs.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "neighbour", *extra))), 1, k).alias("best"))
    return best.select("query", F.inline("best")).select("query", "neighbour", "d", *extra)


def resolve_distance_weights(pairs: DataFrame, weights: str) -> DataFrame:
    """pairs with ``w``: 1, or 1/d; where a query has a neighbour at distance 0, only such count."""
    if weights == "uniform":
        return pairs.withColumn("w", F.lit(1.0))
    zero = pairs.groupBy("query").agg(F.max((F.col("d") == 0).cast("int")).alias("zero"))
    return pairs.join(zero, "query").withColumn("w", F.when(F.col("zero") == 1, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("d")))).drop("zero")


def weighted_mode(pairs: DataFrame, label: str) -> DataFrame:
    """(query, prediction): the label of the largest weight, ties to the smallest label."""
    votes = pairs.groupBy("query", label).agg(F.sum("w").alias("w"))
    return votes.groupBy("query").agg(F.min_by(label, F.struct(-F.col("w"), F.col(label))).alias("prediction"))


class _Neighbours(BaseEstimator):
    params = {"metric": "euclidean", "p": 2, "weights": "uniform"}

    def fit(self, df: DataFrame, features: list[str], label: str | None = None, weight: str | None = None, row: str = "row_id"):
        self.features_, self.label_, self.row_ = list(features), label, row
        self._base = df
        return self

    def _pairs(self, df, **kw):
        base = self._base.withColumn(LABEL, F.col(self.label_)) if self.label_ else self._base
        return neighbour_pairs(df, base, self.features_, self.row_, metric=self.metric, p=self.p, extra=[LABEL] if self.label_ else [], **kw)

    def _join(self, df, predicted, output):
        return df.join(predicted.withColumnRenamed("query", self.row_).withColumnRenamed("prediction", output), self.row_, "left")


class KNeighborsClassifier(Classifier, _Neighbours):
    params = {"n_neighbors": 5}

    def predict(self, df, output="prediction"):
        return self._join(df, weighted_mode(resolve_distance_weights(self._pairs(df, k=self.n_neighbors), self.weights), LABEL), output)

    def predict_proba(self, df, output="probability"):
        w = resolve_distance_weights(self._pairs(df, k=self.n_neighbors), self.weights)
        share = w.groupBy("query", LABEL).agg(F.sum("w").alias("w"))
        total = share.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct(F.col(LABEL), F.col("w")))).alias("m"), F.sum("w").alias("t"))
        return self._join(df, total.select("query", F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"], e["value"] / F.col("t")))).alias("prediction")), output)

    def fit_arrays(self, x, y, w=None):
        self.x_, self.y_ = x, y
        self.classes_ = np.unique(y)
        return self

    def proba_arrays(self, x):
        d = pairwise(x, self.x_, self.metric, self.p)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.n_neighbors]
        dist = np.take_along_axis(d, near, axis=1)
        if self.weights == "uniform":
            w = np.ones_like(dist)
        else:
            zero = dist == 0
            w = np.where(zero.any(axis=1, keepdims=True), zero, 1 / np.where(zero, 1, dist))
        out = np.stack([(w * (self.y_[near] == c)).sum(axis=1) for c in self.classes_], axis=1)
        return out / out.sum(axis=1, keepdims=True)


class KNearestNeighbors(KNeighborsClassifier):
    pass


KNearstNeighbors = KNearestNeighbors


class KNeighborsRegressor(Regressor, _Neighbours):
    params = {"n_neighbors": 5}

    def predict(self, df, output="prediction"):
        w = resolve_distance_weights(self._pairs(df, k=self.n_neighbors), self.weights)
        return self._join(df, w.groupBy("query").agg((F.sum(F.col("w") * F.col(LABEL)) / F.sum("w")).alias("prediction")), output)


class RadiusNeighborsClassifier(Classifier, _Neighbours):
    params = {"radius": 1.0, "outlier_label": None}

    def predict(self, df, output="prediction"):
        out = self._join(df, weighted_mode(resolve_distance_weights(self._pairs(df, radius=self.radius), self.weights), LABEL), output)
        lone = F.lit(float(self.outlier_label)) if self.outlier_label is not None else F.raise_error(F.lit("a row has no neighbour within the radius")).cast("double")
        return out.withColumn(output, F.when(F.col(output).isNull(), lone).otherwise(F.col(output)))


class RadiusNeighborsRegressor(Regressor, _Neighbours):
    params = {"radius": 1.0}

    def predict(self, df, output="prediction"):
        w = resolve_distance_weights(self._pairs(df, radius=self.radius), self.weights)
        out = self._join(df, w.groupBy("query").agg((F.sum(F.col("w") * F.col(LABEL)) / F.sum("w")).alias("prediction")), output)
        return out.withColumn(output, F.coalesce(output, F.lit(float("nan"))))


class NearestNeighbors(_Neighbours):
    """Searches; without a table to look up, the fitted rows are the queries and don't find themselves."""

    params = {"n_neighbors": 5, "radius": 1.0, "algorithm": "auto", "leaf_size": 30}

    def kneighbors(self, df: DataFrame | None = None, n_neighbors: int | None = None) -> DataFrame:
        return self._pairs(self._base if df is None else df, k=n_neighbors or self.n_neighbors, skip_self=df is None)

    def radius_neighbors(self, df: DataFrame | None = None, radius: float | None = None) -> DataFrame:
        return self._pairs(self._base if df is None else df, radius=self.radius if radius is None else radius, skip_self=df is None)


class _Tree:
    """A space-partitioning tree over rows of a matrix; results as by brute force, ties by row."""

    def __init__(self, x: np.ndarray, leaf_size: int = 40, metric: str = "euclidean", p: float = 2) -> None:
        self.x, self.leaf_size, self.metric, self.p = np.asarray(x, float), leaf_size, metric, p
        self.nodes: list[tuple] = []
        self._build(np.arange(len(self.x)))

    @classmethod
    def of(cls, df: DataFrame, features: list[str], row: str = "row_id", max_rows: int = MAX_ROWS, **kw):
        """The tree of a bounded table; its rows keep their ids, and ties go to the smaller id."""
        rows = df.select(F.col(row).cast("long").alias("__row"), *[F.col(c).cast("double") for c in features]).limit(max_rows + 1).toPandas()
        if len(rows) > max_rows:
            raise ValueError(f"a tree needs its rows in one place and takes at most {max_rows}")
        rows = rows.sort_values("__row", kind="stable")
        out = cls(rows[list(features)].to_numpy(np.float64), **kw)
        out.ids = rows["__row"].to_numpy(np.int64)
        return out

    def kneighbors(self, df: DataFrame, features: list[str], k: int = 1, row: str = "row_id") -> DataFrame:
        """(query, neighbour, d): the k nearest rows of the tree for each row of df, found by the executors."""
        ship(df.sparkSession)
        tree = df.sparkSession.sparkContext.broadcast(self)

        def search(batches):
            for b in batches:
                d, i = tree.value.query(b[list(features)].to_numpy(np.float64), k)
                yield pd.DataFrame({"query": np.repeat(b["__row"].to_numpy(), i.shape[1]), "neighbour": tree.value.ids[i].ravel(), "d": d.ravel()})

        rows = df.select(F.col(row).cast("long").alias("__row"), *[F.col(c).cast("double").alias(c) for c in features])
        return rows.mapInPandas(search, "query long, neighbour long, d double")

    def _build(self, who: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        x = self.x[who]
        bound = self._bound(x)
        if len(who) <= self.leaf_size or (x == x[0]).all():
            self.nodes[at] = (bound, who, -1, -1)
            return at
        axis = int(x.var(axis=0).argmax())
        order = np.argsort(x[:, axis], kind="stable")
        half = len(who) // 2
        left, right = self._build(who[order[:half]]), self._build(who[order[half:]])
        self.nodes[at] = (bound, None, left, right)
        return at

    def _search(self, q: np.ndarray, k: int | None, radius: float | None) -> tuple[np.ndarray, np.ndarray]:
        found_d, found_i, todo = np.zeros(0), np.zeros(0, int), [(0.0, 0)]
        while todo:
            todo.sort(reverse=True)
            least, at = todo.pop()
            limit = radius if k is None else (found_d[-1] if len(found_d) >= k else np.inf)
            if least > limit:
                break
            _, who, left, right = self.nodes[at]
            if who is None:
                todo += [(self._least(self.nodes[c][0], q), c) for c in (left, right)]
                continue
            d = pairwise(q[None], self.x[who], self.metric, self.p)[0]
            found_d, found_i = np.concatenate([found_d, d]), np.concatenate([found_i, who])
            order = np.lexsort((found_i, found_d))
            order = order[:k] if k is not None else order[found_d[order] <= radius]
            found_d, found_i = found_d[order], found_i[order]
        return found_d, found_i

    def _leaves(self) -> tuple[list, list, np.ndarray]:
        """Bounds, rows and means of the leaves."""
        if not hasattr(self, "_held"):
            leaves = [(bound, who) for bound, who, _, _ in self.nodes if who is not None]
            self._held = [b for b, _ in leaves], [w for _, w in leaves], np.array([self.x[w].mean(axis=0) for _, w in leaves])
        return self._held

    def query(self, x: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Queries near the same leaf go together: its rows bound their distances, and only leaves within a bound are compared."""
        x = np.atleast_2d(np.asarray(x, float))
        k = min(k, len(self.x))
        bounds, members, means = self._leaves()
        home = np.concatenate([product_squares(x[s : s + 256], means).argmin(axis=1) for s in range(0, len(x), 256)]) if len(x) else np.zeros(0, int)
        found_d, found_i = np.empty((len(x), k)), np.empty((len(x), k), int)
        order = np.argsort(home, kind="stable")
        for s in range(0, len(x), 128):
            at = order[s : s + 128]
            q, limit = x[at], np.full(len(at), np.inf)
            for h in np.unique(home[at]):
                if len(members[h]) >= k:
                    mine = home[at] == h
                    limit[mine] = np.partition(pairwise(q[mine], self.x[members[h]], self.metric, self.p), k - 1, axis=1)[:, k - 1]
            near = np.flatnonzero((~(self._least_all(bounds, q) > limit[:, None])).any(axis=0))
            rows = np.sort(np.concatenate([members[h] for h in near])) if len(near) < len(members) else np.arange(len(self.x))
            base = self.x[rows] if len(near) < len(members) else self.x
            d = product_squares(q, base) if self.metric == "euclidean" else pairwise(q, base, self.metric, self.p)
            most = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-8)
            for i, v in enumerate(d):
                who = np.flatnonzero(v <= most[i])
                who = who if len(who) >= k else np.arange(len(v))
                exact = pairwise(q[i : i + 1], base[who], self.metric, self.p)[0]
                best = np.argsort(exact, kind="stable")[:k]
                found_d[at[i]], found_i[at[i]] = exact[best], rows[who[best]]
        return found_d, found_i

    def query_radius(self, x: np.ndarray, r: float) -> list[np.ndarray]:
        return [self._search(q, None, r)[1] for q in np.atleast_2d(x)]


class KDTree(_Tree):
    def _bound(self, x):
        return x.min(axis=0), x.max(axis=0)

    def _least(self, bound, q):
        nearest = np.clip(q, *bound)
        return float(pairwise(q[None], nearest[None], self.metric, self.p)[0, 0])

    def _least_all(self, bounds, q):
        low, high = (np.array([b[i] for b in bounds]) for i in (0, 1))
        none = np.zeros((1, q.shape[1]))
        return np.stack([pairwise(none, np.maximum(low - v, 0) + np.maximum(v - high, 0), self.metric, self.p)[0] for v in q]) * (1 - 1e-9)


class BallTree(_Tree):
    def _bound(self, x):
        c = x.mean(axis=0)
        return c, float(pairwise(c[None], x, self.metric, self.p).max())

    def _least(self, bound, q):
        return max(0.0, float(pairwise(q[None], bound[0][None], self.metric, self.p)[0, 0]) - bound[1] * (1 + 1e-12))

    def _least_all(self, bounds, q):
        centres, radius = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
        d = np.sqrt(product_squares(q, centres)) if self.metric == "euclidean" else pairwise(q, centres, self.metric, self.p)
        return d * (1 - 1e-9) - radius[None] * (1 + 1e-9)


class NearestCentroid(Classifier, BaseEstimator):
    """Means (medians for manhattan) of each class from one grouped aggregate; ties to the smaller label."""

    params = {"metric": "euclidean", "p": 2}

    def fit(self, df, features, label, weight=None):
        self.features_ = list(features)
        if self.metric == "manhattan":
            g = df.groupBy(F.col(label).alias("label")).agg(*[F.median(c).alias(f"mean_{i}") for i, c in enumerate(features)])
        else:
            g = class_moments(df, features, label)
        rows = sorted(g.collect(), key=lambda r: r.label)
        self.classes_ = np.array([float(r.label) for r in rows])
        self.centroids_ = np.array([[r[f"mean_{i}"] for i in range(len(features))] for r in rows], float)
        return self

    def predict_arrays(self, x):
        return self.classes_[pairwise(x, self.centroids_, self.metric, self.p).argmin(axis=1)]


class LocalOutlierFactor(OutlierDetector, BaseEstimator):
    """Scores of the fitted rows from one table of nearest neighbours and two joins with it."""

    params = {"n_neighbors": 20, "contamination": "auto", "metric": "euclidean", "p": 2, "novelty": False}

    def _densities(self, pairs, k_dist):
        reach = pairs.join(k_dist.withColumnRenamed("query", "neighbour"), "neighbour").withColumn("reach", F.greatest("d", "k"))
        return reach.groupBy("query").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))

    def fit(self, df, features, label=None, row="row_id"):
        self.features_, self.row_, self._base = list(features), row, df
        pairs = neighbour_pairs(df, df, features, row, k=self.n_neighbors, metric=self.metric, p=self.p, skip_self=True).persist()
        self._k = pairs.groupBy("query").agg(F.max("d").alias("k"))
        self._lrd = self._densities(pairs, self._k).persist()
        self._scores = self._factor(pairs, self._lrd)
        self.offset_ = -1.5 if self.contamination == "auto" else float(self._scores.agg(F.percentile(-F.col("lof"), float(self.contamination))).first()[0])
        return self

    def _factor(self, pairs, lrd):
        near = self._lrd.withColumnRenamed("query", "neighbour").withColumnRenamed("lrd", "lrd_n")
        return pairs.join(near, "neighbour").groupBy("query").agg(F.avg("lrd_n").alias("m")).join(lrd, "query").select("query", (F.col("m") / F.col("lrd")).alias("lof"))

    def score_samples(self) -> DataFrame:
        """(row, lof) of the fitted rows; about 1 inside, larger outside."""
        return self._scores.withColumnRenamed("query", self.row_)

    def predict(self, df=None, output="prediction"):
        """-1 for outliers; of new rows (novelty) or of the fitted ones."""
        if df is None or not self.novelty:
            s, df = self._scores, self._base if df is None else df
        else:
            pairs = neighbour_pairs(df, self._base, self.features_, self.row_, k=self.n_neighbors, metric=self.metric, p=self.p)
            s = self._factor(pairs, self._densities(pairs, self._k))
        flag = s.select(F.col("query").alias(self.row_), F.when(-F.col("lof") < self.offset_, -1.0).otherwise(1.0).alias(output))
        return df.join(flag, self.row_, "left")


def density_shape(kernel: str, u: np.ndarray) -> np.ndarray:
    """Kernel heights at distances u, in bandwidths, without the norming constant."""
    inside = u < 1
    return {"gaussian": lambda: np.exp(-u * u / 2), "exponential": lambda: np.exp(-u), "tophat": lambda: inside * 1.0, "epanechnikov": lambda: np.where(inside, 1 - u * u, 0), "linear": lambda: np.where(inside, 1 - u, 0), "cosine": lambda: np.where(inside, np.cos(np.pi * u / 2), 0)}[kernel]()


class KernelDensity(BaseEstimator):
    """Log densities by a sum over all fitted rows, in the blocks of the neighbour search."""

    params = {"bandwidth": 1.0, "kernel": "gaussian"}

    def fit(self, df, features, label=None, row="row_id"):
        self.features_, self.row_, self._base, self.n_ = list(features), row, df, df.count()
        return self

    def _log_norm(self) -> float:
        """Log of the kernel's integral over the space, for bandwidth 1, by shells."""
        import math

        p = len(self.features_)
        ball = p / 2 * math.log(math.pi) - math.lgamma(p / 2 + 1)
        if self.kernel == "gaussian":
            return p / 2 * math.log(2 * math.pi)
        if self.kernel == "exponential":
            return ball + math.log(p) + math.lgamma(p)
        nodes, weights = np.polynomial.legendre.leggauss(64)
        r = (nodes + 1) / 2
        return ball + math.log(p * float((weights / 2 * r ** (p - 1) * density_shape(self.kernel, r)).sum()))

    def score_samples(self, df, output="log_density"):
        import math

        ship(df.sparkSession)
        h, name = self.bandwidth, self.kernel
        rows, cols = -(-self.n_ // BLOCK) or 1, -(-df.count() // CHUNK) or 1
        left = _vectors(df, self.row_, self.features_, []).select("row", "__v", F.pmod(F.xxhash64("row"), F.lit(cols)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("b"))
        right = _vectors(self._base, self.row_, self.features_, []).select("row", "__v", F.pmod(F.xxhash64("row"), F.lit(rows)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))

        def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"row": [], "s": []}).astype({"row": "int64"})
            d = pairwise(np.stack(a["__v"].to_list()), np.stack(b["__v"].to_list())) / h
            return pd.DataFrame({"row": a["row"], "s": density_shape(name, d).sum(axis=1)})

        sums = left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInPandas(cell, "row long, s double").groupBy("row").agg(F.sum("s").alias("s"))
        shift = self._log_norm() + len(self.features_) * math.log(h) + math.log(self.n_)
        log = F.when(F.col("s") > 0, F.log("s") - shift).otherwise(F.lit(float("-inf")))
        return df.join(sums.select(F.col("row").alias(self.row_), log.alias(output)), self.row_, "left")

    def score(self, df) -> float:
        return float(self.score_samples(df).agg(F.sum("log_density")).first()[0])


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and not n.startswith("_")] + ["KNearstNeighbors", "Clusterer", "classes_of"]
