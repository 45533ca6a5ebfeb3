"""Scalers, encoders, imputers and other column transforms.

Fitting is one aggregate (or one small dictionary); transforming is a projection
of built-in expressions, so it stays in generated code.  Fitted columns keep
their names; ``transform`` replaces them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.base import BaseEstimator, Transformer


def number(c: str) -> Column:
    """The column as DOUBLE, null for NaN."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


class _ColumnTransformer(Transformer, BaseEstimator):
    """Replaces each fitted column by ``forward`` of it (``backward`` undoes that)."""

    def fit(self, df: DataFrame, features: list[str], label: str | None = None):
        self.features_ = list(features)
        self._fit(df, features)
        return self

    def _fit(self, df: DataFrame, features: list[str]) -> None:
        pass

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.forward(F.col(c).cast("double"), i) for i, c in enumerate(self.features_)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.backward(F.col(c).cast("double"), i) for i, c in enumerate(self.features_)})


def _collect(df: DataFrame, features: list[str], **aggs) -> dict[str, list]:
    row = df.agg(*[f(number(c)).alias(f"{name}{i}") for name, f in aggs.items() for i, c in enumerate(features)]).first()
    return {name: [row[f"{name}{i}"] for i in range(len(features))] for name in aggs}


class StandardScaler(_ColumnTransformer):
    params = {"with_mean": True, "with_std": True}

    def _fit(self, df, features):
        s = _collect(df, features, m=F.avg, s=F.stddev_pop)
        self.mean_, self.scale_ = s["m"], [x or 1.0 for x in s["s"]]

    def forward(self, x, i):
        x = x - self.mean_[i] if self.with_mean else x
        return x / self.scale_[i] if self.with_std else x

    def backward(self, x, i):
        x = x * self.scale_[i] if self.with_std else x
        return x + self.mean_[i] if self.with_mean else x


class MinMaxScaler(_ColumnTransformer):
    params = {"feature_range": (0.0, 1.0)}

    def _fit(self, df, features):
        s = _collect(df, features, lo=F.min, hi=F.max)
        self.min_, self.max_ = s["lo"], s["hi"]

    def forward(self, x, i):
        a, b = self.feature_range
        span = self.max_[i] - self.min_[i]
        return a + (x - self.min_[i]) / span * (b - a) if span else F.lit(float(a))

    def backward(self, x, i):
        a, b = self.feature_range
        return self.min_[i] + (x - a) / (b - a) * (self.max_[i] - self.min_[i])


class MaxAbsScaler(_ColumnTransformer):
    def _fit(self, df, features):
        self.scale_ = [x or 1.0 for x in _collect(df, features, m=lambda c: F.max(F.abs(c)))["m"]]

    def forward(self, x, i):
        return x / self.scale_[i]

    def backward(self, x, i):
        return x * self.scale_[i]


class RobustScaler(_ColumnTransformer):
    params = {"with_centering": True, "with_scaling": True, "quantile_range": (25.0, 75.0), "unit_variance": False}

    def _fit(self, df, features):
        lo, hi = (q / 100 for q in self.quantile_range)
        s = _collect(df, features, q=lambda c: F.percentile(c, F.array(F.lit(lo), F.lit(0.5), F.lit(hi))))["q"]
        self.center_ = [q[1] for q in s]
        adjust = norm_ppf(hi) - norm_ppf(lo) if self.unit_variance else 1.0
        self.scale_ = [((q[2] - q[0]) / adjust) or 1.0 for q in s]

    def forward(self, x, i):
        x = x - self.center_[i] if self.with_centering else x
        return x / self.scale_[i] if self.with_scaling else x

    def backward(self, x, i):
        x = x * self.scale_[i] if self.with_scaling else x
        return x + self.center_[i] if self.with_centering else x


class Normalizer(_ColumnTransformer):
    """Row-wise; a row of zeros stays."""

    params = {"norm": "l2"}

    def transform(self, df):
        cs = [F.col(c).cast("double") for c in self.features_]
        total = {"l1": sum((F.abs(c) for c in cs), F.lit(0.0)), "l2": F.sqrt(sum((c * c for c in cs), F.lit(0.0))), "max": F.greatest(*[F.abs(c) for c in cs], F.lit(0.0))}[self.norm]
        return df.withColumn("__norm", total).withColumns({c: F.when(F.col("__norm") == 0, 0.0).otherwise(F.try_divide(F.col(c).cast("double"), F.col("__norm"))) for c in self.features_}).drop("__norm")


class Binarizer(_ColumnTransformer):
    params = {"threshold": 0.0}

    def forward(self, x, i):
        return (x > self.threshold).cast("double")


class FunctionTransformer(_ColumnTransformer):
    """Named functions (identity, log1p, expm1) or functions of a Column."""

    params = {"func": "identity", "inverse_func": "identity"}
    named = {"identity": lambda c: c, "log1p": F.log1p, "expm1": F.expm1}

    def forward(self, x, i):
        return (self.named[self.func] if isinstance(self.func, str) else self.func)(x)

    def backward(self, x, i):
        return (self.named[self.inverse_func] if isinstance(self.inverse_func, str) else self.inverse_func)(x)


def norm_ppf(p: float) -> float:
    """Quantile of the standard normal distribution (Acklam's rational approximation; coefficients are fixed values)."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
    poly = lambda k, x: np.polyval(k, x)
    if p <= 0 or p >= 1:
        return -math.inf if p <= 0 else math.inf
    if p < 0.02425 or p > 1 - 0.02425:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        v = float(poly(c, q) / poly((*d, 1), q))
        return v if p < 0.5 else -v
    q = p - 0.5
    r = q * q
    return float(poly(a, r) * q / poly((*b, 1), r))


def norm_cdf(x: Column | str) -> Column:
    """Distribution function of the standard normal (Abramowitz and Stegun 7.1.26; coefficients are fixed values)."""
    z = (F.col(x) if isinstance(x, str) else x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * F.abs(z))
    k = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        k = (k + c) * t
    erf = F.signum(z) * (1 - k * F.exp(-z * z))
    return 0.5 * (1 + erf)


class PowerTransformer(_ColumnTransformer):
    """Maximum-likelihood power transforms: one aggregate for a grid of lambdas, one for each golden-section step."""

    params = {"method": "yeo-johnson", "standardize": True}

    def _power(self, x: Column, lam: float) -> Column:
        if self.method == "box-cox":
            return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam
        up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).otherwise(down)

    def _likelihoods(self, df, trials: list[tuple[str, float]]) -> list[float]:
        aggs = []
        for k, (c, lam) in enumerate(trials):
            x = number(c)
            jac = F.log(x) if self.method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
            v = F.var_pop(self._power(x, lam))
            aggs.append((-F.count(x) / 2 * F.log(v) + (lam - 1) * F.sum(jac)).alias(f"l{k}"))
        row = df.agg(*aggs).first()
        return [-math.inf if v is None or math.isnan(v) else v for v in row]

    def _fit(self, df, features):
        grid = np.linspace(-5, 5, 101)
        lik = np.array(self._likelihoods(df, [(c, float(g)) for c in features for g in grid])).reshape(len(features), -1)
        best = lik.argmax(axis=1)
        lo, hi = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, 100)]
        golden = (math.sqrt(5) - 1) / 2
        for _ in range(40):
            x1, x2 = hi - golden * (hi - lo), lo + golden * (hi - lo)
            got = np.array(self._likelihoods(df, [(c, float(x[i])) for i, c in enumerate(features) for x in (x1, x2)])).reshape(-1, 2)
            left = got[:, 0] > got[:, 1]
            lo, hi = np.where(left, lo, x1), np.where(left, x2, hi)
        self.lambdas_ = ((lo + hi) / 2).tolist()
        moved = df.select(*[self._power(number(c), self.lambdas_[i]).alias(c) for i, c in enumerate(features)])
        s = _collect(moved, features, m=F.avg, s=F.stddev_pop)
        self.mean_, self.scale_ = s["m"], [x or 1.0 for x in s["s"]]

    def forward(self, x, i):
        y = self._power(x, self.lambdas_[i])
        return (y - self.mean_[i]) / self.scale_[i] if self.standardize else y

    def backward(self, y, i):
        y = y * self.scale_[i] + self.mean_[i] if self.standardize else y
        lam = self.lambdas_[i]
        if self.method == "box-cox":
            return F.exp(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1, F.lit(1 / lam))
        up = F.expm1(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
        down = 1 - F.exp(-y) if abs(lam - 2) < 1e-12 else 1 - F.pow(1 - (2 - lam) * y, F.lit(1 / (2 - lam)))
        return F.when(y >= 0, up).otherwise(down)


class QuantileTransformer(_ColumnTransformer):
    """Exact quantiles; ties are met half-way between their two ends."""

    params = {"n_quantiles": 1000, "output_distribution": "uniform"}

    def _fit(self, df, features):
        n = min(self.n_quantiles, df.count())
        self.references_ = np.linspace(0, 1, n).tolist()
        refs = F.array(*[F.lit(r) for r in self.references_])
        self.quantiles_ = _collect(df, features, q=lambda c: F.percentile(c, refs))["q"]

    def transform(self, df):
        from quarry.operators.base import score_column

        refs, normal = np.array(self.references_), self.output_distribution == "normal"
        for i, c in enumerate(self.features_):
            q = np.array(self.quantiles_[i])

            def mapped(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
                v = x[:, 0]
                u = 0.5 * (np.interp(v, q, refs) - np.interp(-v, -q[::-1], -refs[::-1]))
                u = np.where(np.isnan(v), np.nan, u)
                return np.array([norm_ppf(min(max(a, 1e-7), 1 - 1e-7)) if a == a else np.nan for a in u]) if normal else u

            df = score_column(df, [c], mapped, c)
        return df


class PolynomialFeatures(Transformer, BaseEstimator):
    """Adds products of the columns in ascending degree."""

    params = {"degree": 2, "interaction_only": False, "include_bias": True}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        self.terms_ = [t for d in range(0 if self.include_bias else 1, self.degree + 1) for t in pick(range(len(features)), d)]
        return self

    def feature_names_out(self) -> list[str]:
        out = []
        for t in self.terms_:
            parts = [self.features_[i] + (f"^{len(list(g))}" if t.count(i) > 1 else "") for i, g in itertools.groupby(t)]
            out.append(" ".join(parts) or "1")
        return out

    def transform(self, df):
        cols = {}
        for name, t in zip(self.feature_names_out(), self.terms_, strict=True):
            c = F.lit(1.0)
            for i in t:
                c = c * F.col(f"`{self.features_[i]}`").cast("double")
            cols[name] = c
        return df.select("*", *[c.alias(n) for n, c in cols.items() if n not in df.columns])


class SplineTransformer(Transformer, BaseEstimator):
    """B-spline basis; n_knots + degree - 1 values for each column, as one array."""

    params = {"n_knots": 5, "degree": 3, "knots": "uniform", "extrapolation": "constant", "include_bias": True}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        if self.knots == "quantile":
            qs = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, self.n_knots)])
            self.knots_ = [list(q) for q in _collect(df, features, q=lambda c: F.percentile(c, qs))["q"]]
        elif self.knots == "uniform":
            s = _collect(df, features, lo=F.min, hi=F.max)
            self.knots_ = [np.linspace(a, b, self.n_knots).tolist() for a, b in zip(s["lo"], s["hi"], strict=True)]
        else:
            self.knots_ = [list(map(float, k)) for k in np.asarray(self.knots).T]
        return self

    def _basis(self, x: np.ndarray, knots: np.ndarray) -> np.ndarray:
        d, lo, hi = self.degree, knots[0], knots[-1]
        if self.extrapolation == "periodic":
            x = lo + (x - lo) % (hi - lo)
            period = knots[-1] - knots[0]
            t = np.concatenate([knots[-d - 1 : -1] - period, knots, knots[1 : d + 1] + period])
        else:
            if self.extrapolation == "error" and ((x < lo) | (x > hi)).any():
                raise ValueError("values beyond the knots")
            step0, step1 = knots[1] - knots[0], knots[-1] - knots[-2]
            t = np.concatenate([lo - step0 * np.arange(d, 0, -1), knots, hi + step1 * np.arange(1, d + 1)])
        at = np.clip(x, lo, hi) if self.extrapolation in ("constant", "linear") else x

        def values(v: np.ndarray, deg: int) -> np.ndarray:
            cell = np.clip(np.searchsorted(t, v, side="right") - 1, d, len(t) - d - 2)
            b = (np.arange(len(t) - 1)[None] == cell[:, None]).astype(float)
            for k in range(1, deg + 1):
                left = (v[:, None] - t[None, : -k - 1]) / (t[k:-1] - t[: -k - 1])
                right = (t[None, k + 1 :] - v[:, None]) / (t[k + 1 :] - t[1:-k])
                b = left * b[:, :-1] + right * b[:, 1:]
            return b

        out = values(at, d)
        if self.extrapolation == "linear" and d:
            low = values(at, d - 1)
            n = out.shape[1]
            slope = d * (low[:, :n] / (t[d : d + n] - t[:n]) - low[:, 1 : n + 1] / (t[d + 1 : d + 1 + n] - t[1 : n + 1]))
            out = out + slope * (x - at)[:, None]
        if self.extrapolation == "periodic" and d:
            out[:, :d] += out[:, -d:]
            out = out[:, :-d]
        return out if self.include_bias else out[:, :-1]

    def transform_arrays(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._basis(x[:, i], np.array(k)) for i, k in enumerate(self.knots_)], axis=1)


class KBinsDiscretizer(_ColumnTransformer):
    params = {"n_bins": 5, "encode": "ordinal", "strategy": "uniform"}

    def _fit(self, df, features):
        k = self.n_bins
        if self.strategy == "quantile":
            qs = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, k + 1)])
            edges = [np.array(q) for q in _collect(df, features, q=lambda c: F.percentile(c, qs))["q"]]
        else:
            s = _collect(df, features, lo=F.min, hi=F.max)
            edges = [np.linspace(a, b, k + 1) for a, b in zip(s["lo"], s["hi"], strict=True)]
            if self.strategy == "kmeans":
                edges = [self._lloyd(df, c, e) for c, e in zip(features, edges, strict=True)]
        self.edges_ = []
        for e in edges:
            kept = [float(e[0])] + [float(b) for a, b in itertools.pairwise(e) if b - a > 1e-8]
            self.edges_.append(kept if len(kept) > 1 else [-math.inf, math.inf])

    def _lloyd(self, df, c, edges):
        """One-dimensional k-means from the middles of uniform bins: each step is one aggregate over bins."""
        centres = (edges[1:] + edges[:-1]) / 2
        for _ in range(300):
            cuts = (centres[1:] + centres[:-1]) / 2
            bin_ = sum(((number(c) > float(t)).cast("int") for t in cuts), F.lit(0))
            got = {r.b: r.m for r in df.where(number(c).isNotNull()).groupBy(bin_.alias("b")).agg(F.avg(number(c)).alias("m")).collect()}
            new = np.array([got.get(i, v) for i, v in enumerate(centres)])
            if np.abs(new - centres).max() <= 1e-12:
                break
            centres = np.sort(new)
        return np.concatenate([edges[:1], (centres[1:] + centres[:-1]) / 2, edges[-1:]])

    def forward(self, x, i):
        return sum(((x >= e).cast("double") for e in self.edges_[i][1:-1]), F.lit(0.0))

    def transform(self, df):
        out = super().transform(df)
        if self.encode == "ordinal":
            return out
        return out.withColumns({f"{c}_{b}": (F.col(c) == b).cast("double") for i, c in enumerate(self.features_) for b in range(len(self.edges_[i]) - 1)}).drop(*self.features_)

    def backward(self, x, i):
        e = self.edges_[i]
        return F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in itertools.pairwise(e)]), (x + 1).cast("int"))


class VarianceThreshold(Transformer, BaseEstimator):
    params = {"threshold": 0.0}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        self.variances_ = _collect(df, features, v=F.var_pop)["v"]
        self.kept_ = [c for c, v in zip(features, self.variances_, strict=True) if v > self.threshold]
        if not self.kept_:
            raise ValueError("no column varies more than the threshold")
        return self

    def transform(self, df):
        return df.drop(*[c for c in self.features_ if c not in self.kept_])


# --- encoders -----------------------------------------------------------------


def dictionary(df: DataFrame, column: str) -> list:
    """Sorted distinct values; a dictionary's size is that of the categories, and is checked."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError(f"{column} has too many categories for a dictionary")
    return sorted(r[0] for r in rows)


def _code(column: str, values: list, what: str = "unknown value in ") -> Column:
    c, pairs = F.col(column), [x for i, v in enumerate(values) for x in (F.lit(v), F.lit(float(i)))]
    code = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None).cast("double")
    return F.when(code.isNotNull() | c.isNull(), code).otherwise(F.raise_error(F.lit(f"{what}{column}")).cast("double"))


class LabelEncoder(BaseEstimator):
    def fit(self, df, label):
        self.label_, self.classes_ = label, dictionary(df, label)
        return self

    def transform(self, df):
        return df.withColumn(self.label_, _code(self.label_, self.classes_))

    def inverse_transform(self, df):
        return df.withColumn(self.label_, F.element_at(F.array(*[F.lit(v) for v in self.classes_]), (F.col(self.label_) + 1).cast("int")))


class LabelBinarizer(BaseEstimator):
    params = {"neg_label": 0, "pos_label": 1}

    def fit(self, df, label):
        self.label_, self.classes_ = label, dictionary(df, label)
        return self

    def transform(self, df):
        shown = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        return df.withColumns({f"{self.label_}_{v}": F.when(F.col(self.label_) == v, float(self.pos_label)).otherwise(float(self.neg_label)) for v in shown})

    def inverse_transform(self, df):
        shown = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        middle = (self.neg_label + self.pos_label) / 2
        out = F.lit(self.classes_[0])
        if len(self.classes_) == 2:
            out = F.when(F.col(f"`{self.label_}_{shown[0]}`") > middle, F.lit(shown[0])).otherwise(out)
        else:
            best = F.greatest(*[F.col(f"`{self.label_}_{v}`") for v in shown])
            out = F.coalesce(*[F.when(F.col(f"`{self.label_}_{v}`") == best, F.lit(v)) for v in shown])
        return df.withColumn(self.label_, out)


class MultiLabelBinarizer(BaseEstimator):
    """A column of lists to one 0/1 column for each class; unknown labels are passed over."""

    params = {"classes": None}

    def fit(self, df, column):
        self.column_ = column
        self.classes_ = list(self.classes) if self.classes is not None else dictionary(df.select(F.explode(column).alias("v")), "v")
        return self

    def transform(self, df):
        return df.withColumns({f"{self.column_}_{v}": F.array_contains(self.column_, v).cast("double") for v in self.classes_})

    def inverse_transform(self, df):
        return df.withColumn(self.column_, F.array_compact(F.array(*[F.when(F.col(f"`{self.column_}_{v}`") > 0, F.lit(v)) for v in self.classes_])))


class OrdinalEncoder(BaseEstimator):
    def fit(self, df, features, label=None):
        self.features_ = list(features)
        self.categories_ = [dictionary(df, c) for c in features]
        return self

    def transform(self, df):
        return df.withColumns({c: _code(c, v) for c, v in zip(self.features_, self.categories_, strict=True)})

    def inverse_transform(self, df):
        return df.withColumns({c: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(c) + 1).cast("int")) for c, v in zip(self.features_, self.categories_, strict=True)})


class OneHotEncoder(BaseEstimator):
    params = {"drop": "none"}

    def fit(self, df, features, label=None):
        self.features_ = list(features)
        self.categories_ = [dictionary(df, c) for c in features]
        return self

    def _shown(self, values):
        return values[1:] if self.drop == "first" or (self.drop == "ifBinary" and len(values) == 2) else values

    def transform(self, df):
        cols = {}
        for c, v in zip(self.features_, self.categories_, strict=True):
            code = _code(c, v)
            cols |= {f"{c}_{x}": (code == float(v.index(x))).cast("double") for x in self._shown(v)}
        return df.withColumns(cols)

    def inverse_transform(self, df):
        out = {}
        for c, v in zip(self.features_, self.categories_, strict=True):
            out[c] = F.coalesce(*[F.when(F.col(f"`{c}_{x}`") == 1, F.lit(x)) for x in self._shown(v)], F.lit(v[0]) if self._shown(v) != v else F.lit(None))
        return df.withColumns(out)


class TargetEncoder(BaseEstimator):
    """Category means shrunk to the global mean; ``fit_transform`` uses, for each fold, the means of the others."""

    params = {"smooth": "auto", "cv": 5}

    def _means(self, df, column, label, by=()):
        y = F.col(label).cast("double")
        total = df.groupBy(*by).agg(F.avg(y).alias("gm"), F.var_pop(y).alias("gv"))
        cats = df.groupBy(*by, F.col(column).alias("cat")).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
        both = cats.join(F.broadcast(total), list(by)) if by else cats.crossJoin(F.broadcast(total))
        if self.smooth == "auto":
            lam = F.col("gv") * F.col("n") / F.nullif(F.col("gv") * F.col("n") + F.col("v"), F.lit(0.0))
            enc = F.coalesce(lam * F.col("m") + (1 - lam) * F.col("gm"), F.col("gm"))
        else:
            enc = (F.col("n") * F.col("m") + self.smooth * F.col("gm")) / (F.col("n") + self.smooth)
        return both.select(*by, "cat", enc.alias("enc")), total.select(*by, "gm")

    def fit(self, df, features, label):
        self.features_, self.label_ = list(features), label
        self.encodings_, self.mean_ = [], df.agg(F.avg(F.col(label).cast("double"))).first()[0]
        for c in features:
            self.encodings_.append([(r["cat"], r.enc) for r in self._means(df, c, label)[0].collect()])
        return self

    def transform(self, df):
        for c, e in zip(self.features_, self.encodings_, strict=True):
            pairs = [x for k, v in e for x in (F.lit(k), F.lit(v))]
            df = df.withColumn(c, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c)), F.lit(self.mean_)))
        return df

    def fit_transform(self, df, features, label, fold: str):
        """fold: a column with each row's fold."""
        folds = df.select(F.col(fold).alias("out")).distinct()
        for c in features:
            apart = df.select(fold, c, label).join(F.broadcast(folds), F.col(fold) != F.col("out"))
            enc, mean = self._means(apart, c, label, ["out"])
            df = df.join(enc.select(F.col("out").alias(fold), F.col("cat").alias(c), "enc"), [fold, c], "left").join(F.broadcast(mean.withColumnRenamed("out", fold)), fold, "left")
            df = df.withColumn(c, F.coalesce("enc", "gm")).drop("enc", "gm")
        self.fit(df, [], label)
        return df


# --- imputers -----------------------------------------------------------------


class SimpleImputer(_ColumnTransformer):
    """mean, median, mostFrequent (ties to the smallest) or constant; null and NaN are missing."""

    params = {"strategy": "mean", "fill_value": 0.0}

    def _fit(self, df, features):
        if self.strategy == "constant":
            self.fill_ = [self.fill_value] * len(features)
        elif self.strategy == "mostFrequent":
            self.fill_ = []
            for c in features:
                r = df.where(number(c).isNotNull()).groupBy(number(c).alias("v")).count().agg(F.min_by("v", F.struct(-F.col("count"), F.col("v")))).first()
                self.fill_.append(r[0])
        else:
            self.fill_ = _collect(df, features, v=F.avg if self.strategy == "mean" else F.median)["v"]
        if any(v is None for v in self.fill_):
            raise ValueError("a column has no values")

    def forward(self, x, i):
        return F.when(x.isNull() | F.isnan(x), F.lit(float(self.fill_[i]))).otherwise(x)


class MissingIndicator(BaseEstimator):
    params = {"features": "missing-only"}

    def fit(self, df, features, label=None):
        miss = df.agg(*[F.max(number(c).isNull()).alias(f"m{i}") for i, c in enumerate(features)]).first()
        self.features_ = [c for c, m in zip(features, miss, strict=True) if m or self.features == "all"]
        return self

    def transform(self, df):
        return df.withColumns({f"{c}_missing": number(c).isNull().cast("double") for c in self.features_})


class KNNImputer(BaseEstimator):
    """Means of the nearest donors by nan-Euclidean distance (ties by row id); without donors, the column's mean.

    The fitted rows are kept on the executors' side as a DataFrame: rows with
    gaps are compared with all of them.
    """

    params = {"n_neighbors": 5, "weights": "uniform"}

    def fit(self, df, features, row="row_id"):
        self.features_, self.row_ = list(features), row
        self._donors = df.select(F.col(row).alias("d_row"), F.array(*[number(c) for c in features]).alias("d_x"))
        self.mean_ = _collect(df, features, m=F.avg)["m"]
        return self

    def transform(self, df):
        p = len(self.features_)
        x = F.array(*[number(c) for c in self.features_])
        gaps = df.where(F.exists(x, lambda v: v.isNull())).select(F.col(self.row_).alias("row"), x.alias("x"))
        both = F.filter(F.zip_with("x", "d_x", lambda a, b: (a - b) * (a - b)), lambda v: v.isNotNull())
        dist = F.when(F.size(both) > 0, F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, v: s + v) * p / F.size(both)))
        pairs = gaps.join(self._donors, F.col("row") != F.col("d_row")).withColumn("d", dist).where("d is not null")
        each = pairs.select("row", "d", "d_row", F.posexplode(F.zip_with("x", "d_x", lambda a, b: F.when(a.isNull(), b)))).where("col is not null")
        k = self.n_neighbors
        near = each.groupBy("row", "pos").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "d_row", F.col("col").alias("v")))), 1, k).alias("near"))
        w = (lambda e: F.lit(1.0)) if self.weights == "uniform" else (lambda e: 1 / e["d"])
        mean = F.aggregate("near", F.lit(0.0), lambda s, e: s + w(e) * e["v"]) / F.aggregate("near", F.lit(0.0), lambda s, e: s + w(e))
        if self.weights != "uniform":
            zero = F.filter("near", lambda e: e["d"] == 0)
            mean = F.when(F.size(zero) > 0, F.aggregate(zero, F.lit(0.0), lambda s, e: s + e["v"]) / F.size(zero)).otherwise(mean)
        filled = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", mean.alias("m")))).alias("fill"))
        out = df.join(filled.withColumnRenamed("row", self.row_), self.row_, "left")
        return out.withColumns({c: F.coalesce(number(c), F.try_element_at("fill", F.lit(i)), F.lit(self.mean_[i])) for i, c in enumerate(self.features_)}).drop("fill")


class IterativeImputer(BaseEstimator):
    """Round-robin ridge regressions of each incomplete column on the others; the steps are replayed at transform."""

    params = {"max_iter": 10, "tol": 1e-3, "initial_strategy": "mean", "fill_value": 0.0, "alpha": 1e-6, "min_value": -math.inf, "max_value": math.inf}

    def fit(self, df, features, label=None):
        from quarry.operators.linear import RidgeRegression

        self.features_ = list(features)
        self.start_ = SimpleImputer(strategy=self.initial_strategy, fill_value=self.fill_value).fit(df, features).fill_
        row = df.agg(*[F.sum(number(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(features)], *[F.max(F.abs(number(c))).alias(f"a{i}") for i, c in enumerate(features)]).first()
        gaps = [row[f"n{i}"] or 0 for i in range(len(features))]
        scale = max((row[f"a{i}"] or 0) for i in range(len(features)))
        self.steps_ = []
        order = sorted((i for i in range(len(features)) if gaps[i]), key=lambda i: (gaps[i], i))
        work = self._opened(df)
        before = None
        for _ in range(self.max_iter):
            for i in order:
                others = [c for j, c in enumerate(features) if j != i]
                model = RidgeRegression(alpha=self.alpha).fit(work.where(~F.col(f"__gap{i}")), others, features[i])
                step = (i, model.coef_.tolist(), float(model.intercept_))
                self.steps_.append(step)
                work = self._stepped(work, step)
            now = [r for r in work.agg(*[F.sum(F.when(F.col(f"__gap{i}"), F.col(features[i]))) for i in order]).first()] if order else []
            if before is not None and max((abs((a or 0) - (b or 0)) for a, b in zip(now, before, strict=True)), default=0) <= self.tol * scale:
                break
            before = now
        return self

    def _opened(self, df):
        gap = {f"__gap{i}": number(c).isNull() for i, c in enumerate(self.features_)}
        return df.withColumns(gap).withColumns({c: F.coalesce(number(c), F.lit(float(v))) for c, v in zip(self.features_, self.start_, strict=True)})

    def _stepped(self, df, step):
        i, coef, b = step
        others = [c for j, c in enumerate(self.features_) if j != i]
        guess = sum((F.col(c) * w for c, w in zip(others, coef, strict=True)), F.lit(b))
        guess = F.greatest(F.least(guess, F.lit(self.max_value)), F.lit(self.min_value))
        return df.withColumn(self.features_[i], F.when(F.col(f"__gap{i}"), guess).otherwise(F.col(self.features_[i])))

    def transform(self, df):
        work = self._opened(df)
        for s in self.steps_:
            work = self._stepped(work, s)
        return work.drop(*[f"__gap{i}" for i in range(len(self.features_))])
