"""Estimator contract: parameters, registry, cloning, safe JSON persistence, and how models meet DataFrames.

An estimator is made of keyword parameters.  ``fit(df, features, label, weight)``
reads named DOUBLE columns; ``predict``, ``transform`` and the like add columns and
keep all others.  Two ways of fitting:

* operators whose statistics add up override ``fit`` and use
  :func:`quarry.plans.aggregate.partial_sums` or column aggregates, so only sums leave the executors;
* sequential kernels implement ``fit_arrays`` and get the training rows in one piece;
  ``max_rows`` bounds that and a larger table is refused, not cut.

Scoring is always distributed: the fitted state, whose size does not depend on the
scored table, goes to the executors and works on Arrow batches.
"""

from __future__ import annotations

import copy
import inspect
import json
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.shipping import ship

MODEL_FORMAT, MODEL_FORMAT_VERSION = "quarry.model", 1
MAX_ROWS = 200_000

_estimators: dict[str, type] = {}
_helpers: dict[str, type] = {}


def register_estimator(cls: type, name: str | None = None) -> type:
    """Class decorator; another class under a known name is an error."""
    key = name or cls.__name__
    if _estimators.get(key, cls) is not cls and _estimators[key].__qualname__ != cls.__qualname__:
        raise ValueError(f"another estimator is registered as {key}")
    _estimators[key] = cls
    return cls


def register_serializable_class(cls: type, name: str | None = None) -> type:
    _helpers[name or cls.__name__] = cls
    return cls


def registered_estimators() -> dict[str, type]:
    return dict(_estimators)


def encode_value(v: Any) -> Any:
    """A JSON value with tags for what JSON lacks; callables are refused."""
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        f = float(v)
        return f if np.isfinite(f) else {"$num": repr(f)}
    if isinstance(v, np.ndarray):
        return {"$array": [encode_value(x) for x in v.ravel().tolist()], "shape": list(v.shape), "type": str(v.dtype)}
    if isinstance(v, tuple):
        return {"$tuple": [encode_value(x) for x in v]}
    if isinstance(v, list):
        return [encode_value(x) for x in v]
    if isinstance(v, (set, frozenset)):
        return {"$set": [encode_value(x) for x in sorted(v, key=repr)]}
    if isinstance(v, dict):
        return {"$map": [[encode_value(a), encode_value(b)] for a, b in v.items()]}
    if isinstance(v, BaseEstimator):
        return {"$est": v.to_dict()}
    if type(v).__name__ in _helpers:
        return {"$obj": type(v).__name__, "state": encode_value(vars(v))}
    raise TypeError(f"can't be stored: {type(v).__name__}")


def decode_value(v: Any) -> Any:
    if isinstance(v, list):
        return [decode_value(x) for x in v]
    if not isinstance(v, dict):
        return v
    if "$num" in v:
        return float(v["$num"])
    if "$array" in v:
        return np.array([decode_value(x) for x in v["$array"]], dtype=v["type"]).reshape(v["shape"])
    if "$tuple" in v:
        return tuple(decode_value(x) for x in v["$tuple"])
    if "$set" in v:
        return {decode_value(x) for x in v["$set"]}
    if "$map" in v:
        return {decode_value(a): decode_value(b) for a, b in v["$map"]}
    if "$est" in v:
        return load_model(v["$est"])
    if "$obj" in v:
        cls = _helpers[v["$obj"]]
        out = cls.__new__(cls)
        vars(out).update(decode_value(v["state"]))
        return out
    raise ValueError(f"unknown tag among {sorted(v)[:3]}")


class BaseEstimator:
    """Parameters are the keyword arguments of ``__init__``; fitted state is what ends in an underscore."""

    def __init_subclass__(cls, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        if not cls.__name__.startswith("_") and not cls.__dict__.get("abstract"):
            register_estimator(cls)

    def __init__(self, **params: Any) -> None:
        known = self.defaults()
        for k in params:
            if k not in known:
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
        for k, v in {**known, **params}.items():
            setattr(self, k, v)

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for c in reversed(cls.__mro__):
            out |= getattr(c, "__dict__", {}).get("params", {})
        return copy.deepcopy(out)

    def get_params(self, deep: bool = False) -> dict[str, Any]:
        out = {k: getattr(self, k) for k in self.defaults()}
        if deep:
            for k, v in list(out.items()):
                if isinstance(v, BaseEstimator):
                    out |= {f"{k}__{a}": b for a, b in v.get_params(True).items()}
        return out

    def set_params(self, **params: Any) -> BaseEstimator:
        """New parameter values; fitted state is dropped.  ``name__param`` reaches a nested estimator."""
        nested: dict[str, dict] = {}
        for k, v in params.items():
            head, _, tail = k.partition("__")
            if tail:
                nested.setdefault(head, {})[tail] = v
            elif k not in self.defaults():
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
            else:
                setattr(self, k, v)
        for k, sub in nested.items():
            self._child(k).set_params(**sub)
        for k in [k for k in vars(self) if k.endswith("_")]:
            delattr(self, k)
        return self

    def _child(self, name: str) -> BaseEstimator:
        child = getattr(self, name, None)
        if not isinstance(child, BaseEstimator):
            raise ValueError(f"{type(self).__name__} has no nested estimator {name}")
        return child

    def clone(self) -> BaseEstimator:
        copied = {k: _clone(v) for k, v in self.get_params().items()}
        return type(self)(**copied)

    def to_dict(self) -> dict[str, Any]:
        state = {k: encode_value(v) for k, v in vars(self).items() if k.endswith("_")}
        return {"format": MODEL_FORMAT, "version": MODEL_FORMAT_VERSION, "class": type(self).__name__, "params": {k: encode_value(v) for k, v in self.get_params().items()}, "state": state}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, allow_nan=False)

    @staticmethod
    def from_json(text: str) -> BaseEstimator:
        return load_model(text)

    def check_fitted(self) -> None:
        if not any(k.endswith("_") for k in vars(self)):
            raise ValueError(f"{type(self).__name__} is not fitted")


def _clone(v: Any) -> Any:
    if isinstance(v, BaseEstimator):
        return v.clone()
    if isinstance(v, (list, tuple)):
        return type(v)(_clone(x) for x in v)
    return copy.deepcopy(v) if not callable(v) else v


def load_model(data: str | dict) -> BaseEstimator:
    d = json.loads(data) if isinstance(data, str) else data
    if d.get("format") != MODEL_FORMAT or d.get("version") != MODEL_FORMAT_VERSION:
        raise ValueError("no model of this format and version")
    if d["class"] not in _estimators:
        raise ValueError(f"unknown estimator {d['class']}")
    out = _estimators[d["class"]](**{k: decode_value(v) for k, v in d["params"].items()})
    vars(out).update({k: decode_value(v) for k, v in d["state"].items()})
    return out


def gather(df: DataFrame, columns: list[str], max_rows: int = MAX_ROWS, order: str | None = None) -> np.ndarray:
    """The rows as a matrix on the driver; more than max_rows are refused."""
    part = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *([F.col(order).alias("__order")] if order else []))
    rows = part.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"this algorithm needs its rows in one place and takes at most {max_rows}")
    if order:
        rows = rows.sort_values("__order", kind="stable").drop(columns="__order")
    return rows.to_numpy(np.float64)


def score_column(df: DataFrame, features: list[str], fn: Callable[[np.ndarray], np.ndarray], name: str, kind: str = "double") -> DataFrame:
    """df with fn of the feature matrix as a column, computed on Arrow batches by the executors."""
    ship(df.sparkSession)
    many = kind.startswith("array")

    @F.pandas_udf(kind)
    def scored(*cols: pd.Series) -> pd.Series:
        out = fn(np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in cols]))
        return pd.Series(list(out)) if many else pd.Series(out)

    return df.withColumn(name, scored(*[F.col(c).cast("double") for c in features]))


class ArrayEstimator(BaseEstimator):
    """Fits on the driver from a bounded table (order: the column that gives the rows' order)."""

    abstract = True
    params = {"max_rows": MAX_ROWS}

    def fit_arrays(self, x: np.ndarray, y: np.ndarray | None = None, w: np.ndarray | None = None) -> ArrayEstimator:
        raise NotImplementedError

    def fit(self, df: DataFrame, features: list[str], label: str | list[str] | None = None, weight: str | None = None, order: str | None = None) -> ArrayEstimator:
        labels = [label] if isinstance(label, str) else label or []
        m = gather(df, [*features, *labels, *([weight] if weight else [])], self.max_rows, order)
        p = len(features)
        y = m[:, p : p + len(labels)] if isinstance(label, list) else (m[:, p] if labels else None)
        self.fit_arrays(m[:, :p], y, m[:, -1] if weight else None)
        self.features_ = list(features)
        return self


class Predictor:
    """Prediction columns from ``predict_arrays`` and, where there are any, probabilities and decisions."""

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return score_column(df, self.features_, self.predict_arrays, output)

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        return score_column(df, self.features_, self.proba_arrays, output, "array<double>")

    def decision_function(self, df: DataFrame, output: str = "decision") -> DataFrame:
        return score_column(df, self.features_, lambda x: np.atleast_2d(self.decision_arrays(x).T).T, output, "array<double>")


class Classifier(Predictor):
    kind = "classifier"

    def score_arrays(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(self.predict_arrays(x) == y))

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        return self.classes_[np.argmax(self.proba_arrays(x), axis=1)]

    def score(self, df: DataFrame, label: str) -> float:
        out = self.predict(df)
        return float(out.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])


class Regressor(Predictor):
    kind = "regressor"

    def score_arrays(self, x: np.ndarray, y: np.ndarray) -> float:
        return r2(y, self.predict_arrays(x))

    def score(self, df: DataFrame, label: str) -> float:
        out = self.predict(df)
        p, y = F.col("prediction"), F.col(label)
        s = out.agg(F.sum((y - p) ** 2).alias("e"), (F.var_pop(y) * F.count(y)).alias("t")).first()
        return 1 - s.e / s.t if s.t else float(s.e == 0)


class Clusterer(Predictor):
    kind = "clusterer"

    def fit_predict_arrays(self, x: np.ndarray) -> np.ndarray:
        self.fit_arrays(x)
        return self.labels_

    def fit_predict(self, df: DataFrame, features: list[str], row: str = "row_id", output: str = "cluster") -> DataFrame:
        """(row, cluster) of the fitted rows.  The algorithm needs them in one place: more than max_rows are refused."""
        most = getattr(self, "max_rows", MAX_ROWS)
        rows = df.select(F.col(row).alias("__row"), *[F.col(c).cast("double") for c in features]).limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"this algorithm needs its rows in one place and takes at most {most}")
        rows = rows.sort_values("__row", kind="stable")
        self.features_ = list(features)
        labels = np.asarray(self.fit_predict_arrays(rows[list(features)].to_numpy(np.float64)), float)
        schema = T.StructType([T.StructField(row, df.schema[row].dataType), T.StructField(output, T.DoubleType())])
        return df.sparkSession.createDataFrame(list(zip(rows["__row"].tolist(), labels.tolist(), strict=True)), schema)


class Transformer:
    kind = "transformer"
    accepted_input_kinds = ("dense",)

    def transform(self, df: DataFrame, output: str = "transformed") -> DataFrame:
        return score_column(df, self.features_, self.transform_arrays, output, "array<double>")

    def fit_transform(self, df: DataFrame, *args: Any, **kw: Any) -> DataFrame:
        return self.fit(df, *args, **kw).transform(df)


class OutlierDetector(Predictor):
    kind = "outlier"

    def fit_predict(self, df: DataFrame, features: list[str]) -> DataFrame:
        return self.fit(df, features).predict(df)


def r2(y: np.ndarray, p: np.ndarray) -> float:
    t = float(((y - y.mean()) ** 2).sum())
    e = float(((y - p) ** 2).sum())
    return 1 - e / t if t else float(e == 0)


def is_classifier_like(est: Any) -> bool:
    last = getattr(est, "steps", None)
    return is_classifier_like(last[-1][1]) if last else getattr(est, "kind", "") == "classifier"


# --- capabilities -------------------------------------------------------------


def declares_capability(est: Any, name: str) -> bool:
    return hasattr(est, name)


def has_coefficients(est: Any) -> bool:
    return declares_capability(est, "coef_")


def has_feature_importances(est: Any) -> bool:
    return declares_capability(est, "feature_importances_")


def coefficient_importances(coef: np.ndarray) -> np.ndarray:
    """Absolute values of one row of coefficients, or their sums over several."""
    c = np.abs(np.asarray(coef, np.float64))
    return c if c.ndim == 1 else c.sum(axis=0)


def importances(est: Any, squared: bool = False) -> np.ndarray:
    if has_feature_importances(est):
        return np.asarray(est.feature_importances_)
    if has_coefficients(est):
        c = np.asarray(est.coef_, np.float64)
        return (c**2 if c.ndim == 1 else (c**2).sum(axis=0)) if squared else coefficient_importances(c)
    raise ValueError("the estimator has neither coefficients nor feature importances")


def classes_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted classes and the index of each label."""
    return np.unique(y, return_inverse=True)


def random_generator(seed: int | None = None) -> Callable[[], float]:
    """Park-Miller generator: uniform numbers in [0, 1) (multiplier 16807, modulus 2^31 - 1: fixed values)."""
    state = [int(np.random.default_rng().integers(1, 2**31 - 1))] if seed is None else [seed % 2147483647 or 1]

    def draw() -> float:
        state[0] = state[0] * 16807 % 2147483647
        return (state[0] - 1) / 2147483646

    return draw


def resolve_subset_size(option: Any, total: int) -> int:
    """A number of things of `total`: None or 'all', 'sqrt', 'log2', a fraction below 1, or a count (1 means one)."""
    if option in (None, "all"):
        return total
    if option == "sqrt":
        return max(1, int(np.sqrt(total)))
    if option == "log2":
        return max(1, int(np.log2(total)))
    if isinstance(option, float) and 0 < option < 1:
        return max(1, int(option * total))
    if option == int(option) and 1 <= option:
        return min(int(option), total)
    raise ValueError(f"no subset size: {option!r}")


def struct_type(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def signature_defaults(fn: Callable) -> dict[str, Any]:
    return {k: p.default for k, p in inspect.signature(fn).parameters.items() if p.default is not inspect.Parameter.empty}
