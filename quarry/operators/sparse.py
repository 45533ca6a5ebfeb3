"""Sparse rows in long form, and naive Bayes on them without ever filling in zeros.

A table ``(row, index, value)`` holds the non-zero cells; :class:`SparseRows` adds the
shape.  Rows without any cell are rows all the same: they come from the table of
labels or of row ids that each method is given.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.base import BaseEstimator
from quarry.plans.iterate import checkpointed


class SparseRows:
    """Cells (row long, index int, value double) of a matrix with n_columns columns."""

    def __init__(self, cells: DataFrame, n_columns: int) -> None:
        self.cells = cells.select(F.col("row").cast("long").alias("row"), F.col("index").cast("int").alias("index"), F.col("value").cast("double").alias("value"))
        self.n_columns = n_columns

    @staticmethod
    def from_dense(df: DataFrame, columns: list[str], row: str = "row_id") -> SparseRows:
        """Null and zero cells are left out."""
        cells = df.select(F.col(row).alias("row"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("index", "value"))
        return SparseRows(cells.where("value <> 0"), len(columns))

    def check(self) -> SparseRows:
        """Raises unless cells are unique, not zero, finite and within the columns."""
        bad = self.cells.where(f"value = 0 or value is null or isnan(value) or abs(value) = double('inf') or index < 0 or index >= {self.n_columns} or row is null or index is null")
        if not bad.isEmpty():
            raise ValueError("a cell is zero, not finite or outside the columns")
        if not self.cells.groupBy("row", "index").count().where("count > 1").isEmpty():
            raise ValueError("a cell is there twice")
        return self

    def nnz(self) -> int:
        return self.cells.count()

    def shape(self, rows: DataFrame, row: str = "row_id") -> tuple[int, int]:
        return rows.select(row).distinct().count(), self.n_columns

    def get(self, row: int, index: int) -> float:
        found = self.cells.where((F.col("row") == row) & (F.col("index") == index)).first()
        return found.value if found else 0.0

    def row(self, row: int) -> np.ndarray:
        """One row with its zeros."""
        out = np.zeros(self.n_columns)
        for c in self.cells.where(F.col("row") == row).collect():
            out[c["index"]] = c.value
        return out

    def non_zeros(self, row: int) -> DataFrame:
        return self.cells.where(F.col("row") == row).select("index", "value")

    def select_rows(self, rows: DataFrame, row: str = "row_id") -> SparseRows:
        return SparseRows(self.cells.join(rows.select(F.col(row).alias("row")).distinct(), "row", "left_semi"), self.n_columns)

    def to_dense(self, rows: DataFrame, row: str = "row_id", output: str = "values") -> DataFrame:
        """(row, values): every row of the given ids as an array with its zeros."""
        given = self.cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("index", "value"))).alias("m"))
        every = rows.select(F.col(row).alias("row")).distinct().join(given, "row", "left")
        value = F.transform(F.sequence(F.lit(0), F.lit(self.n_columns - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
        return every.select("row", value.alias(output))


def is_sparse(x) -> bool:
    return isinstance(x, SparseRows)


class _SparseBayes(BaseEstimator):
    """Joint log likelihood = base + sums over the cells of a * value^2 + b * value, with a, b by class and column.

    ``fit`` makes one grouped pass over the cells; the table of a and b has a row for each column that
    holds any cell and stays distributed.  ``predict`` joins the cells with it and sums by row.  Columns
    never seen in training take the classes' default a and b.
    """

    abstract = True
    params = {"alpha": 1.0, "fit_prior": True, "class_prior": None}
    squares = False

    def fit(self, x: SparseRows, labels: DataFrame, label: str = "label", row: str = "row_id"):
        y = labels.select(F.col(row).alias("row"), F.col(label).cast("double").alias("y"))
        counts = sorted(y.groupBy("y").count().collect(), key=lambda r: r.y)
        self.classes_ = np.array([r.y for r in counts])
        self.n_ = np.array([float(r["count"]) for r in counts])
        self.n_columns_, self.log_prior_ = x.n_columns, self._priors()
        cells = self._cells(x).join(y, "row")
        sums = [F.sum(F.when(F.col("y") == float(c), F.col("value")).otherwise(0.0)).alias(f"s{k}") for k, c in enumerate(self.classes_)]
        if self.squares:
            sums += [F.sum(F.when(F.col("y") == float(c), F.col("value") ** 2).otherwise(0.0)).alias(f"q{k}") for k, c in enumerate(self.classes_)]
        self._table = checkpointed(self._weights(checkpointed(cells.groupBy("index").agg(*sums))))
        return self

    def _priors(self):
        if self.class_prior is not None:
            return np.log(np.array(self.class_prior, float))
        return np.log(self.n_ / self.n_.sum()) if self.fit_prior else np.full(len(self.n_), -math.log(len(self.n_)))

    def _cells(self, x: SparseRows) -> DataFrame:
        return x.cells

    def _sums(self, table: DataFrame, prefix: str = "s") -> tuple[int, np.ndarray]:
        """Columns with cells, and the sum of each class over all columns."""
        r = table.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"{prefix}{k}"), F.lit(0.0)).alias(f"t{k}") for k in range(len(self.classes_))]).first()
        return r.n, np.array([r[f"t{k}"] for k in range(len(self.classes_))])

    def _counts_only(self, cells: DataFrame) -> DataFrame:
        return cells.withColumn("value", F.when(F.col("value") >= 0, F.col("value")).otherwise(F.raise_error(F.lit("negative count")).cast("double")))

    def joint(self, x: SparseRows, rows: DataFrame, row: str = "row_id") -> DataFrame:
        """(row, j0, j1, ...): joint log likelihoods of every row of the given ids."""
        ks = range(len(self.classes_))
        v = F.col("value")
        each = [F.sum(v * F.coalesce(f"b{k}", F.lit(float(self.default_b_[k]))) + (v * v * F.coalesce(f"a{k}", F.lit(float(self.default_a_[k]))) if self.squares else 0.0)).alias(f"j{k}") for k in ks]
        sums = self._cells(x).join(self._table, "index", "left").groupBy("row").agg(*each)
        every = rows.select(F.col(row).alias("row")).distinct().join(sums, "row", "left")
        return every.select("row", *[(F.coalesce(f"j{k}", F.lit(0.0)) + float(self.base_[k])).alias(f"j{k}") for k in ks])

    def predict(self, x: SparseRows, rows: DataFrame, row: str = "row_id") -> DataFrame:
        """(row, prediction): the class of the largest joint likelihood, ties to the smaller."""
        ks = range(len(self.classes_))
        top = F.greatest(*[f"j{k}" for k in ks]) if len(ks) > 1 else F.col("j0")
        best = F.coalesce(*[F.when(F.col(f"j{k}") == top, F.lit(float(self.classes_[k]))) for k in ks])
        return self.joint(x, rows, row).select("row", best.alias("prediction"))


class SparseMultinomialNB(_SparseBayes):
    def _cells(self, x):
        return self._counts_only(x.cells)

    def _weights(self, s):
        _, total = self._sums(s)
        total = total + self.alpha * self.n_columns_
        self.base_, self.default_a_, self.default_b_ = self.log_prior_, np.zeros(len(total)), np.log(self.alpha / total)
        return s.select("index", *[F.log((F.col(f"s{k}") + self.alpha) / float(t)).alias(f"b{k}") for k, t in enumerate(total)])


class SparseComplementNB(_SparseBayes):
    params = {"norm": False}

    def _cells(self, x):
        return self._counts_only(x.cells)

    def _weights(self, s):
        _, total = self._sums(s)
        ks = range(len(total))
        rest = total.sum() - total + self.alpha * self.n_columns_
        every = sum((F.col(f"s{k}") for k in ks), F.lit(self.alpha))
        logs = s.select("index", *[F.log((every - F.col(f"s{k}")) / float(rest[k])).alias(f"s{k}") for k in ks])
        unseen = np.log(self.alpha / rest)
        scale = -np.ones(len(total))
        if self.norm:
            n, t = self._sums(logs)
            scale = 1 / (t + (self.n_columns_ - n) * unseen)
        self.base_ = self.log_prior_ if len(total) == 1 else np.zeros(len(total))
        self.default_a_, self.default_b_ = np.zeros(len(total)), unseen * scale
        return logs.select("index", *[(F.col(f"s{k}") * float(scale[k])).alias(f"b{k}") for k in ks])


class SparseBernoulliNB(_SparseBayes):
    """binarize: cells above it count as on; it can't be negative, since zeros would then be on."""

    params = {"binarize": 0.0}

    def _cells(self, x):
        if self.binarize < 0:
            raise ValueError("binarize must not be negative on sparse rows")
        return x.cells.where(F.col("value") > self.binarize).withColumn("value", F.lit(1.0))

    def _weights(self, s):
        ks, down = range(len(self.n_)), self.n_ + 2 * self.alpha
        on = [(F.col(f"s{k}") + self.alpha) / float(down[k]) for k in ks]
        n, off = self._sums(s.select(*[F.log(1 - on[k]).alias(f"s{k}") for k in ks]))
        p = self.alpha / down
        self.base_ = self.log_prior_ + off + (self.n_columns_ - n) * np.log(1 - p)
        self.default_a_, self.default_b_ = np.zeros(len(p)), np.log(p / (1 - p))
        return s.select("index", *[F.log(on[k] / (1 - on[k])).alias(f"b{k}") for k in ks])


class SparseGaussianNB(_SparseBayes):
    """Zeros count in every mean and variance; var_smoothing times the largest variance of a column is added."""

    params = {"var_smoothing": 1e-9}
    squares = True

    def _weights(self, s):
        ks, n = range(len(self.n_)), self.n_
        all_s, all_q = (sum((F.col(f"{c}{k}") for k in ks), F.lit(0.0)) / float(n.sum()) for c in "sq")
        widest = s.agg(F.max(all_q - all_s * all_s).alias("v")).first().v or 0.0
        eps = self.var_smoothing * widest or 1e-300
        mean = [F.col(f"s{k}") / float(n[k]) for k in ks]
        var = [F.greatest(F.col(f"q{k}") / float(n[k]) - mean[k] * mean[k], F.lit(0.0)) + eps for k in ks]
        count, fixed = self._sums(s.select(*[(F.log(2 * math.pi * var[k]) + mean[k] * mean[k] / var[k]).alias(f"s{k}") for k in ks]))
        self.base_ = self.log_prior_ - 0.5 * (fixed + (self.n_columns_ - count) * math.log(2 * math.pi * eps))
        self.default_a_, self.default_b_ = np.full(len(n), -0.5 / eps), np.zeros(len(n))
        return s.select("index", *[x for k in ks for x in ((-0.5 / var[k]).alias(f"a{k}"), (mean[k] / var[k]).alias(f"b{k}"))])
