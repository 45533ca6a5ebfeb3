"""Sums over all rows that only numpy can express, and the moments made of them.

``partial_sums`` runs a kernel on each Arrow batch, adds its results up within a
partition, and adds the partitions up by position on the executors.  What
reaches the driver has the size of one result, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shipping import ship


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


def partial_sums(df: DataFrame, columns: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of kernel(rows) over all batches of rows; zero rows give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = np.asarray(kernel(matrix(b)), np.float64).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    ship(df.sparkSession)
    parts = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, "i int, v double")
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.i] = r.v
    return out


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight (or number) of rows, means, and the sum of products of deviations from the means."""
    p = len(columns)
    # deviations from a first mean keep the digits that sums of squares would lose
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    centre = np.array([m or 0.0 for m in means])

    def kernel(m: np.ndarray) -> np.ndarray:
        x = m[:, :p] - centre
        w = m[:, p:] if weight else np.ones((len(m), 1))
        return np.concatenate([[w.sum()], (x * w).sum(axis=0), ((x * w).T @ x).ravel()])

    s = partial_sums(df, [*columns, *([weight] if weight else [])], kernel)
    if not len(s):
        raise ValueError("no rows")
    n, total, products = s[0], s[1 : p + 1], s[p + 1 :].reshape(p, p)
    return float(n), centre + total / n, products - np.outer(total, total) / n


def class_moments(df: DataFrame, columns: list[str], label: str, weight: str | None = None) -> DataFrame:
    """For each label: n, mean_i and var_i (population) of each column."""
    if weight:
        w = F.col(weight)
        mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
        each = [x for i, c in enumerate(columns) for x in (mean(c).alias(f"mean_{i}"), (F.sum(F.col(c) ** 2 * w) / F.sum(w) - mean(c) ** 2).alias(f"var_{i}"))]
        return df.groupBy(F.col(label).alias("label")).agg(F.sum(w).alias("n"), *each)
    each = [x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"mean_{i}"), F.var_pop(c).alias(f"var_{i}"))]
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *each)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts n of the pairs (a, b)."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
