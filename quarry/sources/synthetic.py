"""Generators of labelled tables.  Simple shapes are expressions over ``range``; others are drawn by numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _frame(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> DataFrame:
    y = y.reshape(len(x), -1)
    names = [f"x{i}" for i in range(x.shape[1])] + (["label"] if y.shape[1] == 1 else [f"label{i}" for i in range(y.shape[1])])
    rows = [(int(i), *map(float, r)) for i, r in enumerate(np.column_stack([x, y]))]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{n} double" for n in names))


def gaussian(seed: int = 0):
    """A Column of standard normal numbers."""
    return F.randn(seed)


def make_blobs(spark, n_samples=100, n_features=2, centers=3, cluster_std=1.0, center_box=(-10.0, 10.0), shuffle=True, random_state=0) -> DataFrame:
    """Isotropic blobs; rows are drawn by the executors from a small table of centres."""
    rng = np.random.default_rng(random_state)
    c = rng.uniform(*center_box, (centers, n_features)) if isinstance(centers, int) else np.asarray(centers, float)
    std = np.broadcast_to(np.asarray(cluster_std, float), (len(c),))
    table = spark.createDataFrame([(i, float(std[i]), list(map(float, r))) for i, r in enumerate(c)], "k int, s double, m array<double>")
    t = spark.range(n_samples).withColumn("k", (F.col("id") % len(c)).cast("int")).join(F.broadcast(table), "k")
    xs = [(F.col("m")[i] + F.col("s") * F.randn(random_state * 1000 + i)).alias(f"x{i}") for i in range(c.shape[1])]
    row = F.row_number().over(W.orderBy(F.xxhash64("id"))) - 1 if shuffle and n_samples <= 100_000 else F.col("id")
    return t.select(row.cast("long").alias("row_id"), *xs, F.col("k").cast("double").alias("label"))


def make_moons(spark, n_samples=100, noise=None, random_state=0) -> DataFrame:
    """Two half circles; the first half of the rows is the outer one."""
    out = n_samples // 2
    i = F.col("id")
    t = F.when(i < out, i / max(out - 1, 1)).otherwise((i - out) / max(n_samples - out - 1, 1)) * math.pi
    x = F.when(i < out, F.cos(t)).otherwise(1 - F.cos(t))
    y = F.when(i < out, F.sin(t)).otherwise(0.5 - F.sin(t))
    return _noisy(spark.range(n_samples), x, y, (i >= out).cast("double"), noise, random_state)


def make_circles(spark, n_samples=100, noise=None, factor=0.8, random_state=0) -> DataFrame:
    """Two circles; the first half of the rows is the outer one."""
    out = n_samples // 2
    i = F.col("id")
    t = F.when(i < out, i / max(out, 1)).otherwise((i - out) / max(n_samples - out, 1)) * (2 * math.pi)
    r = F.when(i < out, 1.0).otherwise(float(factor))
    return _noisy(spark.range(n_samples), r * F.cos(t), r * F.sin(t), (i >= out).cast("double"), noise, random_state)


def _noisy(rows, x, y, label, noise, seed):
    add = (lambda c, k: c + float(noise) * F.randn(seed * 10 + k)) if noise else (lambda c, k: c)
    return rows.select(F.col("id").alias("row_id"), add(x, 0).alias("x0"), add(y, 1).alias("x1"), label.alias("label"))


def make_classification(spark, n_samples=100, n_features=20, n_informative=2, n_redundant=2, n_repeated=0, n_classes=2, n_clusters_per_class=2, weights=None, flip_y=0.01, class_sep=1.0, hypercube=True, shift=0.0, scale=1.0, shuffle=True, random_state=0) -> DataFrame:
    rng = np.random.default_rng(random_state)
    k = n_classes * n_clusters_per_class
    if k > 2**n_informative:
        raise ValueError("too few informative columns for these clusters")
    share = np.array(weights if weights is not None else [1 / n_classes] * n_classes, float)
    share = np.append(share, 1 - share.sum()) if len(share) == n_classes - 1 else share
    counts = np.array([int(n_samples * share[i % n_classes] / n_clusters_per_class) for i in range(k)])
    counts[: n_samples - counts.sum()] += 1
    corners = rng.permutation(2**n_informative)[:k]
    cent = ((corners[:, None] >> np.arange(n_informative)) & 1) * 2.0 - 1
    cent = cent * class_sep * (1 if hypercube else rng.random((k, 1)))
    x, y = [], []
    for i in range(k):
        x.append(rng.standard_normal((counts[i], n_informative)) @ rng.uniform(-1, 1, (n_informative, n_informative)) + cent[i])
        y += [i % n_classes] * counts[i]
    x, y = np.concatenate(x), np.array(y, float)
    if n_redundant:
        x = np.column_stack([x, x @ rng.uniform(-1, 1, (n_informative, n_redundant))])
    if n_repeated:
        x = np.column_stack([x, x[:, rng.integers(0, x.shape[1], n_repeated)]])
    x = np.column_stack([x, rng.standard_normal((len(x), n_features - x.shape[1]))])
    flip = rng.random(len(y)) < flip_y
    y[flip] = rng.integers(0, n_classes, flip.sum())
    x = (x + shift) * scale
    if shuffle:
        o = rng.permutation(len(y))
        x, y = x[o][:, rng.permutation(n_features)], y[o]
    return _frame(spark, x, y)


def make_low_rank_matrix(n: int, p: int, rank: int = 10, tail: float = 0.5, random_state: int = 0) -> np.ndarray:
    """A matrix of bell-shaped singular values with a fat tail."""
    rng = np.random.default_rng(random_state)
    k = min(n, p)
    u, v = (np.linalg.qr(rng.standard_normal((m, k)))[0] for m in (n, p))
    i = np.arange(k) / rank
    return u * ((1 - tail) * np.exp(-(i**2)) + tail * np.exp(-0.1 * i)) @ v.T


def make_regression(spark, n_samples=100, n_features=100, n_informative=10, n_targets=1, bias=0.0, effective_rank=None, tail_strength=0.5, noise=0.0, shuffle=True, random_state=0) -> tuple[DataFrame, np.ndarray]:
    """The table and the coefficients."""
    rng = np.random.default_rng(random_state)
    x = rng.standard_normal((n_samples, n_features)) if effective_rank is None else make_low_rank_matrix(n_samples, n_features, effective_rank, tail_strength, random_state)
    coef = np.zeros((n_features, n_targets))
    coef[: min(n_informative, n_features)] = 100 * rng.random((min(n_informative, n_features), n_targets))
    if shuffle:
        coef = coef[rng.permutation(n_features)]
    y = x @ coef + bias + noise * rng.standard_normal((n_samples, n_targets))
    return _frame(spark, x, y), coef
