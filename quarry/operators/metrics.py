"""Evaluation metrics as aggregates over DataFrames.

Every metric takes a DataFrame and column names and returns a DataFrame of one row
with ``value``, or a small table.  Only grouped counts and sums are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.distances import product_squares
from quarry.plans.aggregate import contingency
from quarry.plans.shipping import ship

EPSILON = 2.220446049250313e-16


def _ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(F.lit(otherwise))


# --- classification -----------------------------------------------------------


def accuracy_score(df: DataFrame, prediction: str, label: str, normalize: bool = True) -> DataFrame:
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return df.agg((F.avg(hit) if normalize else F.sum(hit)).alias("value"))


def precision_recall_fscore_support(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row for each label of either column: precision, recall, f1 (0 where undefined) and support."""
    each = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(label) == F.col(prediction)).cast("int").alias("h")), F.struct(F.col(prediction).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("e"))
    g = each.groupBy(F.col("e.c").alias("label")).agg(F.sum("e.t").alias("support"), F.sum("e.p").alias("predicted"), F.sum("e.h").alias("hits"))
    p, r = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return g.select("label", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), F.col("support").cast("long").alias("support"))


def _averaged(df: DataFrame, prediction: str, label: str, what: str, average: str, positive: object) -> DataFrame:
    t = precision_recall_fscore_support(df, prediction, label)
    if average == "macro":
        return t.agg(F.avg(what).alias("value"))
    return t.agg(F.coalesce(F.max(F.when(F.col("label") == positive, F.col(what))), F.lit(0.0)).alias("value"))


def precision_score(df: DataFrame, prediction: str, label: str, average: str = "binary", positive: object = 1) -> DataFrame:
    return _averaged(df, prediction, label, "precision", average, positive)


def recall_score(df: DataFrame, prediction: str, label: str, average: str = "binary", positive: object = 1) -> DataFrame:
    return _averaged(df, prediction, label, "recall", average, positive)


def f1_score(df: DataFrame, prediction: str, label: str, average: str = "binary", positive: object = 1) -> DataFrame:
    return _averaged(df, prediction, label, "f1", average, positive)


def confusion_matrix(df: DataFrame, prediction: str, label: str, labels: list | None = None) -> DataFrame:
    """(label, prediction, n) of the pairs; with labels, of all pairs of these, zeros too."""
    t = contingency(df, label, prediction).select(F.col("a").alias("label"), F.col("b").alias("prediction"), F.col("n").cast("long").alias("n"))
    if labels is None:
        return t
    s = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "label double, prediction double")
    return s.join(t, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Rows for each label, then macro avg, weighted avg and accuracy."""
    t = precision_recall_fscore_support(df, prediction, label).withColumn("label", F.col("label").cast("string"))
    names = ["precision", "recall", "f1"]
    macro = t.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = t.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    a = accuracy_score(df, prediction, label)
    acc = a.select(F.lit("accuracy").alias("label"), *[F.col("value").alias(c) for c in names]).crossJoin(F.broadcast(macro.select("support")))
    return t.select("label", *names, "support").unionByName(macro).unionByName(weighted).unionByName(acc)


def balanced_accuracy_score(df: DataFrame, prediction: str, label: str, adjusted: bool = False) -> DataFrame:
    t = df.groupBy(label).agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("r"))
    v, k = F.avg("r"), F.count("*")
    return t.agg((((v - 1 / k) / (1 - 1 / k)) if adjusted else v).alias("value"))


def matthews_corrcoef(df: DataFrame, prediction: str, label: str) -> DataFrame:
    t = precision_recall_fscore_counts(df, prediction, label)
    s, c = F.sum("t"), F.sum("h")
    pt, pp, tt = F.sum(F.col("p") * F.col("t")), F.sum(F.col("p") ** 2), F.sum(F.col("t") ** 2)
    return t.agg(_ratio(c * s - pt, F.sqrt((s * s - pp) * (s * s - tt))).alias("value"))


def precision_recall_fscore_counts(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Truths t, predictions p and hits h of each label, as doubles."""
    a = df.groupBy(F.col(label).alias("c")).agg(F.count("*").cast("double").alias("t"), F.sum((F.col(label) == F.col(prediction)).cast("double")).alias("h"))
    b = df.groupBy(F.col(prediction).alias("c")).agg(F.count("*").cast("double").alias("p"))
    return a.join(b, "c", "full").na.fill(0.0, ["t", "p", "h"])


def cohen_kappa_score(df: DataFrame, a: str, b: str, weights: str | None = None) -> DataFrame:
    """Agreement beyond chance; weights 'linear' or 'quadratic' act on the distance of label indices."""
    n = contingency(df, a, b)
    labels = n.select(F.col("a").alias("c")).union(n.select("b")).distinct()
    at = labels.withColumn("i", F.dense_rank().over(W.orderBy("c")) - 1)  # one row for each label
    rows = n.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = n.groupBy("b").agg(F.sum("n").alias("rb"))
    cell = at.select(F.col("c").alias("a"), F.col("i").alias("i")).crossJoin(F.broadcast(at.select(F.col("c").alias("b"), F.col("i").alias("j"))))
    t = cell.join(n, ["a", "b"], "left").join(rows, "a", "left").join(cols, "b", "left").na.fill(0.0, ["n", "ra", "rb"])
    d = F.abs(F.col("i") - F.col("j")).cast("double")
    w = d if weights == "linear" else d * d if weights == "quadratic" else (d > 0).cast("double")
    total = F.sum("n")
    return t.agg(F.when(F.sum(w * F.col("ra") * F.col("rb")) == 0, F.lit(1.0)).otherwise(1 - F.sum(w * F.col("n")) * total / F.nullif(F.sum(w * F.col("ra") * F.col("rb")), F.lit(0.0))).alias("value"))


def hinge_loss(df: DataFrame, label: str, decision: str) -> DataFrame:
    """Binary; the larger label stands for +1."""
    top = df.agg(F.max(label).alias("top"))
    y = F.when(F.col(label) == F.col("top"), 1.0).otherwise(-1.0)
    return df.crossJoin(F.broadcast(top)).agg(F.avg(F.greatest(F.lit(0.0), 1 - y * F.col(decision))).alias("value"))


def brier_score_loss(df: DataFrame, label: str, probability: str, positive: object = 1) -> DataFrame:
    p = F.when(F.col(probability).between(0, 1), F.col(probability)).otherwise(F.raise_error(F.lit("probabilities lie in [0, 1]")).cast("double"))
    return df.agg(F.avg((p - (F.col(label) == positive).cast("double")) ** 2).alias("value"))


def log_loss(df: DataFrame, label: str, probabilities: list[str], classes: list, normalize: bool = True, eps: float = EPSILON) -> DataFrame:
    """probabilities: one column for each of classes."""
    p = F.coalesce(*[F.when(F.col(label) == c, F.col(q)) for c, q in zip(classes, probabilities, strict=True)])
    loss = -F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    return df.agg((F.avg(loss) if normalize else F.sum(loss)).alias("value"))


def _by_score(df: DataFrame, label: str, score: str, positive: object) -> DataFrame:
    """One row for each distinct score: positives and negatives at it, and at or above it."""
    hit = (F.col(label) == positive).cast("long")
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    down = W.orderBy(F.desc("score"))  # over distinct scores
    return g.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))


def roc_curve(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """(threshold, fpr, tpr), from (Infinity, 0, 0) on, a row for each distinct score."""
    t = _by_score(df, label, score, positive)
    total = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rows = t.crossJoin(F.broadcast(total)).select(F.col("score").cast("double").alias("threshold"), _ratio(F.col("fp"), F.col("N")).alias("fpr"), _ratio(F.col("tp"), F.col("P")).alias("tpr"))
    return df.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)], rows.schema).unionByName(rows)


def precision_recall_curve(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """(threshold, precision, recall) for each distinct score, without an added end point."""
    t = _by_score(df, label, score, positive)
    total = t.agg(F.sum("pos").alias("P"))
    return t.crossJoin(F.broadcast(total)).select(F.col("score").cast("double").alias("threshold"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("P")).alias("recall"))


def roc_auc_score(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    """Trapezoid area: the chance that a positive outranks a negative, ties counting half."""
    t = _by_score(df, label, score, positive)
    below = F.col("fp") - F.col("neg") / 2
    return t.agg((1 - F.sum(F.col("pos") * below) / (F.sum("pos") * F.sum("neg"))).alias("value"))


def roc_auc_multiclass(df: DataFrame, label: str, scores: list[str], classes: list, multi_class: str = "ovr", average: str = "macro") -> DataFrame:
    """One-versus-rest mean (macro, or weighted by class share), or Hand and Till's one-versus-one mean."""
    spark, parts = df.sparkSession, []
    if multi_class == "ovr":
        for c, s in zip(classes, scores, strict=True):
            share = df.agg(F.avg((F.col(label) == c).cast("double")).alias("w"))
            parts.append(roc_auc_score(df, label, s, c).crossJoin(share if average == "weighted" else spark.createDataFrame([(1.0,)], "w double")))
    else:
        for i, (a, sa) in enumerate(zip(classes, scores, strict=True)):
            for b, sb in list(zip(classes, scores, strict=True))[i + 1 :]:
                two = df.where(F.col(label).isin(a, b))
                share = df.agg(F.avg(F.col(label).isin(a, b).cast("double")).alias("w"))
                for c, s in ((a, sa), (b, sb)):
                    parts.append(roc_auc_score(two, label, s, c).crossJoin(share if average == "weighted" else spark.createDataFrame([(1.0,)], "w double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


# --- regression -----------------------------------------------------------------


def _error(prediction: str, label: str) -> Column:
    return F.col(prediction).cast("double") - F.col(label).cast("double")


def mean_squared_error(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(F.avg(_error(prediction, label) ** 2).alias("value"))


def root_mean_squared_error(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(_error(prediction, label) ** 2)).alias("value"))


def mean_absolute_error(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.abs(_error(prediction, label))).alias("value"))


def mean_absolute_percentage_error(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.abs(_error(prediction, label)) / F.greatest(F.abs(F.col(label).cast("double")), F.lit(EPSILON))).alias("value"))


def median_absolute_error(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(F.median(F.abs(_error(prediction, label))).alias("value"))


def mean_squared_log_error(df: DataFrame, prediction: str, label: str) -> DataFrame:
    ok = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("double")).otherwise(F.raise_error(F.lit("negative value")).cast("double"))
    return df.agg(F.avg((F.log1p(ok(prediction)) - F.log1p(ok(label))) ** 2).alias("value"))


def explained_variance_score(df: DataFrame, prediction: str, label: str) -> DataFrame:
    e, t = F.var_pop(_error(prediction, label)), F.var_pop(F.col(label).cast("double"))
    return df.agg(F.when(t > 0, 1 - e / F.nullif(t, F.lit(0.0))).otherwise((e == 0).cast("double")).alias("value"))


def max_error(df: DataFrame, prediction: str, label: str) -> DataFrame:
    return df.agg(F.max(F.abs(_error(prediction, label))).alias("value"))


def r2_score(df: DataFrame, prediction: str, label: str) -> DataFrame:
    e, t = F.sum(_error(prediction, label) ** 2), F.var_pop(F.col(label).cast("double")) * F.count(label)
    return df.agg(F.when(t > 0, 1 - e / F.nullif(t, F.lit(0.0))).otherwise((e == 0).cast("double")).alias("value"))


# --- clustering -------------------------------------------------------------------


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sums over the contingency table: n, squares of cells, of rows and of columns."""
    n = contingency(df, a, b)
    t = n.agg(F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("cells"))
    r = n.groupBy("a").agg(F.sum("n").alias("s")).agg(F.sum(F.col("s") ** 2).alias("rows"))
    c = n.groupBy("b").agg(F.sum("n").alias("s")).agg(F.sum(F.col("s") ** 2).alias("cols"))
    return t.crossJoin(r).crossJoin(c)


def adjusted_rand_score(df: DataFrame, a: str, b: str) -> DataFrame:
    c = lambda s: (F.col(s) - F.col("n")) / 2
    total = F.col("n") * (F.col("n") - 1) / 2
    chance, mean = c("rows") * c("cols") / total, (c("rows") + c("cols")) / 2
    return _pairs(df, a, b).select(_ratio(c("cells") - chance, mean - chance, 1.0).alias("value"))


def rand_score(df: DataFrame, a: str, b: str) -> DataFrame:
    c = lambda s: (F.col(s) - F.col("n")) / 2
    total = F.col("n") * (F.col("n") - 1) / 2
    return _pairs(df, a, b).select(_ratio(total + 2 * c("cells") - c("rows") - c("cols"), total, 1.0).alias("value"))


def fowlkes_mallows_score(df: DataFrame, a: str, b: str) -> DataFrame:
    d = lambda s: F.col(s) - F.col("n")
    return _pairs(df, a, b).select(_ratio(d("cells"), F.sqrt(d("rows") * d("cols"))).alias("value"))


def _information(df: DataFrame, a: str, b: str) -> DataFrame:
    """mi, ha, hb: mutual information and entropies, natural logarithm."""
    n = contingency(df, a, b)
    total = n.agg(F.sum("n").alias("t"))
    rows = n.groupBy("a").agg(F.sum("n").alias("r"))
    cols = n.groupBy("b").agg(F.sum("n").alias("c"))
    share = lambda x: F.col(x) / F.col("t")
    cells = n.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    mi = cells.agg(F.greatest(F.lit(0.0), F.sum(share("n") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c"))))).alias("mi"))
    ha = rows.crossJoin(F.broadcast(total)).agg((-F.sum(share("r") * F.log(share("r")))).alias("ha"))
    hb = cols.crossJoin(F.broadcast(total)).agg((-F.sum(share("c") * F.log(share("c")))).alias("hb"))
    return mi.crossJoin(ha).crossJoin(hb)


def mutual_info_score(df: DataFrame, a: str, b: str) -> DataFrame:
    return _information(df, a, b).select(F.col("mi").alias("value"))


def normalized_mutual_info_score(df: DataFrame, a: str, b: str, average: str = "arithmetic") -> DataFrame:
    x, y = F.col("ha"), F.col("hb")
    mean = {"arithmetic": (x + y) / 2, "min": F.least(x, y), "max": F.greatest(x, y), "geometric": F.sqrt(x * y)}[average]
    return _information(df, a, b).select(F.when((x == 0) & (y == 0), 1.0).otherwise(_ratio(F.col("mi"), mean)).alias("value"))


def homogeneity_score(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return _information(df, true, predicted).select(_ratio(F.col("mi"), F.col("ha"), 1.0).alias("value"))


def completeness_score(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return _information(df, true, predicted).select(_ratio(F.col("mi"), F.col("hb"), 1.0).alias("value"))


def v_measure_score(df: DataFrame, true: str, predicted: str) -> DataFrame:
    h, c = _ratio(F.col("mi"), F.col("ha"), 1.0), _ratio(F.col("mi"), F.col("hb"), 1.0)
    return _information(df, true, predicted).select(_ratio(2 * h * c, h + c).alias("value"))


def _expected_information(n: int, x: int, y: int, block: int = 1 << 20) -> float:
    """Expected share of one cell whose marginals are x and y: k runs over the hypergeometric weights, in blocks."""
    lg, lo, hi = math.lgamma, max(1, x + y - n), min(x, y)
    total, k = 0.0, lo
    while k <= hi:
        ks = np.arange(k, min(k + block, hi + 1), dtype=np.float64)
        # each weight from the one before; the first of a block afresh
        first = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
        step = np.log((x - ks[:-1]) * (y - ks[:-1])) - np.log((ks[:-1] + 1) * (n - x - y + ks[:-1] + 1))
        weight = np.exp(first + np.concatenate([[0.0], np.cumsum(step)]))
        total += float((ks / n * (np.log(n) + np.log(ks) - np.log(x) - np.log(y)) * weight).sum())
        k += block
    return total


def adjusted_mutual_info_score(df: DataFrame, a: str, b: str) -> DataFrame:
    """The expected information is summed on the executors, over pairs of distinct marginals with their numbers.

    Distinct marginals are at most the root of twice the rows on either side, whatever the number of clusters.
    """
    ship(df.sparkSession)
    n = contingency(df, a, b)
    sides = [n.groupBy(c).agg(F.sum("n").cast("long").alias("s")).groupBy("s").count().select(F.col("s").alias(o), F.col("count").alias(f"{o}s")) for c, o in (("a", "x"), ("b", "y"))]
    total = n.agg(F.sum("n").cast("long").alias("t"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = sides[0].crossJoin(sides[1]).crossJoin(total).repartition(parts, "x", "y")

    @F.pandas_udf("double")
    def share(t: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_expected_information(*v) for v in zip(t.tolist(), x.tolist(), y.tolist(), strict=True)], dtype=float)

    e = cells.agg(F.sum(F.col("xs") * F.col("ys") * share("t", "x", "y")).alias("e"))
    down = (F.col("ha") + F.col("hb")) / 2 - F.col("e")
    value = F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).otherwise((F.col("mi") - F.col("e")) / F.when(F.abs(down) > EPSILON, down).otherwise(EPSILON))
    return _information(df, a, b).crossJoin(e).select(value.alias("value"))


def silhouette_samples(df: DataFrame, columns: list[str], label: str, row: str = "row_id") -> DataFrame:
    """(row, value); a row alone in its cluster gets 0.  Quadratic in the rows, as the measure is.

    Chunks of rows meet blocks of rows; a task sums the distances of each row by the clusters of a block.
    """
    ship(df.sparkSession)
    n = df.count()
    rows, cols = -(-n // 8192) or 1, -(-n // 4096) or 1
    kind = dict(df.dtypes)[label]
    key = (F.col(label) + F.lit(0.0) if kind in ("float", "double") else F.col(label)).cast("string")
    t = df.where(F.col(row).isNotNull()).select(F.col(row).alias("row"), key.alias("k"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    holes = F.exists("x", lambda v: v.isNull())
    empty, t = t.where(holes).select("row", F.lit(0.0).alias("value")), t.where(~holes)
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left, right = t.select("*", deal(cols).alias("c"), each(rows).alias("b")), t.select("*", deal(rows).alias("b"), each(cols).alias("c"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(a) and len(b):
            at, names = pd.factorize(b["k"], use_na_sentinel=False)
            order = np.argsort(at, kind="stable")
            b, at = b.iloc[order], at[order]
            y, starts = np.stack(b["x"].to_list()), np.searchsorted(at, np.arange(len(names)))
            size = np.bincount(at).astype(float)
            for s in range(0, len(a), 256):
                part = a.iloc[s : s + 256]
                d = np.sqrt(product_squares(np.stack(part["x"].to_list()), y))
                same = pd.DataFrame({"row": part["row"].to_numpy(), "i": np.arange(len(part))}).merge(pd.DataFrame({"row": b["row"].to_numpy(), "j": np.arange(len(b))}), on="row")
                d[same["i"], same["j"]] = 0
                count = np.tile(size, (len(part), 1))
                np.subtract.at(count, (same["i"].to_numpy(), at[same["j"].to_numpy()]), 1)
                total = np.add.reduceat(d, starts, axis=1)
                i, j = np.nonzero(count)
                parts.append(pd.DataFrame({"row": part["row"].to_numpy()[i], "k": part["k"].to_numpy()[i], "k2": np.asarray(names, object)[j], "s": total[i, j], "n": count[i, j]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("row", "k", "k2", "s", "n")})

    types = T.StructType([T.StructField("row", df.schema[row].dataType), T.StructField("k", T.StringType()), T.StructField("k2", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.DoubleType())])
    sums = left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInPandas(cell, types)
    mean = sums.groupBy("row", "k", "k2").agg((F.sum("s") / F.sum("n")).alias("d"))
    g = mean.groupBy("row", "k").agg(F.max(F.when(F.col("k") == F.col("k2"), F.col("d"))).alias("a"), F.min(F.when(F.col("k") != F.col("k2"), F.col("d"))).alias("b"))
    return g.select("row", F.when(F.col("a").isNull(), 0.0).otherwise(_ratio(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("value")).unionAll(empty)


def silhouette_score(df: DataFrame, columns: list[str], label: str, row: str = "row_id") -> DataFrame:
    return silhouette_samples(df, columns, label, row).agg(F.avg("value").alias("value"))


def davies_bouldin_score(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    centres = df.groupBy(F.col(label).alias("k")).agg(F.array(*[F.avg(c) for c in columns]).alias("m"))
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    x = F.array(*[F.col(c).cast("double") for c in columns])
    spread = df.select(F.col(label).alias("k"), x.alias("x")).join(F.broadcast(centres), "k").groupBy("k", "m").agg(F.avg(dist(F.col("x"), F.col("m"))).alias("s"))
    other = spread.select(F.col("k").alias("k2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    pair = spread.join(F.broadcast(other), F.col("k") != F.col("k2"))
    return pair.groupBy("k").agg(F.max(_ratio(F.col("s") + F.col("s2"), dist(F.col("m"), F.col("m2")))).alias("r")).agg(F.avg("r").alias("value"))


def calinski_harabasz_score(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Of sums by cluster: dispersion between the centres over that within clusters."""
    x = [F.col(c).cast("double") for c in columns]
    g = df.groupBy(label).agg(F.count("*").cast("double").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], F.aggregate(F.array(*[F.var_pop(c) for c in x]), F.lit(0.0), lambda s, v: s + v).alias("v"))
    n, k = F.sum("n"), F.count("*")
    within = F.sum(F.col("n") * F.col("v"))
    between = sum((F.sum(F.col("n") * F.col(f"m{i}") ** 2) - F.sum(F.col("n") * F.col(f"m{i}")) ** 2 / n for i in range(len(x))), F.lit(0.0))
    return g.agg(F.when(within == 0, 1.0).otherwise(between * (n - k) / F.nullif(within * (k - 1), F.lit(0.0))).alias("value"))
