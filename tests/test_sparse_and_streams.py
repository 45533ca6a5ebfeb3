"""Sparse rows against dense arithmetic, group folds against the greedy rule, models and sums of streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import streaming
from quarry.operators import cluster, decomposition, meta, metrics, neighbors, sparse, svm
from quarry.operators.base import declares_capability, has_coefficients, has_feature_importances, registered_estimators
from quarry.operators.linear import LinearRegression
from quarry.operators.model_selection import GroupKFold, StratifiedGroupKFold
from quarry.operators.trees import DecisionTreeClassifier

RNG = np.random.default_rng(5)
DENSE = RNG.poisson(0.6, (60, 7)).astype(float)
DENSE[3] = 0
DENSE[:, 6] = 0
CLASS = np.arange(60) % 3.0


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(y), *map(float, x)) for i, (y, x) in enumerate(zip(CLASS, DENSE, strict=True))]
    return spark.createDataFrame(rows, "row_id long, y double, " + ", ".join(f"c{j} double" for j in range(7)))


@pytest.fixture(scope="module")
def cells(table):
    return sparse.SparseRows.from_dense(table, [f"c{j}" for j in range(7)]).check()


def test_sparse_rows_hold_the_matrix(table, cells):
    assert sparse.is_sparse(cells) and cells.shape(table) == DENSE.shape and cells.nnz() == (DENSE != 0).sum()
    assert (cells.row(5) == DENSE[5]).all() and not cells.row(3).any() and cells.get(5, 2) == DENSE[5, 2]
    got = {r.row: r["values"] for r in cells.to_dense(table).collect()}
    assert all(got[i] == DENSE[i].tolist() for i in range(60))
    assert cells.select_rows(table.where("row_id < 10")).nnz() == (DENSE[:10] != 0).sum()


@pytest.mark.parametrize("bad", [[(0, 1, 0.0)], [(0, 9, 1.0)], [(0, 1, 1.0), (0, 1, 2.0)], [(0, -1, 1.0)], [(0, 1, float("nan"))]])
def test_sparse_rows_refuse_cells(spark, bad):
    with pytest.raises(ValueError):
        sparse.SparseRows(spark.createDataFrame(bad, "row long, index int, value double"), 3).check()


def _plain(name):
    """Joint log likelihoods on the dense matrix, for each row and class."""
    out = np.zeros((60, 3))
    rest = np.array([DENSE.sum(axis=0) + 1 - DENSE[CLASS == c].sum(axis=0) for c in range(3)])
    widest = 1e-3 * DENSE.var(axis=0).max()
    for c in range(3):
        mine = DENSE[CLASS == c]
        if name == "SparseMultinomialNB":
            p = (mine.sum(axis=0) + 1) / (mine.sum() + 7)
            out[:, c] = math.log(1 / 3) + DENSE @ np.log(p)
        elif name == "SparseComplementNB":
            out[:, c] = -DENSE @ np.log(rest[c] / rest[c].sum())
        elif name == "SparseBernoulliNB":
            p = ((mine > 0).sum(axis=0) + 1) / (len(mine) + 2)
            out[:, c] = math.log(1 / 3) + (np.where(DENSE > 0, np.log(p), np.log(1 - p))).sum(axis=1)
        else:
            m, v = mine.mean(axis=0), mine.var(axis=0) + widest
            out[:, c] = math.log(1 / 3) - 0.5 * (np.log(2 * np.pi * v) + (DENSE - m) ** 2 / v).sum(axis=1)
    return out


@pytest.mark.parametrize("name", ["SparseMultinomialNB", "SparseComplementNB", "SparseBernoulliNB", "SparseGaussianNB"])
def test_sparse_bayes_is_the_dense_one(table, cells, name):
    model = getattr(sparse, name)(**({"var_smoothing": 1e-3} if name == "SparseGaussianNB" else {})).fit(cells, table, "y")
    got = sorted(model.joint(cells, table).collect(), key=lambda r: r.row)
    want = _plain(name)
    assert np.allclose([[r.j0, r.j1, r.j2] for r in got], want, atol=1e-8)
    labels = {r.row: r.prediction for r in model.predict(cells, table).collect()}
    clear = np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 1e-6
    assert all(labels[i] == want[i].argmax() for i in np.flatnonzero(clear)) and len(labels) == 60


@pytest.mark.parametrize("seed", range(4))
def test_group_folds_follow_the_greedy_rule(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [int(s) for s in rng.integers(1, 6, 25)] + ([40] if seed % 2 else []) + [1] * 30
    rows = [(i, g) for i, g in enumerate(np.repeat(np.arange(len(sizes)), sizes).tolist())]
    df = spark.createDataFrame(rows, "row_id long, g long")
    got = {r.g: r.fold for r in GroupKFold(n_splits=4).assign(df, groups="g").collect()}
    load, want = [0] * 4, {}
    for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], -g)):
        f = min(range(4), key=lambda i: (load[i], i))
        load[f] += sizes[g]
        want[g] = f
    assert got == want


def test_bounded_operators_refuse_rather_than_cut(spark, table):
    with pytest.raises(ValueError):
        StratifiedGroupKFold(n_splits=2, max_cells=3).assign(table, label="y", groups="row_id")
    with pytest.raises(ValueError):
        cluster.AgglomerativeClustering(n_clusters=2, max_rows=10).fit_predict(table, ["c0", "c1"])
    with pytest.raises(ValueError):
        neighbors.KDTree.of(table, ["c0"], max_rows=10)
    with pytest.raises(ValueError):
        meta.CalibratedClassifierCV(estimator=DecisionTreeClassifier(max_depth=1), cv=2, max_rows=5).fit(table.withColumn("b", (F.col("y") > 1).cast("double")), ["c0"], "b")


@pytest.mark.parametrize("tree", [neighbors.KDTree, neighbors.BallTree])
def test_trees_find_the_nearest_by_id(table, tree):
    got = sorted((r.query, r.d, r.neighbour) for r in tree.of(table, ["c0", "c1", "c2"], leaf_size=4).kneighbors(table, ["c0", "c1", "c2"], 3).collect())
    x = DENSE[:, :3]
    want = sorted((i, d, j) for i in range(60) for d, j in sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in range(60))[:3])
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_expected_information_in_blocks():
    lg = math.lgamma

    def plain(n, x, y):
        fixed = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1)
        return sum(k / n * math.log(n * k / (x * y)) * math.exp(fixed - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)) for k in range(max(1, x + y - n), min(x, y) + 1))

    for n, x, y in [(10, 3, 4), (10, 10, 4), (1000, 600, 700), (5, 1, 1)]:
        assert metrics._expected_information(n, x, y, block=7) == pytest.approx(plain(n, x, y), rel=1e-9, abs=1e-12)


def test_kernel_rows_within_their_bound():
    x = RNG.normal(size=(200, 3))
    k = svm.KernelMatrix(x, lambda a, b: a @ b.T, full=10, held_bytes=200 * 8 * 32 * 2)
    assert all(np.allclose(k.row(i), x @ x[i]) for i in (0, 199, 64, 0, 33)) and len(k.held) == 2 and np.allclose(k.diag, (x * x).sum(axis=1))


def test_capabilities():
    known = registered_estimators()
    assert {"LinearRegression", "SparseMultinomialNB", "MiniBatchKMeans"} <= set(known) and known["LinearRegression"] is LinearRegression
    line = LinearRegression()
    assert not has_coefficients(line) and not declares_capability(line, "feature_importances_")
    line.coef_ = np.ones(2)
    assert has_coefficients(line) and not has_feature_importances(line)


def _stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, float(v), float(-v)) for i, v in enumerate(np.concatenate([RNG.normal(-5, 0.1, 50), RNG.normal(5, 0.1, 50)]))]
    spark.createDataFrame(rows, "row_id long, a double, b double").repartition(4).write.parquet(source)
    return spark.readStream.schema("row_id long, a double, b double").option("maxFilesPerTrigger", 1).parquet(source), np.array(rows)[:, 1:]


def test_stream_fits_and_goes_on(spark, tmp_path):
    stream, x = _stream(spark, tmp_path)
    model = cluster.MiniBatchKMeans(n_clusters=2)
    streaming.fit_stream(model, stream, ["a", "b"], str(tmp_path / "state")).awaitTermination()
    assert model.counts_.sum() == 100 and np.allclose(sorted(model.cluster_centers_[:, 0]), [-5, 5], atol=0.2)
    again = cluster.MiniBatchKMeans(n_clusters=2)
    streaming.fit_stream(again, stream, ["a", "b"], str(tmp_path / "state")).awaitTermination()
    assert again.counts_.sum() == 100 and np.allclose(again.cluster_centers_, model.cluster_centers_)


def test_stream_of_components(spark, tmp_path):
    stream, x = _stream(spark, tmp_path)
    model = decomposition.IncrementalPCA(n_components=1)
    streaming.fit_stream(model, stream, ["a", "b"], str(tmp_path / "state")).awaitTermination()
    assert model.n_ == 100 and np.allclose(model.mean_, x.mean(axis=0)) and np.allclose(np.abs(model.components_[0]), math.sqrt(0.5), atol=1e-6)


def test_moments_and_scores_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(60)] + [("2024-01-01 05:00:00", 1.0)]
    t = spark.createDataFrame(rows, "ts string, v double").select(F.to_timestamp("ts").alias("ts"), "v")
    t.write.parquet(source)
    rest = {str(r.window.start): (r.n, r.v_mean, r.v_var) for r in streaming.running_moments(t, ["v"], "ts").collect()}
    live = spark.readStream.schema("ts timestamp, v double").parquet(source)
    streaming.running_moments(live, ["v"], "ts").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {str(r.window.start): (r.n, r.v_mean, r.v_var) for r in spark.table("moments").collect()} == rest and len(rest) == 2
    line = LinearRegression().fit(t.withColumn("y", 2 * F.col("v")), ["v"], "y")
    streaming.score_stream(live, line).writeStream.format("memory").queryName("scores").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert all(abs(r.prediction - 2 * r.v) < 1e-8 for r in spark.table("scores").collect())
