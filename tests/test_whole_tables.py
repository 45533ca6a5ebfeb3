"""Operators on tables whose pairs of rows don't fit in memory: the same results, from blocks or from rows alone."""

import time
import tracemalloc

import numpy as np

from quarry.functions.distances import pairwise, top_eigen
from quarry.operators import cluster, decomposition, feature_selection, manifold, meta, metrics, neighbors, svm, trees


def rows(n, p=4, seed=0):
    return np.random.default_rng(seed).standard_normal((n, p))


def peak(fn):
    """Result, and the most bytes that were held while it was made."""
    tracemalloc.start()
    try:
        out = fn()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def table(spark, x, **more):
    names = [f"x{i}" for i in range(x.shape[1])]
    data = [(i, *map(float, r), *(float(v[i]) for v in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(data, ["row_id", *names, *more]), names


def test_silhouette_by_blocks(spark):
    x, k = rows(1500, 32), np.arange(1500) % 7
    x[10:20], k[3] = x[10], 99  # copies, and a row alone in its cluster
    df, names = table(spark, x, k=k)
    began = time.time()
    got = {r.row: r.value for r in metrics.silhouette_samples(df, names, "k").collect()}
    assert time.time() - began < 25
    d = pairwise(x, x)
    for i in (0, 3, 10, 11, 700):
        mean = {c: d[i, (k == c) & (np.arange(1500) != i)].mean() for c in set(k.tolist()) if ((k == c) & (np.arange(1500) != i)).any()}
        a, b = mean.pop(k[i], None), min(v for c, v in mean.items() if c != k[i])
        assert abs(got[i] - (0 if a is None else (b - a) / max(a, b))) < 1e-8


def test_silhouette_score_is_the_mean_of_its_samples(spark):
    x = rows(1500, 32, 1)
    x[:20] = np.nan_to_num(x[:20]) * 1e-9 + 1e3  # far from the origin: differences cancel in products
    df, names = table(spark, x, k=np.arange(1500) % 3)
    began = time.time()
    got = metrics.silhouette_score(df, names, "k").first()[0]
    assert time.time() - began < 25
    d, k, each = pairwise(x, x), np.arange(1500) % 3, []
    for i in range(1500):
        mean = [d[i, k == c].sum() / ((k == c).sum() - (c == k[i])) for c in range(3)]
        a = mean.pop(k[i])
        each.append((min(mean) - a) / max(a, min(mean)))
    assert abs(got - np.mean(each)) < 1e-9


def test_mds_needs_no_matrix_of_pairs():
    x = rows(3000, 6)
    m, most = peak(lambda: manifold.MDS().fit_arrays(x))
    assert most < 3000 * 3000 * 8 / 4
    small = rows(60, 5)
    assert np.allclose(manifold.MDS(n_components=3).fit_arrays(small).embedding_, manifold.MDS(n_components=3, dissimilarity="precomputed").fit_arrays(pairwise(small, small)).embedding_)
    assert manifold.MDS(n_components=4).fit_arrays(rows(9, 2)).embedding_.shape == (9, 4)
    assert m.max_rows > 10_256


def test_mean_shift_by_blocks():
    x = np.vstack([rows(1250, 16) * 0.01, rows(1250, 16, 1) * 0.01 + 1])
    m, most = peak(lambda: cluster.MeanShift(bandwidth=1.0).fit_arrays(x))
    assert most < 60e6 and len(m.cluster_centers_) == 2
    edge = np.array([[0.0, 0], [0.6, 0], [0, 0.6], [0, 0.6 + 1e-12]])  # rows on the border are told by their differences
    assert (cluster.MeanShift(bandwidth=0.6)._inside(edge, edge) == (pairwise(edge, edge) <= 0.6)).all()


def test_linkage_needs_no_matrix_of_pairs():
    x = rows(150, 3)
    x[20:30] = x[20]
    for method in ("ward", "single"):
        got, want = cluster.linkage(x, method), cluster.linkage(x, "ward", "2-norm") if method == "ward" else None
        if want:  # by Lance and Williams
            assert np.allclose([h for _, _, h, _ in got], [h for _, _, h, _ in want], atol=1e-7)
            assert (cluster.cut(got, 150, 5) == cluster.cut(want, 150, 5)).all()
        assert got[-1][3] == 150
    d = pairwise(x, x)
    near = cluster.cut(cluster.linkage(x, "single"), 150, 4)
    assert min(d[i, j] for i in range(150) for j in range(150) if near[i] != near[j]) >= sorted(h for _, _, h, _ in cluster.linkage(x, "single"))[-3] - 1e-12
    _, most = peak(lambda: cluster.AgglomerativeClustering(n_clusters=4).fit_arrays(rows(2500)))
    assert most < 2500 * 2500 * 8 / 4 and cluster.AgglomerativeClustering().max_rows > 10_256


def test_hdbscan_needs_no_matrix_of_pairs():
    x = np.vstack([rows(1500, 3) * 0.1, rows(1500, 3, 1) * 0.1 + 5])
    m, most = peak(lambda: cluster.HDBScan(min_cluster_size=50).fit_arrays(x))
    assert most < 3000 * 3000 * 8 / 2 and m.max_rows > 10_256
    assert len(set(m.labels_[:1500]) - {-1.0}) == 1 and not set(m.labels_[:1500]) & set(m.labels_[1500:]) - {-1.0}


def test_optics_needs_no_matrix_of_pairs():
    x = np.vstack([rows(1500, 3) * 0.1, rows(1500, 3, 1) * 0.1 + 5])
    m, most = peak(lambda: cluster.OPTICS(eps=0.5).fit_arrays(x))
    assert most < 3000 * 3000 * 8 / 2 and m.max_rows > 10_256
    assert np.allclose(m.core_distances_, np.sort(pairwise(x, x), axis=1)[:, 4])
    assert len(set(m.labels_)) == 2 and len(set(m.labels_[:1500])) == 1


def test_birch_of_many_subclusters_needs_no_matrix_of_pairs():
    x = rows(2500, 16)
    m, most = peak(lambda: cluster.Birch(threshold=0.1).fit_arrays(x))  # each row a subcluster
    assert len(m.subclusters_) == 2500 and most < 60e6
    assert (m.labels_ == cluster.AgglomerativeClustering(n_clusters=3).fit_arrays(x).labels_).all()


def test_kernel_ridge_without_the_kernel_matrix():
    x, y = rows(400, 5), rows(400, 1, 3)[:, 0]
    whole = svm.KernelRidge(kernel="rbf").fit_arrays(x, y)
    parts = svm.KernelRidge(kernel="rbf")
    parts.DENSE_ROWS = 10
    assert np.allclose(parts.fit_arrays(x, y).dual_, whole.dual_, atol=1e-9) and parts.max_rows > 10_256
    big = rows(5200, 2)
    m, most = peak(lambda: svm.KernelRidge(kernel="rbf", alpha=50.0).fit_arrays(big, big[:, 0]).predict_arrays(big))
    assert len(m) == 5200 and most < 5200 * 5200 * 8 * 0.8


def test_kernel_pca_without_the_kernel_matrix():
    x = rows(1500, 5) * np.array([5, 3, 2, 1, 1])
    whole, parts = (decomposition.KernelPCA(n_components=3, kernel="rbf") for _ in range(2))
    parts.DENSE_ROWS = 10
    whole.fit_arrays(x), parts.fit_arrays(x)
    assert np.allclose(whole.eigenvalues_, parts.eigenvalues_) and np.allclose(whole.transform_arrays(x), parts.transform_arrays(x), atol=1e-7)
    assert parts.max_rows > 10_256
    _, most = peak(lambda: parts.transform_arrays(rows(8000, 5)))
    assert most < 8000 * 1500 * 8


def test_spectral_clustering_without_the_affinity_matrix():
    x = np.vstack([rows(1000, 3) * 0.1, rows(1000, 3, 1) * 0.1 + 2])
    for affinity in ("rbf", "nearest"):
        m = cluster.SpectralClustering(n_clusters=2, n_init=2, affinity=affinity).fit_arrays(x)
        assert len(set(m.labels_[:1000])) == len(set(m.labels_[1000:])) == 1 and m.labels_[0] != m.labels_[-1]
    a = np.exp(-(pairwise(x, x) ** 2))
    v, u = top_eigen(lambda b: a @ b, 2000, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(v, want) and np.allclose(a @ u, u * v, atol=1e-6) and m.max_rows > 10_256


def test_label_propagation_without_the_graph_matrix():
    x = np.vstack([rows(1500, 3) * 0.2, rows(1500, 3, 1) * 0.2 + 2])
    y = np.full(3000, -1.0)
    y[[0, -1]] = 0, 1
    for kernel in ("rbf", "knn"):
        m, most = peak(lambda k=kernel: meta.LabelPropagation(gamma=5.0, kernel=k, max_iter=3).fit_arrays(x, y))
        assert most < 3000 * 3000 * 8 * (1.6 if kernel == "rbf" else 2.2) and m.max_rows > 10_256
    a = np.exp(-5 * pairwise(x, x) ** 2)
    f = (y[:, None] == np.array([0.0, 1.0])).astype(float)
    for _ in range(3):
        f = a @ f / a.sum(axis=1, keepdims=True)
        f, known = f / np.maximum(f.sum(axis=1, keepdims=True), 1e-300), y != -1
        f[known] = (y[known][:, None] == np.array([0.0, 1.0])).astype(float)
    assert np.allclose(meta.LabelPropagation(gamma=5.0, max_iter=3).fit_arrays(x, y).distributions_, f)


def test_label_spreading_without_the_graph_matrix():
    x = rows(300, 3)
    y = np.where(np.arange(300) % 3 == 0, (x[:, 0] > 0) * 1.0, -1.0)
    given = (y[:, None] == np.array([0.0, 1.0])).astype(float)
    near = np.argsort(pairwise(x, x) + np.diag(np.full(300, np.inf)), axis=1, kind="stable")[:, :7]
    knn = np.zeros((300, 300))
    knn[np.repeat(np.arange(300), 7), near.ravel()] = 1
    rbf = np.exp(-20 * pairwise(x, x) ** 2) - np.eye(300)
    for kernel, a in (("rbf", rbf), ("knn", np.maximum(knn, knn.T))):
        d = np.sqrt(a.sum(axis=1))
        f = given
        for _ in range(4):
            f = 0.2 * (a / np.outer(d, d)) @ f + 0.8 * given
        m = meta.LabelSpreading(kernel=kernel, max_iter=4, tol=0).fit_arrays(x, y)
        assert np.allclose(m.distributions_, f / f.sum(axis=1, keepdims=True)) and m.max_rows > 10_256


def test_spectral_embedding_without_the_graph_matrix():
    x = rows(1500, 3)
    m, most = peak(lambda: manifold.SpectralEmbedding().fit_arrays(x))
    near = np.argsort(pairwise(x, x) + np.diag(np.full(1500, np.inf)), axis=1, kind="stable")[:, :10]
    a = np.zeros((1500, 1500))
    a[np.repeat(np.arange(1500), 10), near.ravel()] = 1
    a = (a + a.T) / 2
    deg = a.sum(axis=1)
    f = m.embedding_  # generalised vectors of the Laplacian, with the smallest values but one
    values = (f * (deg[:, None] * f - a @ f)).sum(axis=0) / (deg[:, None] * f * f).sum(axis=0)
    want = np.linalg.eigvalsh(np.eye(1500) - a / np.sqrt(np.outer(deg, deg)))[1:3]
    assert np.allclose(values, want, atol=1e-9) and np.allclose(deg[:, None] * f - a @ f, values * deg[:, None] * f, atol=1e-6)
    assert m.max_rows > 10_256
    _, most = peak(lambda: manifold.SpectralEmbedding().fit_arrays(rows(4000, 3)))
    assert most < 4000 * 4000 * 8


def test_mutual_information_looks_only_around_each_point():
    v, t = rows(3000, 1)[:, 0], rows(3000, 1, 1)[:, 0]
    t[:500] = v[:500] * 2
    v[500:520], t[500:520] = 3.0, -1.0  # equal points
    v[520] = 1e6
    d = np.maximum(np.abs(v[:, None] - v[None]), np.abs(t[:, None] - t[None]))
    assert (feature_selection._kth_in_plane(v, t, 3) == np.partition(d, 3, axis=1)[:, 3]).all()
    x, began = rows(60_000, 1), time.time()
    whole = feature_selection.mutual_info_arrays(np.hstack([x, x[::-1]]), x[:, 0] + 1, False)
    assert time.time() - began < 20
    assert whole[1] == feature_selection.mutual_info_arrays(np.hstack([x, x[::-1]]), x[:, 0] + 1, False, only=1)[0]


def test_kernel_rows_are_made_one_by_one():
    x = rows(2500, 3)
    m = svm.SVC(gamma=0.5)
    m._setup(x)
    k = m._rows(x)
    assert np.allclose(k.row(2100), m._k(x[2100:2101], x)[0], atol=1e-14) and k.height == 1
    assert np.allclose(k.row(0), m._k(x[:1], x)[0], atol=1e-14) and sorted(k.held) == [0, 2100]


def test_tree_queries_together():
    x = np.vstack([rows(3000, 3), np.repeat(rows(1, 3, 7), 60, axis=0)])  # and copies: ties go to the first
    q = np.vstack([x[::7], rows(200, 3, 5) * 3, [[np.nan] * 3]])
    d = pairwise(q[:-1], x)
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    for kind in (neighbors.BallTree, neighbors.KDTree):
        for metric in ("euclidean", "manhattan"):
            tree = kind(x, metric=metric)
            got_d, got_i = tree.query(q, 4)
            want = d if metric == "euclidean" else pairwise(q[:-1], x, "manhattan")
            near = np.argsort(want, axis=1, kind="stable")[:, :4]
            assert (got_i[:-1] == near).all() and (got_d[:-1] == np.take_along_axis(want, near, axis=1)).all()
    big, began = neighbors.BallTree(rows(10_000, 64)), time.time()
    assert big.query(rows(1000, 64, 2), 3)[1].shape == (1000, 3) and time.time() - began < 15
    assert neighbors.BallTree(x[:3]).query(x[:5], 9)[0].shape == (5, 3)


def test_one_vs_rest_grows_a_member_per_task(spark, monkeypatch):
    x = rows(300, 3)
    df, names = table(spark, x, y=np.arange(300) % 3)
    m = meta.OneVsRestClassifier(estimator=trees.DecisionTreeClassifier())
    seen = []
    monkeypatch.setattr(trees, "fit_members", lambda *a, f=trees.fit_members: seen.append(len(a[2])) or f(*a))
    m.fit(df, names, "y")
    assert seen == [3]
    assert [(r.prediction, r.y) for r in m.predict(df).collect() if r.prediction != r.y] == []
    assert (m.estimators_[1].predict_arrays(x) == (np.arange(300) % 3 == 1)).all()
