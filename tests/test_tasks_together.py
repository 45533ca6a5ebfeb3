"""Methods that need all pairs in each round, on tasks that hold blocks of rows: the same results as in one place."""

import numpy as np
import pytest

from quarry.functions.distances import kernel
from quarry.operators import cluster, manifold, svm
from quarry.plans.together import Team, cholesky_solver, together


def rows(n, p=4, seed=0):
    return np.random.default_rng(seed).standard_normal((n, p))


def in_tasks(model, x):
    model.DENSE_ROWS = 10
    return model.fit_arrays(x)


def test_tasks_share_and_refuse_what_they_cannot_hold(spark):
    def fn(team: Team, x):
        return team.size, team.joined(team.rows(len(x))), team.total(x[team.rows(len(x))].sum(axis=0))

    x = rows(50)
    size, order, total = together(fn, x, pair_bytes=8)
    assert size == 4 and (order == np.arange(50)).all() and np.allclose(total, x.sum(axis=0))
    with pytest.raises(ValueError, match="at once"):
        together(fn, x, pair_bytes=10**9)


def test_affinity_propagation_in_tasks(spark):
    for x in (rows(300), rows(301, 3, 1)):  # without copies: the noise that breaks ties is drawn row by row
        whole, parts = cluster.AffinityPropagation().fit_arrays(x), in_tasks(cluster.AffinityPropagation(), x)
        assert len(whole.exemplars_) == len(parts.exemplars_) and parts.converged_ == whole.converged_
        pairs = set(zip(whole.labels_.tolist(), parts.labels_.tolist(), strict=True))
        assert len(pairs) == len(whole.exemplars_)  # the same clusters
    assert cluster.AffinityPropagation().max_rows > 10_256


def test_isomap_in_tasks(spark):
    for x in (rows(300), np.repeat(rows(50, 3, 1), 6, axis=0)):  # and components of copies, which are bridged
        whole, parts = manifold.Isomap().fit_arrays(x), in_tasks(manifold.Isomap(), x)
        assert np.allclose(whole.embedding_, parts.embedding_, atol=1e-9) and np.allclose(whole.values_, parts.values_)
        assert np.allclose(whole.transform_arrays(x[:40] + 0.1), parts.transform_arrays(x[:40] + 0.1), atol=1e-9)
    assert manifold.Isomap().max_rows > 10_256


def test_tsne_in_tasks(spark):
    x = rows(300)
    whole, parts = manifold.TSNE(n_iter=30).fit_arrays(x), in_tasks(manifold.TSNE(n_iter=30), x)
    assert np.allclose(whole.embedding_, parts.embedding_, atol=1e-6) and manifold.TSNE().max_rows > 10_256


def test_locally_linear_embedding_in_tasks(spark):
    x = np.random.default_rng(2).uniform(size=(700, 2))
    x = np.column_stack([x * [3, 1], np.sin(3 * x[:, 0])])
    whole, parts = manifold.LLE(n_neighbors=9).fit_arrays(x), in_tasks(manifold.LLE(n_neighbors=9), x)
    assert np.allclose(whole.embedding_, parts.embedding_, atol=1e-5) and manifold.LLE().max_rows > 10_256
    assert np.allclose(whole.transform_arrays(x[:9] + 0.01), parts.transform_arrays(x[:9] + 0.01), atol=1e-5)


def test_tasks_solve_together(spark):
    def fn(team: Team, a, b):
        i, j = np.divmod(np.arange(a.size), len(a))
        return cholesky_solver(team, i, j, a.ravel(), len(a), height=16)(b)

    a, b = rows(150, 150), rows(150, 3, 1)
    a = a @ a.T + np.eye(150)
    assert np.allclose(a @ together(fn, a, b, pair_bytes=8), b, atol=1e-8)


def test_nu_svr_by_working_sets(spark):
    x = rows(2100, 3)
    y = np.sin(2 * x[:, 0]) + 0.3 * rows(2100, 1, 5)[:, 0]
    parts = svm.NuSVR(nu=0.3).fit_arrays(x, y)
    k = parts._rows(x)
    k.full = len(x)
    coef, b, epsilon = svm.solve_nu_svr(k, y, 1.0, 0.3, 1e-4)
    m = parts._machine(x, coef, b)
    assert abs(parts.fitted_epsilon_ - epsilon) < 1e-3 and np.abs(parts.predict_arrays(x) - parts._value(m, x)).max() < 2e-3


def test_working_sets_stop_at_the_same_gap():
    x, c = rows(400, 3), 1.0
    y = np.sin(2 * x[:, 0]) + 0.3 * rows(400, 1, 5)[:, 0]
    fn = lambda a, b: kernel(a, b, "rbf", 0.5)
    for paired, p, start in ((False, np.concatenate([0.1 - y, 0.1 + y]), np.zeros(800)), (True, np.concatenate([-y, y]), np.tile(np.arange(400) < 100, 2) * c)):
        a, g = svm.smo_in_tasks(Team(), x, p, c, start.astype(float), 1e-4, fn, paired, size=32)
        sign = np.repeat([1.0, -1.0], 400)
        f = fn(x, x) @ (a[:400] - a[400:])
        assert np.allclose(g, np.concatenate([f, -f]) + p, atol=1e-9) and abs(a @ sign - start @ sign) < 1e-9 and (a >= 0).all() and (a <= c).all()
        v, up, low = -sign * g, np.where(sign > 0, a < c, a > 0), np.where(sign > 0, a > 0, a < c)
        for side in (sign > 0, sign < 0) if paired else (sign != 0,):
            assert v[up & side].max() - v[low & side].min() < 1e-4


def test_svr_by_working_sets(spark):
    x = rows(2100, 3)
    y = np.sin(2 * x[:, 0]) + 0.3 * rows(2100, 1, 5)[:, 0]
    parts = svm.SVR().fit_arrays(x, y)
    k = parts._rows(x)
    assert k.large
    k.full = len(x)
    m = parts._machine(x, *svm.solve_epsilon_svr(k, y, 1.0, 0.1, 1e-4))
    assert np.abs(parts.predict_arrays(x) - parts._value(m, x)).max() < 2e-3


def test_active_rows_stop_at_the_same_gap():
    x = rows(500, 3)
    y = np.sin(2 * x[:, 0]) + 0.3 * rows(500, 1, 5)[:, 0]
    fn = lambda a, b: kernel(a, b, "rbf", 0.5)
    sign, c = np.repeat([1.0, -1.0], 500), np.tile(np.where(np.arange(500) % 5, 1.0, 3.0), 2)
    for paired, p, start in ((False, np.concatenate([0.1 - y, 0.1 + y]), np.zeros(1000)), (True, np.concatenate([-y, y]), np.tile(np.arange(500) < 100, 2) * 1.0)):
        a, g = svm.smo_in_tasks(Team(), x, p, c, start.copy(), 1e-4, fn, paired, size=32, held_bytes=8 * 100**2)  # 100 active rows
        f = fn(x, x) @ (a[:500] - a[500:])
        assert np.allclose(g, np.concatenate([f, -f]) + p, atol=1e-9) and abs(a @ sign - start @ sign) < 1e-9 and (a >= 0).all() and (a <= c).all() and (a > 1).any()
        v, up, low = -sign * g, np.where(sign > 0, a < c, a > 0), np.where(sign > 0, a > 0, a < c)
        for side in (sign > 0, sign < 0) if paired else (sign != 0,):
            assert v[up & side].max() - v[low & side].min() < 1e-4


def test_svr_makes_few_kernel_values(monkeypatch):
    x = rows(4000, 16) / 4
    y, made, old = 10 * x[:, 0] + 5 * x[:, 1] ** 2, [], svm.kernel
    monkeypatch.setattr(svm, "kernel", lambda a, b, *rest: made.append(len(a) * len(b)) or old(a, b, *rest))
    monkeypatch.setattr(svm, "together", lambda fn, *arrays, pair_bytes: fn(Team(), *arrays))
    svm.SVR().fit_arrays(x, y)
    assert sum(made) < 5 * 4000**2


def test_svr_solves_copies_once(monkeypatch):
    x = np.asfortranarray(np.tile(rows(300, 3), (7, 1)))  # as rows come from a table
    y = np.sin(2 * x[:, 0]) + 0.3 * np.tile(rows(300, 1, 5)[:, 0], 7)
    parts = svm.SVR().fit_arrays(x, y)
    k = parts._rows(x)
    k.full = len(x)
    m = parts._machine(x, *svm.solve_epsilon_svr(k, y, 1.0, 0.1, 1e-4))
    assert len(parts.machine_[1]) <= 300 and np.abs(parts.machine_[1]).max() > 1 and np.abs(parts.predict_arrays(x) - parts._value(m, x)).max() < 2e-3
