"""Support vector machines: dual solvers over a kernel matrix (numpy), scored on Arrow batches."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from functools import cached_property

import numpy as np

from quarry.functions.distances import by_blocks, kernel, solve_positive
from quarry.operators.base import MAX_ROWS, ArrayEstimator, Classifier, OutlierDetector, Regressor, classes_of
from quarry.operators.linear import plain_sgd  # noqa: F401  (same family)
from quarry.plans.together import together


class KernelMatrix:
    """Kernel values by blocks of rows, made when one is first asked for.

    Small matrices fit in one block.  Of larger ones as many blocks are held as `held_bytes` allow, and the
    block that was used longest ago makes room.  Where `one` gives a row by its number, blocks are single rows:
    solvers ask for rows in no order.
    """

    def __init__(self, x: np.ndarray, fn, full: int = 2000, held_bytes: int = 1 << 28, one=None) -> None:
        self.x, self.fn, self.one, self.full = x, fn, one, full
        self.height = len(x) if len(x) <= full else 1 if one else min(len(x), 32)
        self.most = max(2, held_bytes // (8 * max(1, self.height * len(x))))
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    @cached_property
    def diag(self) -> np.ndarray:
        return np.concatenate([self.fn(r[None], r[None])[0] for r in self.x]) if len(self.x) else np.zeros(0)

    @property
    def large(self) -> bool:
        return len(self.x) > self.full

    def in_tasks(self, p, c, alpha, tol, paired=False):
        fn = self.fn
        return together(lambda team, x: smo_in_tasks(team, x, p, c, alpha, tol, fn, paired), self.x, pair_bytes=0)

    @property
    def all(self) -> np.ndarray:
        return np.array([self.row(i) for i in range(len(self.x))])

    def row(self, i: int) -> np.ndarray:
        at, inside = divmod(i, self.height)
        if at in self.held:
            self.held.move_to_end(at)
        else:
            if len(self.held) == self.most:
                self.held.popitem(last=False)
            self.held[at] = self.one(i)[None] if self.one and self.height == 1 else self.fn(self.x[at * self.height : (at + 1) * self.height], self.x)
        return self.held[at][inside]


def smo(q_row, diag: np.ndarray, p: np.ndarray, y: np.ndarray, c: np.ndarray, alpha: np.ndarray, tol: float, max_iter: int, paired: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Minimises a'Qa/2 + p'a with y'a kept and 0 <= a <= c by pairs of greatest violation, second-order choice.

    paired: pairs are of one sign (the nu problems keep both class sums).  Returns a and the gradient.
    """
    n = len(p)
    g = p.astype(float).copy()
    for i in np.flatnonzero(alpha):
        g += alpha[i] * q_row(i)
    for _ in range(max_iter if max_iter > 0 else max(100_000, 100 * n)):
        up = np.where(y > 0, alpha < c, alpha > 0)
        low = np.where(y > 0, alpha > 0, alpha < c)
        v = -y * g
        best = None
        for sign in (1, -1) if paired else (0,):
            side = (y == sign) if sign else np.ones(n, bool)
            a, b = up & side, low & side
            if not a.any() or not b.any():
                continue
            i = int(np.flatnonzero(a)[v[a].argmax()])
            gap = v[i] - v[b].min()
            if best is None or gap > best[0]:
                best = (gap, i, b)
        if best is None or best[0] < tol:
            break
        _, i, b = best
        qi = q_row(i)
        diff = v[i] - v
        ok = b & (diff > 0)
        curve = np.maximum(diag[i] + diag - 2 * y[i] * y * qi, 1e-12)
        j = int(np.flatnonzero(ok)[(diff[ok] ** 2 / curve[ok]).argmax()])
        step = diff[j] / curve[j]
        step = min(step, c[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c[j] - alpha[j])
        di, dj = y[i] * step, -y[j] * step
        alpha[i] += di
        alpha[j] += dj
        g += di * qi + dj * q_row(j)
    return np.clip(alpha, 0, c), g


def _worst(v, up, low, many: int, among=None) -> tuple[float, list[np.ndarray]]:
    """The gap of the most violating pair, and the variables (among: of these) that violate most from either side."""
    a, b = np.flatnonzero(up), np.flatnonzero(low)
    if not len(a) or not len(b):
        return 0.0, []
    most, least = v[a].max(), v[b].min()
    if among is not None:
        a, b = a[among[a]], b[among[b]]
    a, b = a[v[a] > least], b[v[b] < most]
    out = [k[np.argpartition(w, many)[:many]] if len(k) > many else k for k, w in ((a, -v[a]), (b, v[b]))]
    return float(most - least), out


def _violators(sign, g, c, alpha, many: int, tol: float, paired: bool, among=None) -> tuple[float, np.ndarray]:
    """The largest gap, and up to about `many` variables of the pairs that violate most."""
    v = -sign * g
    up, low = np.where(sign > 0, alpha < c, alpha > 0), np.where(sign > 0, alpha > 0, alpha < c)
    sides = [sign > 0, sign < 0] if paired else [np.ones(len(sign), bool)]
    found = [_worst(v, up & side, low & side, max(1, many // (2 * len(sides))), among) for side in sides]
    return max(w for w, _ in found), np.unique(np.concatenate([np.zeros(0, int), *[part for w, parts in found if w >= tol for part in parts]]))


def _active(sign, g, c, alpha, most: int, size: int, tol: float, paired: bool, worst) -> np.ndarray:
    """Up to `most` rows: the worst, those with coefficients, and of the others those that violate most."""
    kept = (alpha > 0).reshape(2, -1).any(axis=0)
    many = min(most // 2, max(8 * size, 2 * int(kept.sum())))
    among = np.tile(~kept, 2) if kept.sum() + many <= most else None  # else kept rows take part by what they violate
    active = np.union1d(worst, _violators(sign, g, c, alpha, many, tol, paired, among)[1] % len(kept))
    rest = np.setdiff1d(np.flatnonzero(kept), active)
    bound = ((alpha == 0) | (alpha == c)).reshape(2, -1)[:, rest].all(axis=0)
    return np.union1d(active, rest[np.argsort(bound, kind="stable")][: max(0, most - len(active))])  # free ones first


def smo_in_tasks(team, x: np.ndarray, p: np.ndarray, c, alpha: np.ndarray, tol: float, k, paired: bool = False, size: int = 768, held_bytes: int = 1 << 28):
    """smo() of a doubled problem (n variables of sign 1, n of sign -1) by active rows, and of these by working sets.

    Active are the rows with coefficients and those that violate most, as many as have their kernel in panels of
    held_bytes in each task.  When they are solved, each task brings the products of the kernel with the coefficients
    up to date for its own rows, of all; that tells the next active rows.  Stops by the same gap over all rows.
    """
    n, mine = len(x), team.rows(len(x))
    sign, c = np.repeat([1.0, -1.0], n), np.broadcast_to(np.asarray(c, float), (2 * n,))
    f, g = np.zeros(len(mine)), p
    most = max(size, int((held_bytes / 8 * team.size) ** 0.5))
    beta = alpha[:n] - alpha[n:]
    change = np.flatnonzero(beta), beta[beta != 0]
    while True:
        for s in range(0, len(change[0]), size):
            rows, by = x[change[0][s : s + size]], change[1][s : s + size]
            f += by_blocks(lambda r, rows=rows, by=by: k(r, rows) @ by, x[mine], width=4 * len(rows))  # blocks that stay in the caches
        parts, job = team.first(f), None
        if team.rank == 0:
            whole = np.concatenate(parts)
            g = np.concatenate([whole, -whole]) + p
            gap, worst = _violators(sign, g, c, alpha, size // 2, tol, paired)
            if gap >= tol:
                active = np.arange(n) if n <= most else _active(sign, g, c, alpha, most, size, tol, paired, worst % n)
                two = np.concatenate([active, active + n])
                job = active, g[two], c[two], alpha[two], tol if n <= most else max(tol / 2, gap / 100)
        job = team.share(job)[0]
        if job is None:
            return (alpha, g) if team.rank == 0 else None
        a, change = _smo_in_panels(team, x[job[0]], *job[1:], k, paired, size), None
        if team.rank == 0:
            step = (a - alpha[two])[: len(active)] - (a - alpha[two])[len(active) :]
            change = (active[step != 0], step[step != 0]) if (a != alpha[two]).any() else None  # None: no pair can move any more
            alpha[two] = a
        change = team.share(change)[0]
        if change is None:
            return (alpha, g) if team.rank == 0 else None


def _smo_in_panels(team, x, g, c, alpha, tol, k, paired, size):
    """The coefficients of active rows, on task 0: the others' stay.  Each task holds the kernel of its part of them.

    Task 0 takes the variables that violate most, and some of the last set, solves for them by pairs and tells what changed.
    """
    n = len(x)
    mine = x[team.rows(n)]
    panel = by_blocks(lambda r: k(r, mine), x, width=4 * len(mine)) if len(mine) else np.zeros((n, 0))
    sign, at, began = np.repeat([1.0, -1.0], n), np.tile(np.arange(n), 2), g
    alpha, f, old = alpha.copy(), np.zeros(len(mine)), np.zeros(0, int)
    while True:
        parts, change = team.first(f), None
        if team.rank == 0:
            whole = np.concatenate(parts)
            g = began + np.concatenate([whole, -whole])
            gap, new = _violators(sign, g, c, alpha, size // 2, tol, paired)
            if gap >= tol:
                old = old[~np.isin(old, new)]
                inside = np.concatenate([new, old[: size - len(new)]])
                q = k(x[at[inside]], x[at[inside]]) * np.outer(sign[inside], sign[inside])
                start, most = alpha[inside], c[inside]
                a, _ = smo(q.__getitem__, np.diag(q).copy(), g[inside] - q @ start, sign[inside], most, start.copy(), max(tol / 2, gap / 10), 20 * size, paired)
                alpha[inside], step = a, (a - start) * sign[inside]
                ids, back = np.unique(at[inside], return_inverse=True)
                step = np.bincount(back, step)
                change = (ids[step != 0], step[step != 0]) if (a != start).any() else None
                old = inside[np.argsort(np.minimum(a, most - a) <= 0, kind="stable")]  # free ones first
        change = team.share(change)[0]
        if change is None:
            return alpha if team.rank == 0 else None
        f += change[1] @ panel[change[0]]


def _offset(y, g, alpha, c) -> float:
    free = (alpha > 1e-12) & (alpha < c - 1e-12)
    v = y * g
    if free.any():
        return float(v[free].mean())
    up = v[np.where(y > 0, alpha >= c - 1e-12, alpha <= 1e-12)]
    low = v[np.where(y > 0, alpha <= 1e-12, alpha >= c - 1e-12)]
    return float(((up.max() if len(up) else low.min()) + (low.min() if len(low) else up.max())) / 2)


def solve_c_svc(k: KernelMatrix, y, c, tol=1e-3, max_iter=-1):
    n = len(y)
    a, g = smo(lambda i: y[i] * y * k.row(i), k.diag, -np.ones(n), y, np.broadcast_to(np.asarray(c, float), (n,)), np.zeros(n), tol, max_iter)
    return a * y, -_offset(y, g, a, np.broadcast_to(np.asarray(c, float), (n,)))


def _fill(total: float, most: np.ndarray) -> np.ndarray:
    out = np.zeros(len(most))
    for i, m in enumerate(most):
        out[i] = min(m, total)
        total -= out[i]
        if total <= 0:
            break
    return out


def _two_offsets(y, g, a, c):
    out = []
    for s in (1, -1):
        who = y == s
        free = who & (a > 1e-12) & (a < c - 1e-12)
        if free.any():
            out.append(float(g[free].mean()))
        else:
            hi, lo = g[who & (a >= c - 1e-12)], g[who & (a <= 1e-12)]
            out.append(float(((hi.max() if len(hi) else lo.min()) + (lo.min() if len(lo) else hi.max())) / 2))
    return out


def solve_nu_svc(k: KernelMatrix, y, nu, tol=1e-3, max_iter=-1):
    n = len(y)
    if nu * n / 2 > min((y > 0).sum(), (y < 0).sum()):
        raise ValueError("nu is too large for these classes")
    c = np.ones(n)
    a = np.zeros(n)
    for s in (1, -1):
        a[y == s] = _fill(nu * n / 2, c[y == s])
    a, g = smo(lambda i: y[i] * y * k.row(i), k.diag, np.zeros(n), y, c, a, tol, max_iter, paired=True)
    r1, r2 = _two_offsets(y, g, a, c)
    r, rho = (r1 + r2) / 2, (r1 - r2) / 2
    return a * y / max(r, 1e-12), -rho / max(r, 1e-12)


def _solve_doubled(k: KernelMatrix, p, most, start, tol, max_iter, paired=False):
    """Coefficients and gradient of n variables of sign 1 and n of sign -1 over the same rows."""
    if k.large and max_iter <= 0:
        return k.in_tasks(p, most, start, tol, paired)
    n = len(p) // 2
    sign = np.repeat([1.0, -1.0], n)
    return smo(lambda i: sign[i] * sign * np.tile(k.row(i % n), 2), np.tile(k.diag, 2), p, sign, most, start, tol, max_iter, paired)


def _merged(x, y, c):
    """Each different row and target once, with the sum of its copies' bounds: the same problem, as only their sum counts."""
    rows = np.ascontiguousarray(np.column_stack([x, y]))
    _, first, many = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_index=True, return_counts=True)
    rows = rows[np.sort(first)]
    return rows[:, :-1].copy(), rows[:, -1].copy(), c * many[np.argsort(first)]


def solve_epsilon_svr(k: KernelMatrix, y, c, epsilon, tol=1e-3, max_iter=-1):
    """c: one bound, or one for each row."""
    n = len(y)
    most = np.tile(np.broadcast_to(np.asarray(c, float), (n,)), 2)
    a, g = _solve_doubled(k, np.concatenate([epsilon - y, epsilon + y]), most, np.zeros(2 * n), tol, max_iter)
    return a[:n] - a[n:], -_offset(np.repeat([1.0, -1.0], n), g, a, most)


def solve_nu_svr(k: KernelMatrix, y, c, nu, tol=1e-3, max_iter=-1):
    n = len(y)
    sign, most = np.repeat([1.0, -1.0], n), np.full(2 * n, float(c))
    half = _fill(c * nu * n / 2, most[:n])
    a, g = _solve_doubled(k, np.concatenate([-y, y]), most, np.concatenate([half, half]), tol, max_iter, paired=True)
    r1, r2 = _two_offsets(sign, g, a, most)
    return a[:n] - a[n:], -(r1 - r2) / 2, -(r1 + r2) / 2


def solve_one_class(k: KernelMatrix, n: int, nu, tol=1e-3, max_iter=-1):
    c = np.ones(n)
    a, g = smo(k.row, k.diag, np.zeros(n), np.ones(n), c, _fill(nu * n, c), tol, max_iter)
    return a, -_offset(np.ones(n), g, a, c)


_KERNEL = {"kernel": "rbf", "gamma": "scale", "degree": 3, "coef0": 0.0, "tol": 1e-4, "max_iter": -1}


class _Kernel(ArrayEstimator):
    def _setup(self, x):
        var = x.var()
        self.gamma_ = (1 / (x.shape[1] * var) if var > 0 else 1.0) if self.gamma == "scale" else 1 / x.shape[1] if self.gamma == "auto" else float(self.gamma)

    def _k(self, a, b):
        return kernel(a, b, self.kernel, self.gamma_, self.degree, self.coef0)

    def _rows(self, x):
        """The kernel matrix of x; rows of the rbf kernel by one product with the norms at hand."""
        if self.kernel != "rbf":
            return KernelMatrix(x, self._k)
        norms = (x * x).sum(axis=1)
        return KernelMatrix(x, self._k, one=lambda i: np.exp(-self.gamma_ * np.maximum(norms + norms[i] - 2 * (x @ x[i]), 0)))

    def _machine(self, x, coef, b):
        keep = np.abs(coef) > 1e-12
        return x[keep], coef[keep], float(b)

    def _value(self, m, x):
        return by_blocks(lambda r: self._k(r, m[0]) @ m[1] + m[2], x, width=len(m[1])) if len(m[1]) else np.full(len(x), m[2])


class SVC(Classifier, _Kernel):
    """One machine for each pair of classes; most votes win, ties to the smaller class."""

    params = {**_KERNEL, "c": 1.0}

    def _solve(self, k, y):
        return solve_c_svc(k, y, self.c, self.tol, self.max_iter)

    def fit_arrays(self, x, y, w=None):
        self._setup(x)
        self.classes_, at = classes_of(y)
        self.machines_ = []
        for i, j in itertools.combinations(range(len(self.classes_)), 2):
            who = (at == i) | (at == j)
            xs, ys = x[who], np.where(at[who] == j, 1.0, -1.0)
            self.machines_.append(self._machine(xs, *self._solve(self._rows(xs), ys)))
        return self

    def decision_arrays(self, x):
        if len(self.classes_) != 2:
            raise ValueError("decisions are for two classes")
        return self._value(self.machines_[0], x)

    def predict_arrays(self, x):
        votes = np.zeros((len(x), len(self.classes_)))
        for (i, j), m in zip(itertools.combinations(range(len(self.classes_)), 2), self.machines_, strict=True):
            d = self._value(m, x)
            votes[:, j] += d > 0
            votes[:, i] += d <= 0
        return self.classes_[votes.argmax(axis=1)]


class NuSVC(SVC):
    params = {"nu": 0.5}

    def _solve(self, k, y):
        return solve_nu_svc(k, y, self.nu, self.tol, self.max_iter)


class SVR(Regressor, _Kernel):
    params = {**_KERNEL, "c": 1.0, "epsilon": 0.1}

    def fit_arrays(self, x, y, w=None):
        self._setup(x)
        c = self.c
        if self._rows(x).large and self.max_iter <= 0:
            x, y, c = _merged(x, y, c)
        self.machine_ = self._machine(x, *solve_epsilon_svr(self._rows(x), y, c, self.epsilon, self.tol, self.max_iter))
        return self

    def predict_arrays(self, x):
        return self._value(self.machine_, x)


class NuSVR(SVR):
    params = {"nu": 0.5}

    def fit_arrays(self, x, y, w=None):
        self._setup(x)
        coef, b, self.fitted_epsilon_ = solve_nu_svr(self._rows(x), y, self.c, self.nu, self.tol, self.max_iter)
        self.machine_ = self._machine(x, coef, b)
        return self


class OneClassSVM(OutlierDetector, _Kernel):
    """1 inside, -1 outside."""

    params = {**_KERNEL, "nu": 0.5}

    def fit_arrays(self, x, y=None, w=None):
        self._setup(x)
        self.machine_ = self._machine(x, *solve_one_class(self._rows(x), len(x), self.nu, self.tol, self.max_iter))
        return self

    def decision_arrays(self, x):
        return self._value(self.machine_, x)

    def predict_arrays(self, x):
        return np.where(self.decision_arrays(x) >= 0, 1.0, -1.0)


def _pegasos(x, y, c, max_iter, tol, rng, grad):
    """Subgradient steps on |w|^2/2 + c sum of losses, the intercept as a scaled column; the average of the late steps."""
    n, p = x.shape
    centre = x.mean(axis=0)
    a = np.column_stack([x - centre, np.ones(n)])
    lam = 1 / (n * c)
    w, mean, count, t = np.zeros(p + 1), np.zeros(p + 1), 0, 0
    last = None
    for epoch in range(max_iter):
        for i in rng.permutation(n):
            t += 1
            eta = 1 / (lam * (t + 1 / lam / 10))
            w = w * (1 - eta * lam)
            g = grad(float(a[i] @ w), y[i])
            if g:
                w = w - eta * g * a[i]
            if epoch >= 5:
                count += 1
                mean += (w - mean) / count
        if epoch >= 10 and epoch % 5 == 0:
            if last is not None and np.abs(mean - last).max() < tol * max(1.0, np.abs(mean).max()):
                break
            last = mean.copy()
    w = mean if count else w
    return w[:p], float(w[p] - centre @ w[:p])


class LinearSVC(Classifier, ArrayEstimator):
    params = {"c": 1.0, "max_iter": 200, "tol": 1e-3, "random_state": 0}

    def fit_arrays(self, x, y, w=None):
        rng = np.random.default_rng(self.random_state)
        self.classes_ = np.unique(y)
        shown = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        got = [_pegasos(x, np.where(y == v, 1.0, -1.0), self.c, self.max_iter, self.tol, rng, lambda z, t: -t if z * t < 1 else 0.0) for v in shown]
        self.coef_, self.intercept_ = np.array([a for a, _ in got]), np.array([b for _, b in got])
        return self

    def decision_arrays(self, x):
        z = x @ self.coef_.T + self.intercept_
        return z[:, 0] if z.shape[1] == 1 else z

    def predict_arrays(self, x):
        z = self.decision_arrays(x)
        return self.classes_[(z > 0).astype(int)] if z.ndim == 1 else self.classes_[z.argmax(axis=1)]


class LinearSVR(Regressor, ArrayEstimator):
    params = {"c": 1.0, "epsilon": 0.0, "max_iter": 200, "tol": 1e-3, "random_state": 0}

    def fit_arrays(self, x, y, w=None):
        eps, m = self.epsilon, y.mean()
        self.coef_, b = _pegasos(x, y - m, self.c, self.max_iter, self.tol, np.random.default_rng(self.random_state), lambda z, t: np.sign(z - t) if abs(z - t) > eps else 0.0)
        self.intercept_ = b + m
        return self

    def predict_arrays(self, x):
        return x @ self.coef_ + self.intercept_


class KernelRidge(Regressor, ArrayEstimator):
    """Small tables by elimination; larger ones by conjugate gradients, whose products make the kernel by blocks."""

    params = {"alpha": 1.0, "kernel": "linear", "gamma": None, "degree": 3, "coef0": 1.0, "max_rows": MAX_ROWS}
    DENSE_ROWS = 5000

    def _k(self, a, b):
        return kernel(a, b, self.kernel, self.gamma if self.gamma is not None else 1 / a.shape[1], self.degree, self.coef0)

    def fit_arrays(self, x, y, w=None):
        self.x_ = x
        if len(x) > self.DENSE_ROWS:
            if self.kernel not in ("linear", "rbf", "poly", "cosine") or self.alpha <= 0:
                raise ValueError(f"more than {self.DENSE_ROWS} rows need a positive kernel and a positive alpha")
            self.dual_ = solve_positive(lambda v: by_blocks(lambda r: self._k(r, x) @ v, x, width=len(x)) + self.alpha * v, y)
            return self
        k = self._k(x, x) + self.alpha * np.eye(len(x))
        try:
            self.dual_ = np.linalg.solve(k, y)
        except np.linalg.LinAlgError:
            self.dual_ = np.linalg.pinv(k) @ y
        return self

    def predict_arrays(self, x):
        return by_blocks(lambda r: self._k(r, self.x_) @ self.dual_, x, width=len(self.x_))
