"""Clustering.  k-means and mixtures are iterated aggregates; graph and linkage methods take bounded tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.distances import by_blocks, closest, kth_distances, links, nearest_rows, pairwise, product_squares, top_eigen
from quarry.operators.base import MAX_ROWS, ArrayEstimator, BaseEstimator, Clusterer, gather
from quarry.plans.aggregate import partial_sums
from quarry.plans.together import together


def kmeans_plus_plus(x: np.ndarray, k: int, rng, w: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(x)) if w is None else w
    centres = [x[rng.choice(len(x), p=w / w.sum())]]
    d = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = d * w
        centres.append(x[rng.choice(len(x), p=p / p.sum() if p.sum() > 0 else w / w.sum())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def lloyd(step, centres: np.ndarray, max_iter: int, tol: float, far) -> tuple[np.ndarray, float, int]:
    """step(centres) gives counts, sums and inertia; far() a row for an empty cluster.  Stops on relative change of inertia."""
    last = None
    for it in range(1, max_iter + 1):
        n, s, inertia = step(centres)
        for j in np.flatnonzero(n == 0):
            s[j], n[j] = far(centres), 1
        centres = s / n[:, None]
        if last is not None and abs(last - inertia) <= tol * max(last, 1e-300):
            break
        last = inertia
    return centres, step(centres)[2], it


class KMeans(Clusterer, BaseEstimator):
    """Lloyd's steps, each one pass of partial sums; starts by k-means++ on a bounded sample unless given."""

    params = {"n_clusters": 2, "tol": 1e-4, "init_centers": None, "max_iter": 30, "random_state": 0, "n_init": 10, "sample": 10_000}

    def fit(self, df: DataFrame, features: list[str], label=None, weight: str | None = None):
        self.features_ = list(features)
        p = len(features)
        cols = [*features, *([weight] if weight else [])]
        data = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()

        def step(c):
            def f(m):
                x, w = m[:, :p], (m[:, p] if weight else np.ones(len(m)))
                d = pairwise(x, c)
                at = d.argmin(axis=1)
                hot = (at[:, None] == np.arange(len(c))) * w[:, None]
                return np.concatenate([hot.sum(axis=0), (hot.T @ x).ravel(), [(w * d.min(axis=1) ** 2).sum()]])

            out = partial_sums(data, cols, f)
            k = len(c)
            return out[:k], out[k:-1].reshape(k, p), out[-1]

        def far(c):
            d = F.array_min(F.array(*[sum(((F.col(f) - float(v)) ** 2 for f, v in zip(features, row, strict=True)), F.lit(0.0)) for row in c]))
            r = data.orderBy(F.desc(d), *features).select(*features).first()
            return np.array(list(r), float)

        best = None
        if self.init_centers is not None:
            starts = [np.array(self.init_centers, float)]
        else:
            x = gather(data.orderBy(F.xxhash64(*features)).limit(self.sample), features)
            rng = np.random.default_rng(self.random_state)
            starts = [kmeans_plus_plus(x, self.n_clusters, rng) for _ in range(self.n_init)]
            if self.n_init > 1:  # choose among starts on the sample, then go on over all rows
                inertia = [lloyd(self._local(x), s, self.max_iter, self.tol, lambda c: x[pairwise(x, c).min(axis=1).argmax()]) for s in starts]
                starts = [min(inertia, key=lambda t: t[1])[0]]
        for s in starts:
            got = lloyd(step, s, self.max_iter, self.tol, far)
            best = got if best is None or got[1] < best[1] else best
        data.unpersist()
        self.cluster_centers_, self.inertia_, self.n_iter_ = best[0], float(best[1]), best[2]
        return self

    @staticmethod
    def _local(x):
        def step(c):
            d = pairwise(x, c)
            hot = d.argmin(axis=1)[:, None] == np.arange(len(c))
            return hot.sum(axis=0).astype(float), hot.T.astype(float) @ x, float((d.min(axis=1) ** 2).sum())

        return step

    def fit_arrays(self, x, y=None, w=None):
        rng = np.random.default_rng(self.random_state)
        starts = [np.array(self.init_centers, float)] if self.init_centers is not None else [kmeans_plus_plus(x, self.n_clusters, rng, w) for _ in range(self.n_init)]
        got = min((lloyd(self._local(x), s, self.max_iter, self.tol, lambda c: x[pairwise(x, c).min(axis=1).argmax()]) for s in starts), key=lambda t: t[1])
        self.cluster_centers_, self.inertia_, self.n_iter_ = got
        self.labels_ = self.predict_arrays(x)
        return self

    def predict_arrays(self, x):
        return pairwise(x, self.cluster_centers_).argmin(axis=1).astype(float)


class MiniBatchKMeans(KMeans):
    """Centres move towards the means of random batches, by their share of the counts; empty ones are dealt anew.

    ``fit`` draws its batch_size * max_iter rows by their hash from the whole table: sampling is the method.
    ``partial_fit`` takes every row of a table in one pass of sums, and so each batch of a stream.
    """

    params = {"n_clusters": 8, "max_iter": 100, "batch_size": 1024, "max_no_improvement": 10, "n_init": 3, "reassignment_ratio": 0.01}

    def fit(self, df, features, label=None, weight=None):
        self.features_ = list(features)
        x = gather(df.orderBy(F.xxhash64(*features)).limit(self.batch_size * self.max_iter), features)
        self.fit_arrays(x)
        del self.labels_
        return self

    def fit_arrays(self, x, y=None, w=None):
        rng = np.random.default_rng(self.random_state)
        starts = [kmeans_plus_plus(x[rng.permutation(len(x))[: 3 * self.batch_size]], self.n_clusters, rng) for _ in range(self.n_init)]
        c = min(starts, key=lambda s: (pairwise(x, s).min(axis=1) ** 2).sum())
        self.counts_ = np.zeros(self.n_clusters)
        best, idle, smooth = np.inf, 0, None
        for _ in range(self.max_iter):
            b = x[rng.integers(0, len(x), min(self.batch_size, len(x)))]
            c, inertia = self.partial_arrays(b, c, rng)
            smooth = inertia if smooth is None else 0.9 * smooth + 0.1 * inertia
            idle = 0 if smooth < best else idle + 1
            best = min(best, smooth)
            if self.max_no_improvement and idle >= self.max_no_improvement:
                break
        self.cluster_centers_ = c
        self.inertia_ = float((pairwise(x, c).min(axis=1) ** 2).sum())
        self.labels_ = self.predict_arrays(x)
        return self

    def partial_fit(self, df, features):
        """Moves the centres by all rows of df at once: one pass of sums; the first call also chooses the centres."""
        self.features_ = list(features)
        if not hasattr(self, "cluster_centers_"):
            x = gather(df.orderBy(F.xxhash64(*features)).limit(self.sample), features)
            self.cluster_centers_ = kmeans_plus_plus(x, self.n_clusters, np.random.default_rng(self.random_state))
            self.counts_ = np.zeros(len(self.cluster_centers_))
        c = self.cluster_centers_

        def kernel(rows):
            hot = (pairwise(rows, c).argmin(axis=1)[:, None] == np.arange(len(c))).astype(float)
            return np.concatenate([hot.sum(axis=0), (hot.T @ rows).ravel()])

        s = partial_sums(df, list(features), kernel)
        if len(s):
            n, total = s[: len(c)], s[len(c) :].reshape(c.shape)
            self.counts_ = self.counts_ + n
            got = n > 0
            self.cluster_centers_ = np.where(got[:, None], c + (total - n[:, None] * c) / np.where(got, self.counts_, 1)[:, None], c)
        return self

    def partial_arrays(self, b, c, rng):
        d = pairwise(b, c)
        at = d.argmin(axis=1)
        for j in np.unique(at):
            mine = b[at == j]
            self.counts_[j] += len(mine)
            c[j] = c[j] + (mine.sum(axis=0) - len(mine) * c[j]) / self.counts_[j]
        low = self.counts_ < self.reassignment_ratio * self.counts_.max()
        if low.any():
            c[low] = b[rng.choice(len(b), int(low.sum()))]
            self.counts_[low] = self.counts_[~low].min() if (~low).any() else 1
        return c, float((d.min(axis=1) ** 2).mean())


class BisectingKMeans(Clusterer, ArrayEstimator):
    params = {"n_clusters": 8, "max_iter": 300, "tol": 1e-4, "n_init": 1, "random_state": 0, "bisecting_strategy": "biggestInertia"}

    def fit_arrays(self, x, y=None, w=None):
        parts, self.splits_ = {0: np.arange(len(x))}, []
        sse = {0: ((x - x.mean(axis=0)) ** 2).sum()}
        while len(parts) < self.n_clusters:
            can = [k for k, v in parts.items() if len(v) > 1 and sse[k] > 0]
            if not can:
                break
            k = max(can, key=lambda k: (sse[k] if self.bisecting_strategy == "biggestInertia" else len(parts[k]), -k))
            who = parts.pop(k)
            two = KMeans(n_clusters=2, max_iter=self.max_iter, tol=self.tol, n_init=self.n_init, random_state=self.random_state).fit_arrays(x[who])
            new = max([k, *parts, *[b for _, b, _ in self.splits_]], default=0) + 1
            self.splits_.append((k, new, two.cluster_centers_))
            for name, side in ((k, 0), (new, 1)):
                parts[name] = who[two.labels_ == side]
                sse[name] = ((x[parts[name]] - two.cluster_centers_[side]) ** 2).sum()
        self.order_ = {k: i for i, k in enumerate(sorted(parts))}
        self.cluster_centers_ = np.array([x[parts[k]].mean(axis=0) for k in sorted(parts)])
        self.labels_ = self.predict_arrays(x)
        return self

    def predict_arrays(self, x):
        at = np.zeros(len(x), int)
        for k, new, c in self.splits_:
            who = at == k
            at[who] = np.where(pairwise(x[who], c).argmin(axis=1) == 0, k, new)
        return np.array([self.order_[k] for k in at], float)


class DBScan(BaseEstimator):
    """Core rows have min_samples rows within eps, themselves counted; noise is -1.

    Pairs within eps come from the blocks of the neighbour search; clusters are the
    components of core rows, numbered by their first row; a border row goes to
    the cluster of the smallest number that reaches it.
    """

    params = {"eps": 0.5, "min_samples": 5, "metric": "euclidean", "p": 2}
    kind = "clusterer"

    def fit_predict(self, df: DataFrame, features: list[str], row: str = "row_id", output: str = "cluster") -> DataFrame:
        from quarry.operators.neighbors import neighbour_pairs
        from quarry.plans.iterate import least_labels

        pairs = neighbour_pairs(df, df, features, row, radius=self.eps, metric=self.metric, p=self.p).persist()
        core = pairs.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= self.min_samples).select("query").persist()
        edges = pairs.join(core, "query").join(core.withColumnRenamed("query", "neighbour"), "neighbour").select(F.col("query").alias("a"), F.col("neighbour").alias("b"))
        roots = least_labels(edges).withColumnRenamed("node", "query")
        number = roots.select("root").distinct()
        from quarry.operators.model_selection import numbered

        number = numbered(number, ["root"], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
        cored = roots.join(number, "root").select("query", "cluster")
        reach = pairs.join(cored.select(F.col("query").alias("neighbour"), "cluster"), "neighbour").groupBy("query").agg(F.min("cluster").alias("c"))
        label = reach.join(cored, "query", "left").select(F.col("query").alias(row), F.coalesce("cluster", "c").alias(output))
        return df.join(label, row, "left").withColumn(output, F.coalesce(F.col(output), F.lit(-1)))

    def fit_predict_arrays(self, x):
        d = pairwise(x, x, self.metric, self.p)
        near = d <= self.eps
        core = near.sum(axis=1) >= self.min_samples
        out, c = np.full(len(x), -1), 0
        for i in range(len(x)):
            if out[i] >= 0 or not core[i]:
                continue
            todo = [i]
            out[i] = c
            while todo:
                k = todo.pop()
                if core[k]:
                    more = np.flatnonzero(near[k] & (out < 0))
                    out[more] = c
                    todo += more.tolist()
            c += 1
        return out


DBSCAN = DBScan


class MeanShift(Clusterer, ArrayEstimator):
    """Flat kernel; modes closer than half the bandwidth merge in row order."""

    params = {"bandwidth": 1.0, "max_iter": 300, "metric": "euclidean", "max_rows": MAX_ROWS}

    def _inside(self, c, x):
        """Whether rows of x lie within the bandwidth of c; by products, and by differences where these are near the border."""
        if self.metric != "euclidean":
            return pairwise(c, x, self.metric) <= self.bandwidth
        q, r = product_squares(c, x), self.bandwidth**2
        inside = q <= r
        i, j = np.nonzero(np.abs(q - r) <= 1e-9 * r)
        inside[i, j] = np.sqrt(((c[i] - x[j]) ** 2).sum(axis=1)) <= self.bandwidth
        return inside

    def fit_arrays(self, x, y=None, w=None):
        c = x.astype(float).copy()
        live = np.ones(len(x), bool)
        for _ in range(self.max_iter):
            who = np.flatnonzero(live)
            if not len(who):
                break
            for s in range(0, len(who), 256):
                at = who[s : s + 256]
                inside = self._inside(c[at], x)
                new = inside.astype(float) @ x / np.maximum(inside.sum(axis=1, keepdims=True), 1)
                live[at] = np.abs(new - c[at]).max(axis=1) > 1e-3 * self.bandwidth
                c[at] = new
        modes, k = np.empty_like(c), 0
        self.labels_ = np.empty(len(x))
        for i, m in enumerate(c):
            d = pairwise(m[None], modes[:k], self.metric)[0] if k else np.array([np.inf])
            if d.min() <= self.bandwidth / 2:
                self.labels_[i] = d.argmin()
            else:
                modes[k] = m
                self.labels_[i] = k
                k += 1
        self.cluster_centers_ = modes[:k].copy()
        return self

    def predict_arrays(self, x):
        return closest(x, self.cluster_centers_, self.metric).astype(float)


class AffinityPropagation(Clusterer, ArrayEstimator):
    """Exemplars by message passing; ``converged_`` tells whether the messages settled.

    Where they still swing after max_iter rounds, damping is raised half-way to 1
    and as many rounds follow, SETTLE times at most.  Each cluster's exemplar is then the
    member that is most similar to all of it.  Without exemplars every label is -1.
    Tables above DENSE_ROWS are dealt by rows to tasks that run at once (``plans.together``); the
    noise that breaks ties is then drawn row by row.
    """

    SETTLE, DENSE_ROWS = 4, 2000
    params = {"damping": 0.5, "max_iter": 200, "convergence_iter": 15, "preference": None, "max_rows": MAX_ROWS, "random_state": 0}

    def _messages(self, s: np.ndarray) -> np.ndarray:
        """The rows that are exemplars after the last round."""
        n = len(s)
        rows, self.converged_ = np.arange(n), False
        sent, free = np.zeros((n, n)), np.zeros((n, n))  # responsibilities and availabilities
        damping, steady, last = self.damping, 0, np.zeros(n, bool)
        for turn in range(self.max_iter * (1 + self.SETTLE)):
            if turn and turn % self.max_iter == 0:
                damping = (1 + damping) / 2
            rival = free + s
            best = rival.argmax(axis=1)
            most = rival[rows, best]
            rival[rows, best] = -np.inf
            target = s - most[:, None]
            target[rows, best] = s[rows, best] - rival.max(axis=1)
            sent += (1 - damping) * (target - sent)
            support = np.maximum(sent, 0)
            support[rows, rows] = sent[rows, rows]
            target = support.sum(axis=0) - support
            own = target[rows, rows]
            target = np.minimum(target, 0)
            target[rows, rows] = own
            free += (1 - damping) * (target - free)
            now = free[rows, rows] + sent[rows, rows] > 0
            steady = steady + 1 if turn and (now == last).all() else 0
            last = now
            if steady >= self.convergence_iter and now.any():
                self.converged_ = True
                break
        return np.flatnonzero(last)

    def _in_tasks(self, team, x: np.ndarray):
        """Labels, exemplars and whether the messages settled: the same steps on blocks of rows, joined by sums of columns."""
        n, mine = len(x), team.rows(len(x))
        s = np.concatenate([-(pairwise(x[b], x) ** 2) for b in np.array_split(mine, -(-len(mine) // 32) or 1)])
        rows = np.arange(len(mine))
        preference = self.preference
        if preference is None:
            s[rows, mine] = -np.inf
            bits, middle = (0 - s).view(np.int64), []  # squares are in the order of their bits
            for rank in (n * (n - 1) // 2, n * (n - 1) // 2 + 1):
                low, high = 0, np.array(np.inf).view(np.int64).item()
                while low < high:
                    half = (low + high) // 2
                    low, high = (low, half) if team.total(np.count_nonzero(bits <= half)) >= rank else (half + 1, high)
                middle.append(-np.array(low).view(np.float64).item())
            del bits
            preference = sum(middle) / 2
        s[rows, mine] = preference
        noise = 1e-12 * max(team.share(np.abs(s).max(initial=0)))
        for r, i in enumerate(mine):
            s[r] += noise * np.random.default_rng([self.random_state or 0, int(i)]).standard_normal(n)
        sent, free = np.zeros_like(s), np.zeros_like(s)
        blocks = [slice(a, min(a + 32, len(mine))) for a in range(0, len(mine), 32)]
        damping, steady, last, converged = self.damping, 0, np.zeros(n, bool), False
        for turn in range(self.max_iter * (1 + self.SETTLE)):
            if turn and turn % self.max_iter == 0:
                damping = (1 + damping) / 2
            columns = np.zeros(n)
            for b in blocks:
                at = np.arange(b.stop - b.start)
                rival = free[b] + s[b]
                best = rival.argmax(axis=1)
                most = rival[at, best]
                rival[at, best] = -np.inf
                target = np.subtract(s[b], most[:, None])
                target[at, best] = s[b][at, best] - rival.max(axis=1)
                target -= sent[b]
                target *= 1 - damping
                sent[b] += target
                support = np.maximum(sent[b], 0, out=target)
                support[at, mine[b]] = sent[b][at, mine[b]]
                columns += support.sum(axis=0)
            columns = team.total(columns)
            for b in blocks:
                at = np.arange(b.stop - b.start)
                target = np.maximum(sent[b], 0)
                target[at, mine[b]] = sent[b][at, mine[b]]
                np.subtract(columns, target, out=target)
                own = target[at, mine[b]]
                np.minimum(target, 0, out=target)
                target[at, mine[b]] = own
                target -= free[b]
                target *= 1 - damping
                free[b] += target
            now = team.joined(free[rows, mine] + sent[rows, mine] > 0)
            steady = steady + 1 if turn and (now == last).all() else 0
            last = now
            if steady >= self.convergence_iter and now.any():
                converged = True
                break
        del sent, free
        who = np.flatnonzero(last)
        if not len(who):
            return np.full(n, -1.0), who, converged

        def nearest():
            near = team.joined(s[:, who].argmax(axis=1))
            near[who] = np.arange(len(who))
            return near

        near, like = nearest(), np.zeros(n)
        members = [np.flatnonzero(near == k) for k in range(len(who))]
        for m in members:
            like[m] = s[np.ix_(rows[np.isin(mine, m)], m)].sum(axis=0)
        like = team.total(like)
        who = np.unique([m[like[m].argmax()] for m in members])
        return nearest().astype(float), who, converged

    def fit_arrays(self, x, y=None, w=None):
        n = len(x)
        if n > self.DENSE_ROWS:
            self.labels_, self.exemplars_, self.converged_ = together(self._in_tasks, x, pair_bytes=24)
            self.cluster_centers_ = x[self.exemplars_]
            return self
        s = -(pairwise(x, x) ** 2)
        np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if self.preference is None else self.preference)
        s = s + 1e-12 * np.abs(s).max() * np.random.default_rng(self.random_state).standard_normal((n, n))
        who = self._messages(s)
        if len(who):
            near = s[:, who].argmax(axis=1)
            near[who] = np.arange(len(who))
            members = [np.flatnonzero(near == k) for k in range(len(who))]
            who = np.unique([m[s[np.ix_(m, m)].sum(axis=0).argmax()] for m in members])
            near = s[:, who].argmax(axis=1)
            near[who] = np.arange(len(who))
            self.labels_ = near.astype(float)
        else:
            self.labels_ = np.full(n, -1.0)
        self.exemplars_, self.cluster_centers_ = who, x[who]
        return self

    def predict_arrays(self, x):
        if not len(self.cluster_centers_):
            return np.full(len(x), -1.0)
        return closest(x, self.cluster_centers_).astype(float)


def _first_seen(labels: np.ndarray) -> np.ndarray:
    _, first, inv = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inv].astype(float)


def _named(pairs: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, int]]:
    """Merges by height from (row of one side, row of the other, height)."""
    up, name, size, out = np.arange(n), np.arange(n), np.ones(n, int), []

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, (a, b, h) in enumerate(sorted(pairs, key=lambda t: t[2])):
        a, b = top(a), top(b)
        if size[a] < size[b]:
            a, b = b, a
        out.append((int(min(name[a], name[b])), int(max(name[a], name[b])), float(h), int(size[a] + size[b])))
        up[b], name[a], size[a] = a, n + k, size[a] + size[b]
    return out


def _ward_chain(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges by chains of nearest neighbours, from centres and sizes alone: memory for the rows, not for their pairs."""
    if not np.isfinite(x).all():
        raise ValueError("linkage needs finite rows")
    total, size, row = x.astype(float).copy(), np.ones(len(x)), np.arange(len(x))
    centre, live = total.copy(), np.ones(len(x), bool)
    left, chain, out = len(x), [], []
    while left > 1:
        if left < len(size) / 2:  # drop what has been merged
            place = np.cumsum(live) - 1
            chain = [int(place[i]) for i in chain]
            total, size, row, centre = total[live], size[live], row[live], centre[live]
            live = np.ones(left, bool)
        if not chain:
            chain = [int(live.argmax())]
        while True:
            i = chain[-1]
            d = centre - centre[i]
            q = np.einsum("nd,nd->n", d, d) * (size * size[i] / (size + size[i]))
            q[~live] = np.inf
            q[i] = np.inf
            j = int(q.argmin())
            if len(chain) > 1 and q[chain[-2]] <= q[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        out.append((int(row[i]), int(row[j]), float(np.sqrt(2 * q[j]))))
        total[i] += total[j]
        size[i] += size[j]
        centre[i] = total[i] / size[i]
        live[j] = False
        left -= 1
    return out


def _spanning_tree(n: int, distances) -> list[tuple[int, int, float]]:
    """Edges (from, to, length) of Prim's tree in the order of their finding; distances(i) gives those of one row."""
    far, src, inside, at, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0, []
    inside[:1] = True
    for _ in range(n - 1):
        m = distances(at)
        better = ~inside & (m < far)
        far[better], src[better] = m[better], at
        at = int(np.where(inside, np.inf, far).argmin())
        out.append((int(src[at]), at, float(far[at])))
        inside[at] = True
    return out


#: Most rows whose distances are held as one matrix.
DENSE_ROWS = 10_000


def linkage(x: np.ndarray, method: str, metric: str = "euclidean") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) of the nearest pair each time; ids from n on are merged clusters.

    Ward's linkage goes by chains of centres, single linkage by a spanning tree; others, by Lance and Williams, hold all distances.
    """
    n = len(x)
    if method == "ward" and metric == "euclidean":
        return _named(_ward_chain(x), n)
    if method == "single":
        return _named(_spanning_tree(n, lambda i: pairwise(x[i : i + 1], x, metric)[0]), n)
    if n > DENSE_ROWS:
        raise ValueError(f"{method} linkage holds all distances and takes at most {DENSE_ROWS} rows")
    d = pairwise(x, x, metric)
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), np.arange(n), []
    live = np.ones(n, bool)
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    for k in range(n - 1):
        i = int(np.where(live, best, np.inf).argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        h, a, b = d[i, j], size[i], size[j]
        if method == "ward":
            new = np.sqrt(np.maximum(((a + size) * d[i] ** 2 + (b + size) * d[j] ** 2 - size * h * h) / (a + b + size), 0))
        else:
            new = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (a * d[i] + b * d[j]) / (a + b)}[method]
        new[~live] = np.inf
        new[[i, j]] = np.inf
        out.append((int(min(name[i], name[j])), int(max(name[i], name[j])), float(h), int(a + b)))
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        live[j], best[j] = False, np.inf
        size[i], name[i] = a + b, n + k
        stale = np.flatnonzero(live & ((near == i) | (near == j) | (new < best)))
        stale = np.append(stale, i)
        near[stale] = d[stale].argmin(axis=1)
        best[stale] = d[stale, near[stale]]
    return out


def cut(merges: list[tuple], n: int, keep: int) -> np.ndarray:
    """Labels after the first n - keep merges, by first appearance."""
    lab = np.arange(2 * n)
    for k in reversed(range(max(0, n - keep))):
        lab[list(merges[k][:2])] = lab[n + k]
    return _first_seen(lab[:n])


class AgglomerativeClustering(Clusterer, ArrayEstimator):
    params = {"n_clusters": 2, "linkage": "ward", "metric": "euclidean", "distance_threshold": None, "max_rows": MAX_ROWS}

    def fit_arrays(self, x, y=None, w=None):
        m = linkage(x, self.linkage, self.metric)
        self.children_, self.distances_ = [(a, b) for a, b, _, _ in m], [h for _, _, h, _ in m]
        keep = self.n_clusters if self.distance_threshold is None else len(x) - sum(h < self.distance_threshold for h in self.distances_)
        self.labels_ = cut(m, len(x), keep)
        return self


class Birch(Clusterer, ArrayEstimator):
    """Subclusters of bounded radius, then ward linkage of their centres; ``partial_arrays`` adds rows."""

    params = {"threshold": 0.5, "branching_factor": 50, "n_clusters": 3}

    def partial_arrays(self, x):
        held = getattr(self, "cf_", (np.zeros((0, x.shape[1])), np.zeros(0), np.zeros(0)))
        m = len(held[2])
        sums, squares, counts = (np.concatenate([h, np.zeros((len(x), *h.shape[1:]))]) for h in held)
        centres = np.concatenate([held[0] / held[2][:, None], np.zeros((len(x), x.shape[1]))])
        for r in x:
            if m:
                d = centres[:m] - r
                j = int((d * d).sum(axis=1).argmin())
                s, q, k = sums[j] + r, squares[j] + r @ r, counts[j] + 1
                if max(q / k - (s / k) @ (s / k), 0) <= self.threshold**2:
                    sums[j], squares[j], counts[j], centres[j] = s, q, k, s / k
                    continue
            sums[m], squares[m], counts[m], centres[m] = r, r @ r, 1, r
            m += 1
        sums, squares, counts = sums[:m].copy(), squares[:m].copy(), counts[:m].copy()
        self.cf_ = (sums, squares, counts)
        return self

    def fit_arrays(self, x, y=None, w=None):
        self.__dict__.pop("cf_", None)
        self.partial_arrays(x)
        return self._finish(x)

    def _finish(self, x=None):
        self.subclusters_ = self.cf_[0] / self.cf_[2][:, None]
        k = len(self.subclusters_)
        self.groups_ = np.arange(k, dtype=float) if self.n_clusters is None or k <= self.n_clusters else cut(linkage(self.subclusters_, "ward"), k, self.n_clusters)
        if x is not None:
            self.labels_ = self.predict_arrays(x)
        return self

    def predict_arrays(self, x):
        return self.groups_[closest(x, self.subclusters_)]


class SpectralClustering(Clusterer, ArrayEstimator):
    params = {"n_clusters": 8, "affinity": "rbf", "gamma": 1.0, "n_neighbors": 10, "random_state": 0, "n_init": 10, "max_rows": MAX_ROWS}

    def fit_arrays(self, x, y=None, w=None):
        n = len(x)
        if self.affinity == "rbf":
            times = lambda m: by_blocks(lambda r: np.exp(-self.gamma * product_squares(r, x)) @ m, x, width=n)
        else:
            near = nearest_rows(x, self.n_neighbors)
            times = links(np.repeat(np.arange(n), near.shape[1]), near.ravel(), n)
        deg = np.sqrt(np.maximum(times(np.ones((n, 1))), 1e-300))
        _, u = top_eigen(lambda m: times(m / deg) / deg, n, self.n_clusters)
        z = u[:, ::-1]
        z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        self.labels_ = KMeans(n_clusters=self.n_clusters, n_init=self.n_init, random_state=self.random_state, max_iter=300).fit_arrays(z).labels_
        return self


class OPTICS(Clusterer, ArrayEstimator):
    """Reachability ordering; clusters as by density at eps."""

    params = {"min_samples": 5, "max_eps": np.inf, "eps": 0.5, "metric": "euclidean", "p": 2, "max_rows": MAX_ROWS}

    def fit_arrays(self, x, y=None, w=None):
        core = kth_distances(x, self.min_samples, self.metric, self.p)
        core = np.where(core <= self.max_eps, core, np.inf)
        reach, done, order = np.full(len(x), np.inf), np.zeros(len(x), bool), []
        for _ in range(len(x)):
            i = int(np.where(done, np.inf, reach).argmin()) if np.isfinite(reach[~done]).any() else int(np.flatnonzero(~done)[0])
            done[i] = True
            order.append(i)
            if np.isfinite(core[i]):
                d = pairwise(x[i : i + 1], x, self.metric, self.p)[0]
                new = np.maximum(core[i], d)
                better = ~done & (new < reach) & (d <= self.max_eps)
                reach[better] = new[better]
        self.ordering_, self.reachability_, self.core_distances_ = np.array(order), reach, core
        self.labels_, c = np.full(len(x), -1.0), -1
        for i in order:
            if reach[i] > self.eps:
                if core[i] <= self.eps:
                    c += 1
                    self.labels_[i] = c
            else:
                self.labels_[i] = c
        return self


class HDBScan(Clusterer, ArrayEstimator):
    """Mutual-reachability tree, condensed by min_cluster_size, clusters by excess of mass."""

    params = {"min_cluster_size": 5, "min_samples": None, "cluster_selection_epsilon": 0.0, "metric": "euclidean", "allow_single_cluster": False, "max_rows": MAX_ROWS}

    def fit_arrays(self, x, y=None, w=None):
        n, k = len(x), self.min_samples or self.min_cluster_size
        core = kth_distances(x, k, self.metric)
        found = _spanning_tree(n, lambda i: np.maximum(pairwise(x[i : i + 1], x, self.metric)[0], np.maximum(core[i], core)))
        edges = [(h, a, b) for a, b, h in found]
        edges.sort(key=lambda e: e[0])
        parent, size, name = np.arange(n), {i: 1 for i in range(n)}, list(range(n))
        kids: dict[int, tuple] = {}

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for t, (h, a, b) in enumerate(edges):
            a, b = find(a), find(b)
            node = n + t
            kids[node] = (name[a], name[b], h)
            size[node] = size[name[a]] + size[name[b]]
            parent[b] = a
            name[a] = node

        def leaves(v):
            todo, out = [v], []
            while todo:
                v = todo.pop()
                if v < n:
                    out.append(v)
                else:
                    todo += kids[v][:2]
            return out

        root = n + len(edges) - 1 if edges else 0
        birth, members, tree, todo = {0: 0.0}, {0: []}, {0: []}, [(root, 0)]
        while todo:  # condensed tree: what falls out of a cluster at which density
            v, c = todo.pop()
            if v < n:
                members[c].append((v, np.inf))
                continue
            a, b, h = kids[v]
            lam = 1 / h if h > 0 else np.inf
            big = [u for u in (a, b) if size[u] >= self.min_cluster_size]
            if len(big) == 2:
                for u in (a, b):
                    new = len(birth)
                    birth[new], members[new], tree[new] = lam, [], []
                    tree[c].append(new)
                    todo.append((u, new))
                continue
            for u in (a, b):
                if u in big:
                    todo.append((u, c))
                else:
                    members[c] += [(q, lam) for q in leaves(u)]
        total = {c: len(members[c]) for c in birth}
        for c in sorted(birth, reverse=True):
            total[c] += sum(total[u] for u in tree[c])
        finite = [lam for ms in members.values() for _, lam in ms if np.isfinite(lam)] + [v for v in birth.values() if np.isfinite(v)]
        top = max(finite, default=1.0)
        mass = {c: sum(min(lam, top) - birth[c] for _, lam in members[c]) + sum((birth[u] - birth[c]) * total[u] for u in tree[c]) for c in birth}
        chosen, best = {}, {}
        for c in sorted(birth, reverse=True):
            below = sum(best[u] for u in tree[c])
            own = mass[c] >= below and bool(not tree[c] or mass[c] > 0)
            if c == 0 and not self.allow_single_cluster:
                own = False
            chosen[c], best[c] = own, max(mass[c], below) if c or self.allow_single_cluster else below
        picked, todo = [], [0]
        while todo:
            c = todo.pop()
            if chosen[c]:
                picked.append(c)
            else:
                todo += tree[c]
        up = {u: c for c in tree for u in tree[c]}
        if self.cluster_selection_epsilon > 0:
            lifted = set()
            for c in picked:
                while c in up and birth[c] > 0 and 1 / birth[c] < self.cluster_selection_epsilon and (up[c] != 0 or self.allow_single_cluster):
                    c = up[c]
                lifted.add(c)
            picked = [c for c in lifted if not any(self._above(o, c, up) for o in lifted if o != c)]
        self.labels_, self.probabilities_ = np.full(n, -1.0), np.zeros(n)
        for k, c in enumerate(sorted(picked)):
            rows, todo = [], [c]
            while todo:
                u = todo.pop()
                rows += members[u]
                todo += tree[u]
            if c == 0 and self.allow_single_cluster and len(picked) == 1:
                limit = max((lam for _, lam in rows if np.isfinite(lam)), default=np.inf) if not self.cluster_selection_epsilon else 1 / self.cluster_selection_epsilon
                rows = [r for r in rows if r[1] >= limit or not self.cluster_selection_epsilon]
            high = max((lam for _, lam in rows if np.isfinite(lam)), default=np.inf)
            for v, lam in rows:
                self.labels_[v] = k
                self.probabilities_[v] = 1.0 if not np.isfinite(lam) or not np.isfinite(high) or high == 0 else min(lam / high, 1.0)
        return self

    @staticmethod
    def _above(a, b, up):
        while b in up:
            b = up[b]
            if b == a:
                return True
        return False


HDBSCAN = HDBScan
