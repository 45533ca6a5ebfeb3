"""Tasks that run at once and hold blocks of rows between rounds, for methods that need all pairs in every round.

They start as one barrier stage and then exchange arrays by sockets of their own, in a star around the
first task: the barrier's own exchange takes a second each time.
"""

from __future__ import annotations

import pickle
import secrets
from collections.abc import Callable
from multiprocessing.connection import Client, Listener
from typing import Any

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

from quarry.functions.distances import top_eigen
from quarry.plans.shipping import ship

#: What a task may hold between rounds; where the tasks that run at once can't hold all pairs, the table is refused.
TASK_BYTES = 700_000_000


class Team:
    """One of `size` tasks; links has the others on task 0, and task 0 on the others."""

    def __init__(self, rank: int = 0, size: int = 1, links: list | None = None) -> None:
        self.rank, self.size, self.links = rank, size, links or []

    def rows(self, n: int) -> np.ndarray:
        """The numbers of this task's rows."""
        return np.arange(n * self.rank // self.size, n * (self.rank + 1) // self.size)

    def share(self, value: Any) -> list:
        """The values of all tasks, in their order."""
        if self.rank:
            self.links[0].send(value)
            return self.links[0].recv()
        got = [value, *[c.recv() for c in self.links]]
        data = pickle.dumps(got)
        for c in self.links:
            c.send_bytes(data)
        return got

    def first(self, value: Any) -> list | None:
        """The values of all tasks on task 0, None on the others."""
        if self.rank:
            return self.links[0].send(value)
        return [value, *[c.recv() for c in self.links]]

    def total(self, a: np.ndarray) -> np.ndarray:
        return sum(self.share(a))

    def joined(self, a: np.ndarray) -> np.ndarray:
        return np.concatenate(self.share(a))

    def top_eigen(self, product: Callable[[np.ndarray], np.ndarray], n: int, k: int, tol: float = 1e-10):
        """The k largest eigenvalues and vectors, on task 0 (None on the others); product gives this task's rows of matrix times m."""

        def times(m):
            self.share(m)
            return self.joined(product(m))

        if self.rank == 0:
            out = top_eigen(times, n, k, tol)
            self.share(None)
            return out
        while (m := self.share(None)[0]) is not None:
            self.share(product(m))
        return None


def cholesky_solver(team: Team, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, height: int = 256) -> Callable[[np.ndarray], np.ndarray]:
    """Solutions with the positive definite matrix of sums of (i, j, v), which all tasks ask for at once.

    Its lower half is dealt in panels of rows; a task factors its diagonal blocks and mends its own panels.
    """
    ends = [*range(height, n, height), n]
    begin = lambda k: k * height
    mine = range(team.rank, len(ends), team.size)
    panel, inverse = {}, []
    for k in mine:
        panel[k] = np.zeros((ends[k] - begin(k), ends[k]))
        at = (i >= begin(k)) & (i < ends[k]) & (j < ends[k])
        np.add.at(panel[k], (i[at] - begin(k), j[at]), v[at])
    for k in range(len(ends)):
        c = slice(begin(k), ends[k])
        inverse.append(team.share(np.linalg.inv(np.linalg.cholesky(panel[k][:, c])) if k in panel else None)[k % team.size])
        for r in mine:
            if r > k:
                panel[r][:, c] = panel[r][:, c] @ inverse[k].T
        column = sorted((x for part in team.share([(r, panel[r][:, c]) for r in mine if r > k]) for x in part), key=lambda x: x[0])
        if column:
            column = np.concatenate([x for _, x in column])
            for r in mine:
                if r > k:
                    panel[r][:, ends[k] :] -= panel[r][:, c] @ column[: ends[r] - ends[k]].T

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k in range(len(ends)):
            c = slice(begin(k), ends[k])
            y[c] = team.share(inverse[k] @ (b[c] - panel[k][:, : begin(k)] @ y[: begin(k)]) if k in panel else None)[k % team.size]
        taken = np.zeros_like(y)
        for k in reversed(range(len(ends))):
            c = slice(begin(k), ends[k])
            y[c] = inverse[k].T @ (y[c] - team.total(taken[c]))
            if k in panel:
                taken[: begin(k)] += panel[k][:, : begin(k)].T @ y[c]
        return y

    return solve


def together(fn: Callable, *arrays: np.ndarray, pair_bytes: int) -> Any:
    """What fn(team, *arrays) returns on the first task; each task holds pair_bytes for each pair of its rows with all rows.

    Without a session (in a task, or for arrays alone) this process is the only task.
    """
    spark, n = SparkSession.getActiveSession(), len(arrays[0])
    size = 1
    if spark is not None:
        jsc = spark.sparkContext._jsc.sc()
        size = max(1, min(n, jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile())))
    if pair_bytes * n * -(-n // size) > TASK_BYTES:
        raise ValueError(f"{n} rows need at least {-(-pair_bytes * n * n // TASK_BYTES)} tasks that run at once, for they hold all pairs; {size} can")
    if spark is None:
        return fn(Team(), *arrays)
    ship(spark)
    sent, key = spark.sparkContext.broadcast(arrays), secrets.token_bytes(32)

    def task(_):
        context = BarrierTaskContext.get()
        rank, host = context.partitionId(), context.getTaskInfos()[0].address.rpartition(":")[0]
        if rank == 0:
            with Listener(("", 0), backlog=size, authkey=key) as door:
                context.allGather(str(door.address[1]))
                came = [door.accept() for _ in range(size - 1)]
            links = [c for _, c in sorted([(c.recv(), c) for c in came], key=lambda x: x[0])]
        else:
            links = [Client((host, int(context.allGather("")[0])), authkey=key)]
            links[0].send(rank)
        try:
            out = fn(Team(rank, size, links), *sent.value)
        finally:
            for c in links:
                c.close()
        if rank == 0:
            yield pickle.dumps(out)

    try:
        return pickle.loads(spark.sparkContext.parallelize(range(size), size).barrier().mapPartitions(task).collect()[0])
    finally:
        sent.unpersist()
