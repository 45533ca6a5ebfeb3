"""Operator 10: nearest neighbours by randomly rotated one-bit codes.

Vectors are compared as unit vectors.  The table is cut into cells around
centres fitted on a bounded sample (one cell for each CELL_ROWS rows, MOST_CELLS
at most; a table of one cell has its centre at 0).  A vector o of the cell around
c is coded by its residual r = (o - c) / |o - c|, rotated into D dimensions
(x = R r, R a random isometry fixed by d, D = 512 at least): the signs of x,
packed to D bits, and three scalars: a = <x, s> / sqrt(D), the cosine between x and its
sign vector, rho = |o - c| and <c, o>.

A query q is rotated likewise (y = R (q - c) / |q - c|) and rounded to QUERY_BITS bits a
component, kept as bit planes, so <y, s> is a weighted sum of the population counts of
``code AND plane``.  <y, s> / (a sqrt(D)) is an unbiased estimate of <y, r>, and
misses it by more than

    EPSILON * (sqrt((1 - a^2) / a^2) * sqrt((1 - <y, s>^2 / D) / (D - 1)) + |e| / (a sqrt(D)))

(e: what rounding changed) with a chance below 2 exp(-EPSILON^2 / 2).  With <q, o> =
|q - c| rho <y, r> + <q, c> + <c, o> - <c, c> that bounds the cosine.  In a block, the
vectors of the largest estimates are measured exactly; the k-th best of these is a
floor, and every other vector whose upper bound reaches it is measured too.

A query visits the cells nearest to it.  How many, is measured: SAMPLE_QUERIES
vectors are searched exactly among all rows, and as many cells are visited as
hold TARGET_RECALL of what was found.  So data in clusters need few cells, data without
any structure most of them.

Work is dealt by (cell, block of the cell, block of queries), so a task holds one block of
each, whatever the table's size; blocks are dealt by hashed ids, so no id,
label or repeated vector gathers rows in one task.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ship, stash

#: Standard errors that the bounds allow for: a miss has a chance of about 1 in 15,000 for a pair.
EPSILON = 4.0
#: Least bits of a code, and bits of a query's component.
LEAST_BITS, QUERY_BITS = 512, 4
#: Rows for which the table has one cell more, and the most cells (beyond, cells grow and have more blocks).
CELL_ROWS, MOST_CELLS = 4096, 1024
#: Bounds of the sample that the centres are fitted on, and rounds of fitting.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 16384, 1 << 24, 8
#: Vectors that are searched exactly to choose the number of cells, and the share of their neighbours these must hold.
SAMPLE_QUERIES, TARGET_RECALL = 128, 0.98
#: Bytes of the vectors, and of the queries, of one block.
BLOCK_BYTES, QUERY_BYTES = 1 << 21, 1 << 24
#: Queries that are scored at once inside a block, and neighbours measured first for each wanted one.
STEP, FIRST = 32, 4


def bits(d: int) -> int:
    """Bits of the code of d components."""
    return -(-max(d, LEAST_BITS) // 64) * 64


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A random isometry of d into bits(d) dimensions, the same for all tasks: one row for each output."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((bits(d), d)))
    return np.ascontiguousarray(q * np.sign(np.diag(r)), np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by a power of two (which changes no cosine) so that no square overflows."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, summed strictly from the first component on."""
    return np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / norms(x)[:, None]


def cosines(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, summed strictly from the first component on."""
    return np.add.accumulate(x * y, axis=1)[:, -1] / (nx * ny)


@dataclass
class Codes:
    words: np.ndarray  # uint64, one row for each vector
    a: np.ndarray
    rho: np.ndarray
    dot: np.ndarray

    def take(self, rows: np.ndarray) -> "Codes":
        return Codes(self.words[rows], self.a[rows], self.rho[rows], self.dot[rows])


def encode(vectors: np.ndarray, centres: np.ndarray) -> Codes:
    """Codes of vectors, each with its cell's centre (one row for each vector)."""
    u = unit(vectors)
    r = u - centres
    rho = np.sqrt((r * r).sum(axis=1))
    x = (r / np.where(rho > 0, rho, 1)[:, None]).astype(np.float32) @ rotation(u.shape[1]).T
    a = np.abs(x).sum(axis=1, dtype=np.float64) / np.sqrt(x.shape[1])
    return Codes(np.packbits(x >= 0, axis=1).view(np.uint64), np.where(rho > 0, np.clip(a, 1e-6, 1.0), 1.0), rho, (u * centres).sum(axis=1))


def bounds(codes: Codes, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the cosines of unit queries and coded vectors, one row for each query, and how far they may be off."""
    d = bits(queries.shape[1])
    r = queries - centre
    far = np.sqrt((r * r).sum(axis=1))
    y = (r / np.where(far > 0, far, 1)[:, None]).astype(np.float32) @ rotation(queries.shape[1]).T
    low = y.min(axis=1, keepdims=True)
    step = np.maximum((y.max(axis=1, keepdims=True) - low) / np.float32((1 << QUERY_BITS) - 1), np.float32(1e-12))
    whole = np.rint((y - low) / step).astype(np.uint8)
    near = low + step * whole
    lost = np.sqrt(((y - near) ** 2).sum(axis=1))
    planes = [np.packbits(whole >> np.uint8(j) & np.uint8(1), axis=1).view(np.uint64) for j in range(QUERY_BITS)]
    counted = np.zeros((len(queries), len(codes.a)), np.uint32)
    for j, plane in enumerate(planes):
        part = np.zeros(counted.shape, np.uint32)
        for w in range(plane.shape[1]):
            part += np.bitwise_count(plane[:, w : w + 1] & codes.words[None, :, w])
        counted += part << np.uint32(j)
    ones = np.bitwise_count(codes.words).sum(axis=1).astype(np.float32)
    dots = (2 * (low * ones[None, :] + step * counted) - near.sum(axis=1, keepdims=True)) / np.float32(np.sqrt(d))
    a, rho = codes.a.astype(np.float32), codes.rho.astype(np.float32)
    spread = np.sqrt(np.maximum(1 - codes.a**2, 0)) / codes.a / np.sqrt(d - 1)
    slack = spread.astype(np.float32) * np.sqrt(np.maximum(1 - dots * dots, 0)) + (lost / np.sqrt(d)).astype(np.float32)[:, None] / a
    scale = far.astype(np.float32)[:, None] * rho
    base = (queries @ centre - centre @ centre).astype(np.float32)[:, None] + codes.dot.astype(np.float32)
    return base + scale * dots / a, EPSILON * scale * slack + np.float32(1e-5)


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, best first, ties to smaller ids; an id counts once, with its best score."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[fresh], ids[fresh], score[fresh]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], ids[best], score[best]


def least_copies(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows that may be among the nearest: of equal vectors, those of the `most` least ids."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize)))[:, 0]
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group))
    group, named = group[order], ids[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (named[1:] != named[:-1])
    order, group = order[fresh], group[fresh]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(group, group) < most])


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) of each query's k nearest in a block, rows of its own id left out; and how many pairs were measured."""
    rows = least_copies(vectors, ids, k + 1)
    ids, vectors, codes = ids[rows], scaled(vectors[rows]), codes.take(rows)
    queries = scaled(queries)
    nq, nv = norms(queries), norms(vectors)
    out, measured = [], 0

    def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        score = np.empty(len(q))
        for at in range(0, len(q), 65536):
            i, j = q[at : at + 65536], v[at : at + 65536]
            score[at : at + 65536] = cosines(queries[i], vectors[j], nq[i], nv[j])
        return score

    for s in range(0, len(queries), STEP):
        estimate, slack = bounds(codes, queries[s : s + STEP] / nq[s : s + STEP, None], centre)
        own = query_ids[s : s + STEP, None] == ids[None, :]
        estimate[own] = -np.inf
        some = min(FIRST * k, len(ids))
        v = np.argpartition(estimate, len(ids) - some, axis=1)[:, len(ids) - some :].ravel()
        q = np.repeat(np.arange(len(estimate)), some)
        q, v = (x[~own[q, v]] for x in (q, v))
        first = exact(s + q, v)
        tq, _, ts = top(q, ids[v], first, k)
        floor = np.full(len(estimate), -np.inf)
        last = np.bincount(tq, minlength=len(floor))
        ends = np.cumsum(last)
        full = last == k
        floor[full] = ts[ends[full] - 1]
        more = estimate + slack >= floor[:, None].astype(np.float32)
        more[own] = False
        more[q, v] = False
        q2, v2 = np.nonzero(more)
        q, v, score = np.concatenate([q, q2]), np.concatenate([v, v2]), np.concatenate([first, exact(s + q2, v2)])
        measured += len(q)
        q, named, score = top(q, ids[v], score, k)
        out.append((query_ids[s + q], named, score))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), measured)


def _vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The flat components of a list column and the bounds of its rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of cells of unit vectors, by alternating assignment and means."""
    rng = np.random.default_rng(len(sample))
    c = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest_centre(sample, c)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=cells)
        c = np.where((n > 0)[:, None], total / np.maximum(n, 1)[:, None], c)
    return c


def _distances(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, less |u|^2."""
    return (c * c).sum(axis=1) - 2 * (u @ c.T)


def _nearest_centre(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(u[s : s + 4096], c).argmin(axis=1) for s in range(0, len(u), 4096)]) if len(u) else np.zeros(0, np.int64)


@dataclass
class Index:
    """The coded rows (vec_id, v, d, cell, code, a, rho, dot), and for each dimension its centres, cells visited and recall measured."""

    rows: DataFrame
    centres: dict[int, np.ndarray]
    visited: dict[int, int]
    recall: dict[int, float]


def index(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", k: int = 5) -> Index:
    """The index of all usable rows, with its number of visited cells measured for k neighbours.

    Rows whose id or vector is null, or whose vector is empty, zero or holds a
    null or non-finite component, are left out; repeated rows and rows of one id with
    different vectors stay.  An empty table gives an empty index.
    """
    spark = ship(df.sparkSession)
    kind = df.schema[vector].dataType.simpleString()
    v = F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")
    kind = kind if kind == "array<float>" else "array<double>"
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable).withColumn("d", F.size("v"))
    found: dict[int, np.ndarray] = {}
    for d, n in sorted((r.d, r.n) for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()):
        found[d] = np.zeros((1, d))
        cells = min(-(-n // CELL_ROWS), MOST_CELLS)
        if cells > 1:
            most = max(min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)), 64)
            sample = unit(np.array([r.v for r in rows.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).collect()]))
            found[d] = centres(sample, min(cells, len(sample) // 8))
    sent = spark.sparkContext.broadcast(found)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = _vectors(b.column(1))
            sizes = np.diff(at)
            code: list[bytes] = [b""] * len(sizes)
            cell = np.zeros(len(sizes), np.int32)
            scalars = np.zeros((3, len(sizes)))
            for d in np.unique(sizes):
                who = np.flatnonzero(sizes == d)
                x = flat[at[who][:, None] + np.arange(d)]
                c = sent.value[int(d)]
                cell[who] = _nearest_centre(unit(x), c)
                got = encode(x, c[cell[who]])
                scalars[:, who] = got.a, got.rho, got.dot
                for i, w in enumerate(who):
                    code[w] = got.words[i].tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(code, pa.binary()), *(pa.array(s) for s in scalars)], names=["vec_id", "v", "d", "cell", "code", "a", "rho", "dot"])

    done = stash(rows.mapInArrow(coded, f"vec_id long, v {kind}, d int, cell int, code binary, a double, rho double, dot double"), "codes")
    out = Index(done, found, {}, {})
    for d, c in found.items():
        out.visited[d], out.recall[d] = (1, 1.0) if len(c) == 1 else _measured(done.where(F.col("d") == d), d, c, k)
    return out


def _measured(rows: DataFrame, d: int, c: np.ndarray, k: int) -> tuple[int, float]:
    """The cells to visit for TARGET_RECALL, and the share of neighbours that these hold: exact search for a sample among all rows."""
    most = max(1, min(SAMPLE_QUERIES, SAMPLE_BYTES // (8 * d)))
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id", "v").limit(most).collect()
    ids, x = np.array([r.vec_id for r in sample]), unit(np.array([r.v for r in sample]))
    sent = rows.sparkSession.sparkContext.broadcast((ids, x))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        where: dict[int, int] = {}
        for b in batches:
            flat, _ = _vectors(b.column(1))
            own, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
            s = x @ unit(flat.reshape(-1, x.shape[1])).T
            s[ids[:, None] == own[None, :]] = -2.0
            some = min(k, len(own))
            j = np.argpartition(s, len(own) - some, axis=1)[:, len(own) - some :]
            q = np.repeat(np.arange(len(ids)), some)
            s, j = np.take_along_axis(s, j, axis=1).ravel(), j.ravel()
            ok = s > -1.5
            held = top(np.concatenate([held[0], q[ok]]), np.concatenate([held[1], own[j[ok]]]), np.concatenate([held[2], s[ok]]), k)
            where |= dict(zip(own[j].tolist(), cell[j].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2]), pa.array([where[i] for i in held[1].tolist()], pa.int32())], names=["q", "id", "s", "cell"])

    near = rows.select("vec_id", "v", "cell").mapInArrow(best, "q int, id long, s double, cell int")
    near = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "id", "cell"))), 1, k).alias("near"))  # k for each task
    order = np.argsort(_distances(x, c), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    ranks = np.sort([place[r.q, n.cell] for r in near.collect() for n in r.near])
    if not len(ranks):
        return len(c), 1.0
    visited = int(ranks[min(int(np.ceil(TARGET_RECALL * len(ranks))), len(ranks)) - 1]) + 1
    return visited, float((ranks < visited).mean())


def _cell(k: int, sent):
    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        d, number = key[0].as_py(), key[1].as_py()
        q = v = np.zeros(0, np.int64)
        s = np.zeros(0)
        if left.num_rows and right.num_rows:
            rows = [_vectors(t.column("v"))[0].reshape(-1, d) for t in (left, right)]
            words = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint64).reshape(right.num_rows, -1)
            codes = Codes(words, *(right.column(n).to_numpy() for n in ("a", "rho", "dot")))
            q, v, s, _ = search_block(left.column("vec_id").to_numpy(), rows[0], right.column("vec_id").to_numpy(), rows[1], codes, sent.value[d][number], k)
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    return cell


def _visits(index: Index, queries: DataFrame) -> DataFrame:
    """A row for each query and cell that it visits."""
    sent = index.rows.sparkSession.sparkContext.broadcast((index.centres, index.visited))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_centres, visited = sent.value
        for b in batches:
            flat, at = _vectors(b.column(1))
            sizes = np.diff(at)
            cells: list[np.ndarray] = [np.zeros(0, np.int32)] * len(sizes)
            for d in np.unique(sizes):
                who = np.flatnonzero(sizes == d)
                order = np.argsort(_distances(unit(flat[at[who][:, None] + np.arange(d)]), all_centres[int(d)]), axis=1, kind="stable")
                for w, o in zip(who, order[:, : visited[int(d)]].astype(np.int32), strict=True):
                    cells[w] = o
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=["vec_id", "v", "d", "cells"])

    plain = queries.select("vec_id", "v", "d")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{ddl}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def nearest(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest vectors found (largest cosine, ties to smaller ids).

    queries: rows of the index.  A vector is no neighbour of a query of its own
    id; with fewer than k others, all of the visited cells are given.  Repeated
    rows count once; of several vectors of one id, and of several queries of one id, the best pair counts.
    Vectors of other dimensions than the query's are not compared with it.
    """
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast(index.centres)
    visits = _visits(index, queries)
    # how many blocks a cell and its queries have: a row for each cell, a bounded number
    wide = 8 * F.col("d").cast("long")
    shape = index.rows.groupBy("d", "cell").agg(F.ceil(F.count("*") * F.first(wide) / BLOCK_BYTES).cast("int").alias("blocks"))
    split = visits.groupBy("d", "cell").agg(F.ceil(F.count("*") * F.first(wide) / QUERY_BYTES).cast("int").alias("parts"))
    shape = stash(shape.join(split, ["d", "cell"]), "cells")
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(shape, ["d", "cell"]).select("d", "cell", every("blocks").alias("block"), block("parts", 1).alias("part"), "vec_id", "v")
    right = index.rows.join(shape, ["d", "cell"]).select("d", "cell", block("blocks", 2).alias("block"), every("parts").alias("part"), "vec_id", "v", "code", "a", "rho", "dot")
    by = ["d", "cell", "block", "part"]
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_cell(k, sent), "query_id long, vec_id long, score double")
    # k candidates of each block visited: of an id the best, of a query the best k
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    each = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), n as (
  select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) as norm from v
), p as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) / (q.norm * c.norm) as score
  from n q join n c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
