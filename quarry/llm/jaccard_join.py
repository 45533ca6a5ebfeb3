"""Operator 6: n-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed k-word shingles.  Documents of equal sets form one
node.  Two nodes link when their sets' Jaccard measure reaches the threshold t.

1. One pass finds the shingles that a large share of all documents hold (at
   most ``2 / HOT_SHARE`` times the mean set size of them: a bounded list).
2. A second pass deals each node's shingles to hash buckets, as packed arrays, and
   each bucket tells which of its shingles more than one node holds, and how
   many do.  A node x can link only if at least ceil(t |x|) of its shingles are
   shared; all others are done.
3. The rest order their shingles: unshared ones, shared ones by frequency,
   common ones.  Nodes that link share at least l of the first
   |x| - ceil(t |x|) + l shingles, for every l.  Each node picks the l at which its
   prefix costs least: the postings that the longer prefix meets, against the
   verifications that l matches spare; a pair is held to the smaller l, and to
   the prefixes that its two sizes allow.
4. Links are looked for only between what isn't yet connected: first between
   nodes of equal min-hashes and the most central of them, then between the
   nodes of a prefix shingle and its most central one, last between all nodes
   of different components that share enough prefix shingles.  So a group of n near copies costs about n verifications, and
   no link between different components is lost.

Hashes of sets and of shingles have 64 bits.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix, require, ship, shingle_hashes, stash, text_slices

#: Part of all documents from which on a shingle counts as common.
HOT_SHARE = 0.002
#: Shingles that a task holds before it deals them out, and shingles of a bucket.
FLUSH, BUCKET = 1 << 21, 1 << 21
#: Longest l, and what a verification costs in postings, for each shingle of the node.
MOST_MATCHES, VERIFY_COST = 8, 0.05
#: Rows of a shingle that one task compares; more are cut into blocks.
BLOCK = 50_000
#: From so many rows on, the nodes of a shingle are compared at once (candidates of such groups are too many to deal
#: out); nodes and bytes of shingles of one block, and nodes compared with a cell's at a time.
DENSE_ROWS, DENSE_BLOCK, DENSE_BYTES, DENSE_STEP = 512, 2048, 1 << 24, 512
#: Parts that the pairs of one node are dealt to, and the most common shingles (the rest pass their buckets).
PARTS, MOST_COMMON = 64, 1 << 20
MIN_HASHES = 4
#: Frequency codes stop at 254 (255: common); what a shingle with such a code counts as.
FREQUENT, FREQUENT_COST = 254, 1e5
_U = np.uint64


def _sets(batches: Iterator[pa.RecordBatch], k: int, text: str):
    """(row ids as Arrow array, shingles, bounds) of slices."""
    for b in batches:
        for i, j, data, off in text_slices(b, text):
            yield (b.column(0)[i:j], *shingle_hashes(data, off, k))


def _signatures(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: of the sum of its members' hashes and its size."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sh ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _survey(k: int, text: str, kind: str):
    """Rows (0, id, set size, signature) and, of shingles frequent in a flush, (1, null, count, shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0

        def frequent() -> pa.RecordBatch:
            v = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            count = np.diff(np.append(edge, len(v)))
            few = count >= max(3, HOT_SHARE * docs)
            return rows(1, pa.nulls(int(few.sum()), id_type), count[few], v[edge[few]].view(np.int64))

        def rows(what: int, ids: pa.Array, n: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), what, np.int32)), ids, pa.array(n.astype(np.int64)), pa.array(value)], names=["kind", "id", "n", "value"])

        id_type = None
        for ids, sh, at in _sets(batches, k, text):
            id_type = ids.type
            n = np.diff(at)
            yield rows(0, ids, n, _signatures(sh, at))
            held.append(sh)
            docs, size = docs + len(n), size + len(sh)
            if size >= FLUSH:
                yield frequent()
                held, docs, size = [], 0, 0
        if size:
            yield frequent()

    return run, f"kind int, id {kind}, n long, value long"


_BLOB = "part int, kind int, sigs binary, ns binary, counts binary, shingles binary, dfs binary"
_BLOB_NAMES = [x.split()[0] for x in _BLOB.split(", ")]


def _blob(part: int, kind: int, sigs: np.ndarray, ns: np.ndarray, node: np.ndarray, shingles: bytes, dfs: bytes) -> tuple:
    """node: the index into sigs and ns of each shingle, ascending."""
    used, counts = np.unique(node, return_counts=True)
    return part, kind, sigs[used].tobytes(), ns[used].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), shingles, dfs


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_BLOB_NAMES)


def _deal(k: int, text: str, buckets: int, shards: int, hot):
    """Packed shingles of the nodes: kind 0 for each bucket, kind 1 the common ones, for each shard."""
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = hot.value
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig = np.concatenate([h[0] for h in held])
            n = np.concatenate([h[1] for h in held])
            sh = np.concatenate([h[2] for h in held])
            _, first = np.unique(sig, return_index=True)
            once = np.zeros(len(sig), bool)
            once[first] = True
            node = np.repeat(np.arange(len(sig), dtype=np.uint32), n)
            keep = np.repeat(once, n)
            sh, node = sh[keep], node[keep]
            if len(common):
                at = np.minimum(np.searchsorted(common, sh), len(common) - 1)
                is_hot = common[at] == sh
                part = (mix(sig.view(np.uint64))[node[is_hot]] % _U(shards)).astype(np.int64)
                yield from _cut(part, 1, sig, n, node[is_hot], sh[is_hot])
                sh, node = sh[~is_hot], node[~is_hot]
            yield from _cut((sh >> _U(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64) if bits else np.zeros(len(sh), np.uint16), 0, sig, n, node, sh)

        for _, sh, at in _sets(batches, k, text):
            n = np.diff(at)
            full = n > 0
            held.append((_signatures(sh, at)[full], n[full], sh))
            size += len(sh)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def _cut(part: np.ndarray, kind: int, sig: np.ndarray, n: np.ndarray, node: np.ndarray, sh: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(sh):
            return
        order = np.argsort(part, kind="stable")
        part, node, sh = part[order], node[order], sh[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield _batch([_blob(int(part[a]), kind, sig, n, node[a:b], sh[a:b].tobytes(), b"")])

    return run


def _open(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, set sizes, and for each shingle: its node's index, itself, its frequency code."""
    cols = {c: table.column(c).to_pylist() for c in ("sigs", "ns", "counts", "shingles", "dfs")}
    sig = np.frombuffer(b"".join(cols["sigs"]), np.int64)
    n = np.frombuffer(b"".join(cols["ns"]), np.uint32)
    node = np.repeat(np.arange(len(sig)), np.frombuffer(b"".join(cols["counts"]), np.uint32))
    raw = b"".join(cols["shingles"])
    return sig, n, node, np.frombuffer(raw, np.uint64), np.frombuffer(b"".join(cols["dfs"]), np.uint8)


def _shared(shards: int):
    """For a bucket: the shingles that more than one node holds, for each shard of nodes."""

    def run(table: pa.Table) -> pa.Table:
        sig, n, node, sh, _ = _open(table)
        values, first, where = np.unique(sig, return_index=True, return_inverse=True)
        node = where[node]
        n = n[first]
        order = np.lexsort((node, sh)) if len(values) < len(sig) else np.argsort(sh, kind="stable")
        sh, node = sh[order], node[order]
        fresh = np.ones(len(sh), bool)
        fresh[1:] = (sh[1:] != sh[:-1]) | (node[1:] != node[:-1])
        sh, node = sh[fresh], node[fresh]
        edge = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]])) if len(sh) else np.zeros(0, np.int64)
        df = np.diff(np.append(edge, len(sh)))
        df = np.repeat(df, df)
        keep = df >= 2
        sh, node, df = sh[keep], node[keep], np.minimum(df[keep], FREQUENT).astype(np.uint8)
        part = (mix(values.view(np.uint64))[node] % _U(shards)).astype(np.int64)
        order = np.lexsort((node, part))
        part, sh, node, df = part[order], sh[order], node[order], df[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)) if len(part) else np.zeros(1, np.int64)
        rows = [_blob(int(part[a]), 0, values, n, node[a:b], sh[a:b].tobytes(), df[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_batches([_batch(rows)]) if rows else _empty()

    return run


def _empty() -> pa.Table:
    return pa.Table.from_arrays([pa.array([], t) for t in [pa.int32(), pa.int32(), *[pa.binary()] * 5]], names=_BLOB_NAMES)


def required(n, percent: int, of: int = 100):
    """The least overlap that a set of n needs with any set it links with; with of = 100 + percent, two sets of n in all."""
    return -(-n * percent // of)


def choose_matches(dfs: np.ndarray, n: int, unshared: int, percent: int) -> int:
    """The number of matches l whose prefix costs least: postings met, and verifications of what meets l of them."""
    first = n - required(n, percent) + 1 - unshared
    met = np.cumsum(np.where(dfs >= FREQUENT, FREQUENT_COST, dfs.astype(np.float64) - 1))
    best, least = 1, math.inf
    for l in range(1, MOST_MATCHES + 1):
        if first + l - 1 > len(dfs):
            break
        postings = met[first + l - 2]
        cost = postings + postings / l * VERIFY_COST * n
        if cost < least:
            best, least = l, cost
    return best


def _prefixes(percent: int):
    """For a shard: nodes that can link, with their ordered shared shingles and the prefix chosen."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        kind1 = pa.compute.equal(table.column("kind"), 1)
        parts = []
        for hot in (False, True):
            sub = table.filter(kind1 if hot else pa.compute.invert(kind1))
            sig, n, node, sh, df = _open(sub)
            parts.append((sig, n, sig[node], sh, np.full(len(sh), 255, np.uint8) if hot else df))
        sig = np.concatenate([p[2] for p in parts])
        sh = np.concatenate([p[3] for p in parts])
        df = np.concatenate([p[4] for p in parts])
        sizes = dict(zip(np.concatenate([p[0] for p in parts]).tolist(), np.concatenate([p[1] for p in parts]).tolist(), strict=True))
        # first drop the nodes that share too little, then order the few that are left
        nodes, where = np.unique(sig, return_inverse=True)
        order = np.lexsort((sh, df, where))
        where, sh, df = where[order], sh[order], df[order]
        fresh = np.ones(len(sh), bool)
        fresh[1:] = (sh[1:] != sh[:-1]) | (where[1:] != where[:-1])
        where, sh, df = where[fresh], sh[fresh], df[fresh]
        at = np.searchsorted(where, np.arange(len(nodes) + 1))
        for i, s in enumerate(nodes.tolist()):
            n, mine = sizes[s], at[i + 1] - at[i]
            if mine < required(n, percent):
                continue
            d, unshared = df[at[i] : at[i + 1]], n - mine
            l = choose_matches(d, n, unshared, percent)
            out.append((s, n, l, n - required(n, percent) + 1 - unshared, sh[at[i] : at[i + 1]].tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["sig", "n", "matches", "first", "shingles"])

    return run, "sig long, n long, matches int, first int, shingles binary"


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.repeat(b.column("sig").to_numpy(), MIN_HASHES)
        keys = np.array([mix(np.frombuffer(x, np.uint64) ^ _U(0xA24BAED4963EE407 * (s + 1) & (1 << 64) - 1)).min() for x in b.column("shingles").to_pylist() for s in range(MIN_HASHES)], np.uint64)
        central = b.column("central").take(pa.array(np.repeat(np.arange(b.num_rows), MIN_HASHES)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sig), central], names=["key", "sig", "central"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [b.column(c).to_pylist() for c in ("sig", "root", "n", "matches", "first", "u", "shingles")]
        for at in range(0, b.num_rows, 64):
            part = [c[at : at + 64] for c in rows]
            size = [f + l - 1 for f, l in zip(part[4], part[3], strict=True)]
            sh = np.concatenate([np.frombuffer(x, np.uint64)[:k] for x, k in zip(part[6], size, strict=True)])
            each = [pa.array(np.repeat(np.array(part[i], t), size)) for i, t in ((0, np.int64), (1, np.int64), (2, np.int64), (3, np.int32), (4, np.int32), (5, np.int32))]
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
            yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), *each, pa.array(place)], names=["shingle", "sig", "root", "n", "matches", "first", "u", "place"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            both = np.zeros(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column("ta"), b.column("tb"), strict=True)):
                z = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                z.sort()
                both[i] = (z[1:] == z[:-1]).sum()
            ok = pa.array(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link.

    A central node is the a of very many pairs: they are dealt by (a, a part of the hash of
    b), and a's set is sent once to each part that has pairs.
    """
    side = lambda c: nodes.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"t{c}"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int").alias("part"))
    centres = dealt.select("a", "part").distinct().join(side("a"), "a")
    return dealt.join(side("b"), "b").join(centres, ["a", "part"]).mapInArrow(_verify(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for all nodes with edges but the least ones.

    Alternates large-star and small-star steps until every node points to a root;
    edges are written to the shared folder after each round, and no group is gathered.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        # large-star: what is above u, to the least around u
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stash(around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        # small-star: what is below u, and u, to the least below u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stash(small.where("u <> v").distinct(), "edges")
        if e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of what was connected before and new links."""
    known = links if roots is None else links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
    return components(known)


def _crossing(percent: int):
    """Pairs of different components in runs of equal (shingle, i, j) cells of a sorted partition."""

    def pairs(run: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell_i, cell_j = run["i"][0], run["j"][0]
        m = len(run["sig"])
        if (run["root"] == run["root"][0]).all():
            return
        by_n = np.argsort(run["n"], kind="stable")
        c = {k: v[by_n] for k, v in run.items()}
        c["rank"] = c["n"] - required(c["n"], percent) + 1 - c["first"] + c["place"]  # among all shingles, unshared ones first
        most = np.searchsorted(c["n"], c["n"] * 100 // percent, side="right")  # sizes allow partners up to here
        for s in range(0, m, 256):
            width = int(most[min(s + 255, m - 1)]) - s
            if width <= 1:
                continue
            x = np.arange(s, min(s + 256, m))[:, None]
            y = np.arange(s, s + width)[None, :]
            ok = (y > x) & (y < most[x]) & (c["root"][x] != c["root"][y])
            if cell_i != cell_j:
                ok &= c["block"][x] != c["block"][y]
            # the pair's own need: of its overlap, l shingles lie in the first n - need + l of either set
            l = np.minimum(c["matches"][x], c["matches"][y])
            slack = l - required(c["n"][x] + c["n"][y], percent, percent + 100)
            ok &= (c["rank"][x] < c["n"][x] + slack) & (c["rank"][y] < c["n"][y] + slack)
            p, q = np.nonzero(ok)
            if len(p):
                a, b = c["sig"][s + p], c["sig"][s + q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(l[p, q].astype(np.int32))], names=["a", "b", "matches"])

    return _by_cell(pairs, ["shingle", "i", "j", "sig", "root", "n", "matches", "first", "place", "block"])


def _crowd(percent: int):
    """Links between different components of a cell, from the products of its nodes' shingle sets."""

    def pairs(run: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, root, n = run["sig"], run["root"], run["n"]
        names, where, counts = np.unique(root, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return
        few = np.flatnonzero(where != counts.argmax())  # every pair of two components has one of these
        size = np.array([len(x) // 8 for x in run["shingles"]])
        values, column = np.unique(np.frombuffer(b"".join(run["shingles"]), np.uint64), return_inverse=True)
        row = np.repeat(np.arange(len(sig)), size)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        cuts = np.searchsorted(column, np.arange(0, len(values) + 2048, 2048))
        for at in range(0, len(few), DENSE_STEP):
            some = few[at : at + DENSE_STEP]
            both = np.zeros((len(some), len(sig)), np.float32)
            for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = np.zeros((len(sig), 2048), np.float32)
                part[row[a:b], column[a:b] - 2048 * c] = 1
                both += part[some] @ part.T
            p, q = np.nonzero((100 * both.astype(np.int32) >= percent * (n[some][:, None] + n[None, :] - both)) & (root[some][:, None] != root[None, :]))
            if len(p):
                a, b = sig[some[p]], sig[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _by_cell(pairs, ["shingle", "i", "j", "sig", "root", "n", "shingles"])


def _by_cell(pairs, names: list[str]):
    """pairs() on each run of equal (shingle, i, j) of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            new = (c["shingle"][1:] != c["shingle"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])
            edge = np.concatenate([[0], np.flatnonzero(new) + 1])
            for s, t in zip(edge[:-1], edge[1:], strict=True):
                if t - s > 1:
                    yield from pairs({k: v[s:t] for k, v in c.items()})
            held = {k: v[edge[-1] :] for k, v in c.items()}
        if held is not None and len(held["sig"]) > 1:
            yield from pairs(held)

    return run


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 75, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable over links) of each row's whole text.

    Null, empty and wordless texts have no shingles, link with nothing and are
    their own component.  Rows of equal id each keep a row and take part with
    their own text; null ids are not chosen as component ids while there are
    others.  An empty table gives an empty result; other columns are dropped.
    """
    spark = ship(df.sparkSession)
    docs = require(df, id_col, text)
    run, schema = _survey(k, text, docs.schema[0].dataType.simpleString())
    survey = stash(docs.mapInArrow(run, schema), "survey")
    rows = survey.where("kind = 0").select(F.col("id").alias(id_col), "n", F.col("value").alias("sig"))
    count, total = rows.agg(F.count("*"), F.sum("n")).first()
    buckets = 1 << max(0, math.ceil(math.log2(max(1, (total or 0) / BUCKET))))
    buckets = max(buckets, 32 if (total or 0) > BUCKET else 1)
    shards = max(1, min(4 * buckets, math.ceil((total or 0) / (BUCKET / 8))))
    hot_rows = survey.where("kind = 1").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, HOT_SHARE / 2 * (count or 0)))
    most = int(2 / HOT_SHARE * max(1.0, (total or 0) / max(1, count or 0))) + 1
    hot = np.sort(np.array([r.value for r in hot_rows.orderBy(F.desc("n"), "value").limit(min(most, MOST_COMMON)).collect()], np.int64).view(np.uint64))
    common = spark.sparkContext.broadcast(hot)

    dealt = docs.mapInArrow(_deal(k, text, buckets, shards, common), _BLOB)
    # common shingles pass their bucket: they ride on a group of their own, and go on to their shard
    shared = dealt.withColumn("key", F.when(F.col("kind") == 0, F.col("part")).otherwise(-1 - F.pmod(F.col("part"), F.lit(buckets))))
    by_bucket = shared.groupBy("key").applyInArrow(_bucket(_shared(shards)), _BLOB)
    run, schema = _prefixes(percent)
    nodes = stash(by_bucket.groupBy("part").applyInArrow(run, schema), "nodes")

    # links that connect most: to the most central node of equal min-hash, then of equal prefix shingle
    keys = nodes.select("sig", "shingles", _central(percent)).mapInArrow(_min_hashes, "key long, sig long, central struct<u:int,sig:long>")
    roots = _merged(None, stash(verified(_to_central(keys), nodes, percent), "links"))
    postings = _open_postings(nodes, roots, percent)
    pivots = _mixed(postings).select("shingle", F.col("central.sig").alias("a"), F.col("central.root").alias("ra"))
    met = postings.select("shingle", F.col("sig").alias("b"), "root").join(pivots, "shingle").where("root <> ra")
    best = met.groupBy("a", "b").agg(F.count("*").alias("met")).groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a"))
    roots = _merged(roots, stash(verified(best, nodes, percent), "links"))
    # all that is left between different components
    postings = stash(_open_postings(nodes, roots, percent), "postings")
    mixed = postings.drop("u").join(_mixed(postings).select("shingle", "rows", "volume"), "shingle")
    found = _cells(mixed.where(F.col("rows") < DENSE_ROWS), F.ceil(F.col("rows") / BLOCK)).mapInArrow(_crossing(percent), "a long, b long, matches int")
    pairs = found.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("matches").alias("matches")).where("met >= matches")
    # nodes of very frequent shingles are compared where they meet: candidates of such groups would be too many to deal out
    crowds = mixed.where(F.col("rows") >= DENSE_ROWS)
    crowd_nodes = crowds.join(nodes.select("sig", "shingles"), "sig")
    dense = _cells(crowd_nodes, F.ceil(F.greatest(F.col("rows") / DENSE_BLOCK, F.col("volume") * 8 / DENSE_BYTES)), "shingles").mapInArrow(_crowd(percent), "a long, b long")
    roots = _merged(roots, stash(verified(pairs, nodes, percent).unionByName(dense), "links")).withColumnRenamed("node", "sig")
    classes = rows.where("n > 0").groupBy("sig").agg(F.min(id_col).alias("least"))
    rooted = classes.join(roots, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "least")
    ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "component_id")
    linked = rows.where("n > 0").join(ids, "sig", "left").select(id_col, F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select(id_col, F.col("n").alias("n_shingles"), F.col(id_col).alias("component_id"))
    return linked.unionByName(alone)


def _bucket(shared):
    def run(table: pa.Table) -> pa.Table:
        return table.select(_BLOB_NAMES) if table.column("kind")[0].as_py() == 1 else shared(table)

    return run


def _central(percent: int):
    """What the most central nodes have least of: shingles that no other node holds, in thousandths of their set."""
    n = F.col("n")
    unshared = n - F.ceil(n * percent / 100) + 1 - F.col("first")
    return F.struct((unshared * 1000 / n).cast("int").alias("u"), F.col("sig")).alias("central")


def _cells(rows: DataFrame, blocks, *more: str) -> DataFrame:
    """Rows dealt to the cells (shingle, i, j) of their shingle's pairs of blocks, sorted by cell."""
    t = rows.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int"))
    t = t.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    t = t.select("shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "root", "n", "matches", "first", "place", "block", *more)
    return t.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")


def _to_central(keys: DataFrame) -> DataFrame:
    pivots = keys.groupBy("key").agg(F.min("central").alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.sig").alias("a"))
    return keys.join(pivots, "key").select("a", F.col("sig").alias("b")).where("a <> b").distinct()


def _open_postings(nodes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    rooted = nodes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    part = rooted.select("sig", "root", "n", "matches", "first", "shingles", _central(percent).getField("u").alias("u"))
    return part.mapInArrow(_postings, "shingle long, sig long, root long, n long, matches int, first int, u int, place int")


def _mixed(postings: DataFrame) -> DataFrame:
    """Shingles of more than one component: their most central node with its root, and how many rows they have."""
    each = postings.groupBy("shingle").agg(F.min(F.struct("u", "sig", "root")).alias("central"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows"), F.sum("n").alias("volume"))
    return each.where("lo <> hi").select("shingle", "central", "rows", "volume")


ORACLE = """
with recursive words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words
), items as (
  select r, hash(unnest(s)) as h from sets
), common as (
  select a.r as x, b.r as y, count(*) as n from items a join items b on a.h = b.h and a.r < b.r group by all
), links as (
  select x, y from common join sets a on a.r = x join sets b on b.r = y
  where 100 * common.n >= 75 * (len(a.s) + len(b.s) - common.n)
), reach as (
  select r as x, r as y from sets
  union
  select reach.x, l.y from reach join (select x, y from links union all select y, x from links) l on l.x = reach.y
)
select any_value(s.doc_id) as doc_id, any_value(len(s.s))::bigint as n_shingles, min(t.doc_id) as component_id
from reach join sets s on s.r = reach.x join sets t on t.r = reach.y group by reach.x
"""
