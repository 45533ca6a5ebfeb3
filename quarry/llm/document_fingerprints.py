"""Operator 7: homomorphic multiset hashes of documents, and their likeness.

A document is the multiset of its paragraphs (non-empty lines).  A paragraph
hashes to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo a power of two.  So equal multisets have
equal fingerprints whatever the order, and a paragraph is inserted or deleted
by adding or subtracting its vector, without the rest of the text.

The vector of a paragraph has three parts:

* ``WIDE`` lanes of 32 bits from SHAKE-128 of its bytes: equality;
* one counter lane of 32 bits: the number of its grams (runs of three words;
  all its words if they are fewer);
* ``LEVELS`` x ``LANES`` lanes of 16 bits: each gram adds a value to one lane of the
  level that its hash draws (level l with chance 2^-(l+1)).

The last two estimate the likeness of two documents: lanes that differ at the
levels where they are not crowded tell how many grams two multisets do not
share (d); with n and m grams, likeness is (n + m - d) / (n + m + d), the Jaccard
measure of the multisets, 1 exactly where the fingerprints are equal.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import _MULTIPLIERS, mix, require, ship, span_hashes, text_slices, word_spans

WIDE = 32
LEVELS, LANES = 12, 64
STATE_BYTES = WIDE * 4 + 4 + LEVELS * LANES * 2
GRAM = 3
#: Documents of one range of ids that one task walks through, and the most ranges (beyond, ranges grow).
RANGE_DOCS, MOST_RANGES = 1024, 1 << 16
_U = np.uint64


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums for each text: wide lanes (uint32), gram counts (uint32), level lanes (uint16)."""
    n = len(offsets) - 1
    wide = np.zeros((n, WIDE), np.uint32)
    raw = data.tobytes()
    for d in range(n):
        for p in raw[offsets[d] : offsets[d + 1]].split(b"\n"):
            if p:
                wide[d] += np.frombuffer(hashlib.shake_128(p).digest(WIDE * 4), np.uint32)
    # grams stay inside a paragraph: its end is a bound like a text's end
    ends = np.flatnonzero(data == 10) + 1
    bounds = np.union1d(offsets, ends)
    start, end, part = word_spans(data, bounds)
    owner = np.searchsorted(offsets, bounds[:-1], side="right") - 1
    h = span_hashes(data, start, end)
    last = len(h) - GRAM + 1
    grams, of = [], []
    count = np.bincount(part, minlength=len(bounds) - 1) if len(part) else np.zeros(len(bounds) - 1, np.int64)
    if last > 0:
        keep = np.flatnonzero(part[:last] == part[GRAM - 1 :])
        grams.append(sum(h[keep + i] * _MULTIPLIERS[i] for i in range(GRAM)))
        of.append(owner[part[keep]])
    first = np.concatenate([[0], np.cumsum(count)])
    for k in range(1, GRAM):
        few = np.flatnonzero(count == k)
        if len(few):
            grams.append(sum(h[first[few] + i] * _MULTIPLIERS[i] for i in range(k)) + _U(k))
            of.append(owner[few])
    levels = np.zeros((n, LEVELS * LANES), np.uint16)
    number = np.zeros(n, np.uint32)
    if grams:
        g, doc = mix(np.concatenate(grams)), np.concatenate(of)
        number += np.bincount(doc, minlength=n).astype(np.uint32)
        low = g & _U((1 << (LEVELS - 1)) - 1) | _U(1 << (LEVELS - 1))
        level = np.log2((low & (~low + _U(1))).astype(np.float64)).astype(np.int64)
        lane = ((g >> _U(16)) & _U(LANES - 1)).astype(np.int64)
        value = (g >> _U(40)) & _U(0xFFFF)
        at = doc * (LEVELS * LANES) + level * LANES + lane
        sums = np.bincount(at, weights=value.astype(np.float64), minlength=n * LEVELS * LANES)
        levels += (sums.astype(np.int64) & 0xFFFF).astype(np.uint16).reshape(n, -1)
    return wide, number, levels


def pack(wide: np.ndarray, number: np.ndarray, levels: np.ndarray) -> list[bytes]:
    """One state of STATE_BYTES bytes for each document, little-endian lanes."""
    whole = np.concatenate([wide.view(np.uint8).reshape(len(number), -1), number.view(np.uint8).reshape(-1, 4), levels.view(np.uint8).reshape(len(number), -1)], axis=1)
    return [r.tobytes() for r in whole]


def unpack(states: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = np.frombuffer(b"".join(states), np.uint8).reshape(len(states), STATE_BYTES)
    cut = np.ascontiguousarray
    return cut(whole[:, : WIDE * 4]).view(np.uint32), cut(whole[:, WIDE * 4 : WIDE * 4 + 4]).view(np.uint32)[:, 0], cut(whole[:, WIDE * 4 + 4 :]).view(np.uint16)


def fingerprint_state(text: str | None) -> bytes:
    """State of one text, or of one paragraph."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return pack(*vectors(data, np.array([0, len(data)])))[0]


def combine(state: bytes, other: bytes, sign: int = 1) -> bytes:
    """Insert (sign 1) or delete (sign -1) the paragraphs of another state."""
    a, b = unpack([state]), unpack([other])
    return pack(*[x + y if sign > 0 else x - y for x, y in zip(a, b, strict=True)])[0]


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Likeness (0 to 1) of documents, row by row."""
    n = len(a[1])
    differ = (a[2] != b[2]).reshape(n, LEVELS, LANES).sum(axis=2).astype(np.float64)
    share = 2.0 ** -np.minimum(np.arange(1, LEVELS + 1), LEVELS - 1)
    few = differ <= 0.7 * LANES
    # all levels from the first uncrowded one on count together
    from_level = np.where(few.all(axis=1), 0, LEVELS - np.argmin(few[:, ::-1], axis=1))
    used = np.arange(LEVELS) >= np.minimum(from_level, LEVELS - 1)[:, None]
    guess = -LANES * np.log1p(-np.minimum(differ, LANES - 0.5) / LANES)
    d = (guess * used).sum(axis=1) / (share * used).sum(axis=1)
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    d = np.clip(d, np.abs(x - y), x + y)
    out = np.divide(x + y - d, x + y + d, out=np.zeros(n), where=x + y > 0)
    same = (a[0] == b[0]).all(axis=1)
    return np.where(same, 1.0, np.minimum(out, 1 - 1e-9))


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, state) of each row's whole text; state is binary, to be summed with :func:`combine`."""
    ship(df.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text_slices(b, text):
                chars = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(chars.astype(np.int64)), pa.array(pack(*vectors(data, off)), pa.binary())], names=["id", "n_chars", "state"])

    plain = require(df, id_col, text)
    out = plain.mapInArrow(made, f"id {plain.schema[0].dataType.simpleString()}, n_chars long, state binary")
    return out.withColumnRenamed("id", id_col)


def _ranges(keys: DataFrame, count: int) -> tuple[Column, int]:
    """The range of a row's (id, h), ascending with both, and how many ranges there are; about count, some without rows.

    Ranges begin at quantiles of the ids; an id that is several quantiles is cut by h
    (31 bits of a hash) into as many.
    """
    row = keys.agg(F.percentile_approx("id", [k / (count + 1) for k in range(1, count + 1)] or [0.5], max(10000, 4 * count)).alias("p"), F.min("id").alias("least")).first()
    if count < 1 or row.least is None:
        return F.lit(0), 1
    starts, parts = np.unique(np.array([row.least, *row.p], np.int64), return_counts=True)
    before = np.cumsum(parts) - parts

    @F.pandas_udf("int")
    def found(ids: pd.Series, h: pd.Series) -> pd.Series:
        ids, at = ids.to_numpy(), np.searchsorted(starts, ids.to_numpy(), side="right") - 1
        inner = np.where(ids == starts[at], h.to_numpy() * parts[at] >> 31, parts[at] - 1)
        return pd.Series((before[at] + inner).astype(np.int32))

    return found("id", "h"), int(parts.sum())


def _pairs():
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (range, own, id, text) waiting for the next row of its range
        done: list[tuple] = []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held and held[0][0] == row[0] and held[0][1]:
                    done.append((held[0][2], held[0][3], row[3]))
                if not held or held[0][0] != row[0] or held[0][1]:
                    held = [row]
            if len(done) >= 64:
                yield _scored(done)
                done = []
        if done:
            yield _scored(done)

    return walked


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    n_chars, own, edited, following, sha = [], [], [], [], []
    for _, text, after in rows:
        cut = len(text) // 4
        n_chars.append(len(text))
        new = text[: len(text) - cut] + after[:cut]
        own.append(text)
        edited.append(new)
        following.append(after)
        sha.append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
    states = []
    for texts in (own, edited, following):
        if texts is following:  # the next row's text is the own text of the row below, but for the last
            same = [k + 1 < len(own) and own[k + 1] == following[k] for k in range(len(own))]
            rest = [k for k, s in enumerate(same) if not s]
            got = _states([following[k] for k in rest])
            parts = []
            for j in range(3):
                x = np.empty_like(states[0][j])
                x[:-1] = states[0][j][1:]
                x[rest] = got[j]
                parts.append(x)
            states.append(tuple(parts))
        else:
            states.append(_states(texts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array(n_chars, pa.int64()),
            pa.array(sha, pa.string()),
            pa.array([s.hex() for s in pack(*states[0])], pa.string()),
            pa.array([s.hex() for s in pack(*states[1])], pa.string()),
            pa.array(likeness(states[0], states[1])),
            pa.array(likeness(states[0], states[2])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _states(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    for _, _, data, off in text_slices(batch):
        parts.append(vectors(data, off))
    if not parts:
        return np.zeros((0, WIDE), np.uint32), np.zeros(0, np.uint32), np.zeros((0, LEVELS * LANES), np.uint16)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def edited_fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the head of the next row's text.

    The next row is the next in ascending (id, hash of the text, text), null ids last; after
    the last comes the first, and a lone row follows itself.  Null texts count
    as empty; rows of equal id each keep a row; an empty table gives an empty
    result; other columns are dropped.  Texts may be of any length: a task holds a
    batch of them.

    Rows are cut into ranges at quantiles of the ids, MOST_RANGES at most, and an id that has
    very many rows into ranges of the hash.  The first row of a range is sent to
    the range before it too (that of the first range to the last), so every
    range knows what follows its last row: one shuffle, no global window, and what a task
    reads of a range it reads as a stream.
    """
    spark = ship(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.col(f"`{id_col}`").cast("long")
    rows = df.select(F.coalesce(ident, F.lit((1 << 63) - 1)).alias("id"), F.shiftrightunsigned(F.xxhash64(body), 33).alias("h"), body.alias("text"), ident.alias("doc_id"))
    keys = rows.select("id", "h")
    bucket, n = _ranges(keys, min(keys.count() // RANGE_DOCS, MOST_RANGES))
    own = rows.select(bucket.alias("r"), F.lit(True).alias("own"), "id", "h", "text", "doc_id")
    # where ranges with rows begin, and which is the one before: a row for each range, MOST_RANGES at most
    heads = keys.withColumn("r", bucket).groupBy("r").agg(F.min(F.struct("id", "h")).alias("head"))
    last = F.max("r").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select(F.coalesce(F.lag("r").over(W.orderBy("r")), last).alias("to"), "head.*")
    firsts = rows.join(F.broadcast(heads), ["id", "h"]).groupBy("to", "id", "h").agg(F.min("text").alias("text"))
    after = firsts.select(F.col("to").alias("r"), F.lit(False).alias("own"), "id", "h", "text", F.lit(None).cast("long").alias("doc_id"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = own.unionByName(after).repartition(min(tasks, n), "r")
    ordered = both.sortWithinPartitions("r", F.col("own").desc(), "id", "h", "text")
    return ordered.select("r", "own", "doc_id", "text").mapInArrow(_pairs(), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
