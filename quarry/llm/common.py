"""Shared plumbing of the text operators: shipping code, shared storage, byte kernels.

The kernels work on the raw Arrow buffers of a string column (one ``uint8``
array and one offset array for a whole batch), so no Python object is made
per word.  Every kernel is given slices of bounded size by
:func:`text_slices`; one text is never cut, so the bound is the larger of
``SLICE_BYTES`` and the longest text.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import shipping

#: Bytes of text that one kernel call works on.
SLICE_BYTES = 1 << 20
#: Rows that Spark sends to Python at once; texts are long, so batches are short.
BATCH_ROWS = 512
#: Words longer than this are hashed with blake2b instead of the polynomial.
LONG_WORD = 512
#: Longest text that a classifier learns from; with the bounds of rows this bounds the sample.
SAMPLE_BYTES = 1 << 15


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application; set the Arrow batch size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shipping.ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors run inside the driver (tests) gets a
    folder of its own; any other is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.sparkContext.setCheckpointDir(where)
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
    return where


_stashed: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashed.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that :func:`stash` wrote; results that were not yet written elsewhere go with them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _stashed:
        path = jvm.org.apache.hadoop.fs.Path(_stashed.pop())
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a batch; offsets start at 0, null texts are empty."""
    col = batch.column(column)
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    if col.null_count:
        col = col.fill_null("")
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


# --- word and shingle hashes ------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUES = np.frombuffer(hashlib.shake_128(b"quarry byte values").digest(256 * 8), np.uint64)
_MULTIPLIERS = np.frombuffer(hashlib.shake_128(b"quarry shingle multipliers").digest(16 * 8), np.uint64) | _U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span, equal for equal bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = 1 << max(16, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    out = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the number of the text of each."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text (A-Z lower-cased), and bounds of each text's part.

    A text of fewer than k words, one at least, has one shingle: all its words.
    """
    low = _LOWER[data]
    start, end, doc = word_spans(low, offsets)
    h = span_hashes(low, start, end)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    last = len(h) - k + 1
    parts = np.zeros(max(last, 0), np.uint64)
    for i in range(k if last > 0 else 0):
        parts += h[i : i + last] * _MULTIPLIERS[i]
    keep = np.flatnonzero(doc[: max(last, 0)] == doc[k - 1 :]) if last > 0 else np.zeros(0, np.int64)
    full = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    sizes = full.copy()
    sizes[short] = 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], np.uint64)
    is_short = np.zeros(n, bool)
    is_short[short] = True
    out[np.repeat(~is_short, sizes)] = mix(parts[keep])
    few = np.zeros(len(short), np.uint64)
    for i in range(min(k - 1, len(_MULTIPLIERS))):
        has = count[short] > i
        few[has] += h[first[short[has]] + i] * _MULTIPLIERS[i]
    out[bounds[short]] = mix(few + count[short].astype(np.uint64) * _MULTIPLIERS[15])
    for d in np.flatnonzero(sizes > 1):
        out[bounds[d] : bounds[d + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])[bounds]
    return out[new], kept


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


# --- labelled rows ------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows kept out of learning: crc32 of the id as text is divisible by 5 (false for null ids)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(text, y) of a bounded sample of labelled rows that are not held out.

    For each value of the label, the most[value] ids whose hashes are least; of
    several labels of one id the least counts, and of several texts of one id that of
    the least hash; rows without a usable label, id or text, and texts of more
    than SAMPLE_BYTES bytes, are not taken.
    """
    one = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(*most))
    one = one.where(~held_out("id")).groupBy("id").agg(F.min("y").alias("y"))
    parts = [one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in most.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    joined = rows.join(F.broadcast(chosen), "id")
    return joined.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("y").alias("y")).select("text", "y", "id")
