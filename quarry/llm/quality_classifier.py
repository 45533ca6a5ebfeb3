"""Operator 9: text quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words and the character trigrams of its words (lower case,
hashed to WORDS and TRIGRAMS terms), pairs of adjacent byte classes (what case,
digits, white space, each punctuation mark and other letters follow each other) and
its repetitions (words equal to the word before, words and lines seen before in the
text).  Each family's shares are weighted by inverse document frequency, brought to
the length that WEIGHTS names, and projected
on the leading singular vectors of the labelled sample.  The sample's vectors,
at most MOST_LABELLED rows, are broadcast; the exact cosines of every
document with all of them are computed in blocks, and the NEIGHBOURS nearest, with
all that are as near as the last of them, vote with weight similarity ** SHARPNESS.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _LOWER, held_out, mix, ship, span_hashes, text_slices, training_rows, word_spans

#: Bounds of the labelled sample: rows of label 0 and of label 1.
MOST_LABELLED = {0: 1500, 1: 2500}
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 6.0
THRESHOLD = 0.3

_PUNCTUATION = b".,!?*#%$&|-_:;/\\'\"()<>=@+~"
CLASSES = 6 + len(_PUNCTUATION)
_CLASS = np.full(256, 5, np.int64)  # controls and other marks
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[128:] = 0
for _i, _b in enumerate(_PUNCTUATION):
    _CLASS[_b] = 6 + _i
SHAPES = CLASSES * CLASSES
#: Hashed terms for words and for trigrams of their characters.
WORDS, TRIGRAMS = 1 << 11, 1 << 10
TERMS = SHAPES + 3 + WORDS + TRIGRAMS
#: Where each family of terms begins and ends, and how long its part of a vector is at most.
FAMILIES = ((0, SHAPES + 3), (SHAPES + 3, SHAPES + 3 + WORDS), (SHAPES + 3 + WORDS, TERMS))
WEIGHTS = (1.0, 0.5, 0.5)
#: Rounds of the randomised decomposition.
POWER_ROUNDS = 6


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the terms of each text."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    c = _CLASS[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    tally = lambda at, size: np.bincount(at, minlength=n * size).reshape(n, size)
    pair = doc[:-1] * SHAPES + c[:-1] * CLASSES + c[1:]
    out[:, :SHAPES] = tally(pair[doc[:-1] == doc[1:]], SHAPES)
    low = _LOWER[data]
    start, end, owner = word_spans(low, offsets)
    if len(start):
        h = span_hashes(low, start, end)
        again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        out[:, SHAPES] = np.bincount(owner[1:][again], minlength=n)
        out[:, SHAPES + 1] = _repeats(h, owner, n)
        out[:, FAMILIES[1][0] : FAMILIES[1][1]] = tally(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), WORDS)
        wide = low.astype(np.uint64)
        code = mix(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) % np.uint64(TRIGRAMS) if len(low) > 2 else np.zeros(0, np.uint64)
        inside = np.zeros(len(code) + 1, np.int64)
        np.add.at(inside, start[end - start > 2], 1)
        np.add.at(inside, end[end - start > 2] - 2, -1)
        at = np.flatnonzero(np.cumsum(inside)[: len(code)])
        out[:, FAMILIES[2][0] :] = tally(doc[at] * TRIGRAMS + code[at].astype(np.int64), TRIGRAMS)
    breaks = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
    s, e = breaks[:-1], breaks[1:]
    h, owner = span_hashes(low, s, e), np.searchsorted(offsets, s, side="right") - 1
    out[:, SHAPES + 2] = _repeats(h[e - s > 1], owner[e - s > 1], n)
    return out


def _repeats(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's hashes were there before."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=n)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares in their family."""
    out = counts.copy()
    out[:, SHAPES : SHAPES + 3] *= 6  # a word has about six bytes
    for (a, b), size in zip(FAMILIES, (SHAPES, WORDS, TRIGRAMS), strict=True):
        out[:, a:b] /= np.maximum(counts[:, a : a + size].sum(axis=1, keepdims=True), 1)
    return np.sqrt(out, out=out)


class Model:
    """Weights, projection and the sample's unit vectors with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        """counts is worked on in place: the driver holds the sample's matrix once."""
        self.prior = float(labels.mean()) if len(labels) else 0.5
        held = sum(((counts[s : s + 256] > 0).sum(axis=0) for s in range(0, len(counts), 256)), np.zeros(TERMS, np.int64))
        self.idf = np.log((1 + len(counts)) / (1 + held)).astype(np.float32) + 1
        for s in range(0, len(counts), 256):
            counts[s : s + 256] = self.weighted(counts[s : s + 256])
        self.axes = _leading(counts, DIMENSIONS) if len(counts) else np.zeros((TERMS, 1), np.float32)
        self.labels = labels.astype(np.float64)
        self.vectors = self._units(counts)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = _shares(counts) * self.idf
        for (a, b), weight in zip(FAMILIES, WEIGHTS, strict=True):
            size = np.sqrt((x[:, a:b] ** 2).sum(axis=1, keepdims=True))
            x[:, a:b] *= weight / np.maximum(size, 1e-9)
        return x

    def project(self, counts: np.ndarray) -> np.ndarray:
        return self._units(self.weighted(counts))

    def _units(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.axes
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Shares of the votes for label 1; the prior where nothing is similar."""
        n, k = len(counts), min(NEIGHBOURS, len(self.labels))
        if not k or not n:
            return np.full(n, self.prior)
        sims = np.round(self.project(counts) @ self.vectors.T, 6)  # equal vectors are equally near, however a product is summed
        last = np.partition(sims, -k, axis=1)[:, -k]
        row, near = np.nonzero(sims >= last[:, None])
        w = np.maximum(sims[row, near], 0).astype(np.float64) ** SHARPNESS
        total, good = np.bincount(row, w, n), np.bincount(row, w * self.labels[near], n)
        return np.divide(good, total, out=np.full(n, self.prior), where=total > 0).clip(0, 1)


def _leading(x: np.ndarray, most: int) -> np.ndarray:
    """The leading right singular vectors of x as columns, by rounds of a random block (16 columns more than wanted)."""
    y = np.random.default_rng(0).standard_normal((x.shape[1], most + 16)).astype(np.float32)
    for _ in range(POWER_ROUNDS):
        y = np.linalg.qr(x.T @ (x @ y))[0]
    _, _, axes = np.linalg.svd(x @ y, full_matrices=False)
    return np.ascontiguousarray((y @ axes.T)[:, :most], np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id") -> Model:
    """A model of at most MOST_LABELLED labelled rows, none of them held out."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text_slices(b):
                c = term_counts(data, off)
                at = [np.flatnonzero(r) for r in c]
                yield pa.RecordBatch.from_arrays([b.column("y")[i:j], pa.array([k.astype(np.int32).tobytes() for k in at], pa.binary()), pa.array([r[k].tobytes() for r, k in zip(c, at, strict=True)], pa.binary())], names=["y", "at", "n"])

    rows = training_rows(docs, labels, label, MOST_LABELLED, text, id_col).mapInArrow(counted, "y int, at binary, n binary").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.at), bytes(r.n)))  # the same model, however the tasks end
    y, counts = np.array([r.y for r in rows], np.float32), np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.n, np.float32)
    del rows
    return Model(counts, y)


def _scored(docs: DataFrame, model: Model, names: list[str], text: str) -> DataFrame:
    """The named columns of docs and __score."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    plain = docs.select(*[F.col(f"`{c}`") for c in names], *([] if text in names else [F.col(f"`{text}`")]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for i, j, data, off in text_slices(b, text):
                s = m.score(term_counts(data, off))
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in b.columns[: len(names)]], pa.array(s.astype(np.float64))], names=[*names, "__score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(names)])
    return plain.mapInArrow(scored, f"{ddl}, __score double")


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of each row's whole text.

    Empty and null texts have no similar neighbour and get the sample's share
    of label 1; without any labelled row every score is 0.5.  All neighbours as near as
    the last one vote, so ties need no order.  Texts of any length are read whole.  Null ids and
    repeated rows keep a row each; other columns are dropped unless named in keep.
    """
    names = [id_col, *[c for c in keep or [] if c != id_col]]
    out = _scored(docs, model, names, text)
    return out.select(f"`{id_col}`", held_out(f"`{id_col}`").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), *[F.col(f"`{c}`") for c in names if c != id_col])


def chosen(docs: DataFrame, model: Model, predicted: int, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns whatever these are called, for which :func:`score` predicts a value."""
    out = _scored(docs, model, docs.columns, text)
    return out.where((F.col("__score") >= THRESHOLD) == F.lit(predicted == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])
