"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words (runs of letters and digits, lower case) enter as a word vector
(hashed; words that too few labelled texts hold share the zero vector) plus the
vectors of three character trigrams (first, second, last).  Two gated
recurrent layers read each window of WINDOW words from either end, attention
pools their states, and a logistic unit scores the window.  Windows overlap by
half; a text's score is that of its highest window.

The network is trained in numpy, on the driver, from a bounded labelled sample:
each epoch scores all windows of the sample and takes, of each text, the
highest one (a text's label is that of its worst window) and, of texts of label
0, a random one too.  A word's first vector component starts at its log odds.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _LOWER, held_out, mix, ship, span_hashes, text_slices, training_rows

#: Bounds of the labelled sample: rows of label 0 and of label 1.
MOST_LABELLED = {0: 2000, 1: 1000}
WINDOW, STRIDE = 32, 16
WORDS, TRIGRAMS = 1 << 16, 1 << 11
SIZE, HIDDEN = 8, 8
EPOCHS, BATCH, RATE = 8, 128, 0.01
#: Texts of the sample that must hold a word before it has a vector of its own.
LEAST_TEXTS = 3
THRESHOLD = 0.5

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_U = np.uint64


def inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its word bucket and three trigram buckets; and the bounds of each text's words."""
    low = _LOWER[data]
    inside = np.concatenate([[False], _WORD[low], [False]])
    cut = offsets[(offsets > 0) & (offsets < len(low))]
    edge = inside[1:] != inside[:-1]
    split = cut[inside[cut] & inside[cut + 1]]  # a word ends and another begins at a text's bound
    at = np.sort(np.concatenate([np.flatnonzero(edge), split, split]))
    start, end = at[::2], at[1::2]
    word = (span_hashes(low, start, end) & _U(WORDS - 1)).astype(np.int32)
    wide = np.concatenate([low, np.zeros(4, np.uint8)]).astype(np.uint64)
    length = (end - start).astype(np.uint64)
    tri = np.empty((len(start), 3), np.int32)
    for k, first in enumerate((start, np.minimum(start + 1, np.maximum(end - 2, start)), np.maximum(end - 3, start))):
        code = wide[first] | wide[first + 1] << _U(8) | wide[first + 2] << _U(16)
        code &= (_U(1) << (np.minimum(length, _U(3)) * _U(8))) - _U(1)
        tri[:, k] = (mix(code + _U(k + 1 << 32)) & _U(TRIGRAMS - 1)).astype(np.int32)
    return np.concatenate([word[:, None], tri], axis=1), np.searchsorted(start, offsets)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of all windows; the last window of a text ends with it."""
    n = np.diff(bounds)
    many = np.where(n > 0, 1 + np.maximum(-(-(n - WINDOW) // STRIDE), 0), 0)
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = np.minimum(nth * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return bounds[doc] + at, np.minimum(n[doc], WINDOW), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) * (0.5 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"word": np.zeros((WORDS, SIZE), np.float32), "tri": (r.standard_normal((TRIGRAMS, SIZE)) * 0.02).astype(np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": draw(SIZE, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"wa": draw(2 * HIDDEN, HIDDEN), "ca": np.zeros(HIDDEN, np.float32), "va": draw(HIDDEN, 1)[:, 0], "wo": draw(2 * HIDDEN, 1)[:, 0], "co": np.zeros(1, np.float32)}

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        e = self.p["word"][x[:, 0]] + self.p["tri"][x[:, 1]] + self.p["tri"][x[:, 2]] + self.p["tri"][x[:, 3]]
        return {"e": e, **{s: e @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"}}

    def forward(self, x: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Scores of windows, and what backward() needs."""
        p, m = self.p, len(start)
        g = self.gates(x)
        t_max = int(length.max()) if m else 0
        state = np.zeros((t_max, m, 2 * HIDDEN), np.float32)
        saved: dict = {"e": g["e"], "steps": {"f": [], "b": []}}
        for s, at in (("f", 0), ("b", HIDDEN)):
            h = np.zeros((m, HIDDEN), np.float32)
            u = p[f"u{s}"]
            for t in range(t_max) if s == "f" else range(t_max - 1, -1, -1):
                live = t < length
                row = start + np.minimum(t, length - 1)
                a, b = g[s][row], h @ u
                zr = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
                z = np.where(live[:, None], z, np.float32(1))
                if keep:
                    saved["steps"][s].append((t, live, row, h, z, r, new, b[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                state[t, :, at : at + HIDDEN] = h
        k = np.tanh(state @ p["wa"] + p["ca"])
        score = np.where(np.arange(t_max)[:, None] < length[None, :], k @ p["va"], -1e9)
        alpha = np.exp(score - score.max(axis=0)) if t_max else score
        alpha /= np.maximum(alpha.sum(axis=0), 1e-30)
        pooled = (alpha[:, :, None] * state).sum(axis=0)
        out = _sigmoid(pooled @ p["wo"] + p["co"])
        return out, saved | {"state": state, "k": k, "alpha": alpha, "pooled": pooled, "out": out} if keep else {}

    def backward(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        """Gradients of the weighted mean log loss."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((s["out"] - y) * weight / weight.sum()).astype(np.float32)
        g["wo"], g["co"] = s["pooled"].T @ d, d.sum(keepdims=True)
        d_pool = d[:, None] * p["wo"]
        d_state = s["alpha"][:, :, None] * d_pool
        d_alpha = (s["state"] * d_pool).sum(axis=2)
        d_score = s["alpha"] * (d_alpha - (s["alpha"] * d_alpha).sum(axis=0))
        g["va"] = np.einsum("tmh,tm->h", s["k"], d_score)
        d_k = d_score[:, :, None] * p["va"] * (1 - s["k"] ** 2)
        g["wa"], g["ca"] = np.einsum("tmi,tmh->ih", s["state"], d_k), d_k.sum(axis=(0, 1))
        d_state = d_state + d_k @ p["wa"].T
        d_e = np.zeros_like(s["e"])
        for side, at in (("f", 0), ("b", HIDDEN)):
            u, d_h = p[f"u{side}"], np.zeros((len(y), HIDDEN), np.float32)
            for t, live, row, h, z, r, new, bn in reversed(s["steps"][side]):
                d_h = d_h + d_state[t, :, at : at + HIDDEN]
                d_new = d_h * (1 - z) * (1 - new**2)
                d_z = d_h * (h - new) * z * (1 - z) * live[:, None]
                d_r = d_new * bn * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new], axis=1)
                d_b = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"u{side}"] += h.T @ d_b
                g[f"c{side}"] += d_a.sum(axis=0)
                g[f"w{side}"] += s["e"][row].T @ d_a
                d_x = d_a @ p[f"w{side}"].T
                d_e[row[live]] += d_x[live]  # windows of a batch hold distinct words
                d_h = d_h * z + d_b @ u.T
        np.add.at(g["word"], x[:, 0], d_e)
        for k in (1, 2, 3):
            np.add.at(g["tri"], x[:, k], d_e)
        return g

    def score_texts(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The highest window's score of each text; 0 for texts without words."""
        start, length, doc = windows(bounds)
        out = np.zeros(len(bounds) - 1)
        for s in range(0, len(start), 8192):
            score, _ = self.forward(x[start[s] : start[min(s + 8192, len(start)) - 1] + WINDOW], start[s : s + 8192] - start[s], length[s : s + 8192])
            np.maximum.at(out, doc[s : s + 8192], score.astype(np.float64))
        return out


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """A network from the inputs of labelled texts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    n = len(y)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    pair = np.unique(doc.astype(np.int64) * WORDS + x[:, 0])
    word, owner = pair % WORDS, pair // WORDS
    bad, good = (np.bincount(word[y[owner] == v], minlength=WORDS) for v in (1, 0))
    odds = np.log((bad + 1) / (y.sum() + 2)) - np.log((good + 1) / (n - y.sum() + 2))
    known = bad + good >= LEAST_TEXTS
    net.p["word"][known] = rng.standard_normal((int(known.sum()), SIZE)) * 0.02
    net.p["word"][known, 0] += np.clip(odds[known], -4, 6) * 0.5
    start, length, of = windows(bounds)
    if not len(start) or y.min() == y.max():
        net.p["co"][:] = 4.0 if n and y.min() == 1 else -4.0
        return net
    top = np.array([net.p["word"][x[a : a + k, 0], 0].max() for a, k in zip(start, length, strict=True)])
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            top = np.concatenate([net.forward(x[start[s] : start[min(s + 4096, len(start)) - 1] + WINDOW], start[s : s + 4096] - start[s], length[s : s + 4096])[0] for s in range(0, len(start), 4096)])
        best = np.lexsort((top, of))
        best = best[np.append(of[best][1:] != of[best][:-1], True)]
        other = rng.choice(len(start), min(len(start), n), replace=False)
        chosen = np.concatenate([best, other[y[of[other]] == 0]])
        rng.shuffle(chosen)
        share = y.mean()
        for s in range(0, len(chosen), BATCH):
            w = chosen[s : s + BATCH]
            lens = length[w]
            rows = np.concatenate([np.arange(a, a + k) for a, k in zip(start[w], lens, strict=True)])
            xb, at = x[rows], np.cumsum(lens) - lens
            yb = y[of[w]].astype(np.float32)
            _, saved = net.forward(xb, at, lens, keep=True)
            grads = net.backward(xb, yb, np.where(yb == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32), saved)
            grads["word"][~known] = 0
            step += 1
            for k, v in grads.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id") -> Network:
    """A network trained on at most MOST_LABELLED labelled rows (of SAMPLE_BYTES bytes at most), none of them held out."""
    ship(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text_slices(b):
                x, at = inputs(data, off)
                yield pa.RecordBatch.from_arrays([b.column("y")[i:j], pa.array([x[a:c].tobytes() for a, c in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["y", "x"])

    rows = training_rows(docs, labels, label, MOST_LABELLED, text, id_col).mapInArrow(coded, "y int, x binary").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.x)))  # the same network, however the tasks end
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.int32).reshape(-1, 4)
    bounds = np.concatenate([[0], np.cumsum([len(r.x) // 16 for r in rows])]).astype(np.int64)
    return train(x, bounds, np.array([r.y for r in rows], np.int64)) if rows else Network()


def _scored(docs: DataFrame, network: Network, names: list[str], text: str) -> DataFrame:
    """The named columns of docs and __score."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(network)
    plain = docs.select(*[F.col(f"`{c}`") for c in names], *([] if text in names else [F.col(f"`{text}`")]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            for i, j, data, off in text_slices(b, text):
                s = net.score_texts(*inputs(data, off))
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in b.columns[: len(names)]], pa.array(s)], names=[*names, "__score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(names)])
    return plain.mapInArrow(scored, f"{ddl}, __score double")


def score(docs: DataFrame, network: Network, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of each row's whole text.

    Texts without words, null ones too, score 0.  Of equally high windows either
    gives the score.  All windows of a text of any length are read.  Null ids and repeated rows
    keep a row each; other columns are dropped unless named in keep.
    """
    names = [id_col, *[c for c in keep or [] if c != id_col]]
    out = _scored(docs, network, names, text)
    return out.select(f"`{id_col}`", held_out(f"`{id_col}`").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), *[F.col(f"`{c}`") for c in names if c != id_col])


def chosen(docs: DataFrame, network: Network, predicted: int, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns whatever these are called, for which :func:`score` predicts a value."""
    out = _scored(docs, network, docs.columns, text)
    return out.where((F.col("__score") >= THRESHOLD) == F.lit(predicted == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])
