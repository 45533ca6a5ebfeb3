"""Operator 1: SentencePiece encoding and decoding.

Unigram segmentation: of all ways to write a text as pieces, the one with the largest
sum of log scores (of equal ones, the one with the longest last piece, and so on
back), found by Viterbi over the pieces that a double-array trie gives at each
position.  A character without a piece of its own costs
UNKNOWN below the least score and is written as byte pieces.  A text gets a leading
white-space marker, and each space becomes one; decoding turns markers back,
joins byte pieces to characters and drops the leading one.

Work is done by numpy for a slice of texts at once: texts are cut before each
marker that follows another character (no piece crosses such a place; a
vocabulary with pieces that do is refused), and each distinct part is segmented
once.  The trie is walked from all positions at once, a byte at a time.  Parts are then
cut wherever no piece that was found crosses, which leaves the best way as it is, so
text without spaces falls into short parts too.  The Viterbi step runs over all parts
at once, a position at a time; parts of more than LONG bytes go one by one.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import require, ship, span_hashes, text_slices

#: Fixed-point steps of a log score's unit.
POINT = 1 << 24
#: How far below the least piece score a character without a piece is.
UNKNOWN = 10.0
MARK, MARK_BYTES = "▁", "▁".encode()
#: Bytes of text that are segmented at once.
SLICE = 1 << 19
#: Bytes from which on a part is walked by itself.
LONG = 256


class DoubleArray:
    """A trie of byte strings: the child of state s for byte b is base[s] + b, if check there is s."""

    def __init__(self, keys: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for value, key in enumerate(keys):
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            ends.setdefault(node, value)
        size = 256 * 2 + 2 * len(children)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, todo, free, crowd = {0: 0}, [0], 1, 1
        while todo:
            node = todo.pop()
            s = place[node]
            if node in ends:
                value[s] = ends[node]
            kids = children[node]
            if not kids:
                base[s] = 0
                continue
            codes = sorted(kids)
            if len(codes) == 1:
                while used[free]:
                    free += 1
                b = free - codes[0]
                if b < 1:
                    b = used.index(0, codes[0] + 1) - codes[0]
            else:  # nodes of many children from a mark that moves on where the array is dense
                b, tries = crowd, 0
                while any(used[b + c] for c in codes):
                    b, tries = b + 1, tries + 1
                    if b + 512 >= len(used):
                        used += bytearray(len(used))
                if tries > 16:
                    crowd = b
            while b + 512 >= len(base):
                used += bytearray(max(0, 2 * len(base) - len(used)))
                grow = len(base)
                base, check, value = (np.concatenate([x, np.full(grow, v, np.int32)]) for x, v in ((base, 0), (check, -1), (value, -1)))
            base[s] = b
            for c in codes:
                used[b + c] = 1
                check[b + c] = s
                place[kids[c]] = b + c
                todo.append(kids[c])
        self.base, self.check, self.value = base, check, value

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[states] + data
        to = np.where(to < len(self.check), to, 0)
        return np.where(self.check[to] == states, to, -1)


class Pieces:
    """A vocabulary: pieces with log scores, byte pieces, and the trie of the former."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]) -> None:
        """pieces: all, by id; scores: NaN for what isn't matched (control, unknown and byte pieces); byte_ids: ids of the 256 byte pieces."""
        self.text = [p.replace(MARK, " ").encode() for p in pieces]
        self.scores = np.array(scores, np.float32)
        self.ids = np.flatnonzero(~np.isnan(self.scores))
        keys = [self.text[i] for i in self.ids]
        if any(b" " in k.lstrip(b" ") for k in keys):
            raise ValueError("a piece holds a white-space marker after another character")
        self.trie = DoubleArray(keys)
        self.byte_ids = np.array(byte_ids, np.int32)
        # fixed-point scores: sums are exact, so equal ways are known as equal
        self.points = np.round(np.nan_to_num(self.scores.astype(np.float64)) * POINT).astype(np.int64)
        self.unknown = np.int64(round((float(np.nanmin(self.scores)) - UNKNOWN) * POINT))
        raw = list(self.text)
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        for i in set(range(len(raw))) - set(self.ids.tolist()) - set(byte_ids):
            raw[i] = b""  # control pieces are no text
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def segment(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the parts data[bounds[i]:bounds[i + 1]], one after another, and the number of each part's ids."""
        n, size = len(bounds) - 1, len(data)
        part = np.repeat(np.arange(n), np.diff(bounds))
        end = bounds[1:][part]
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(heads, size))
        # a truncated character can't be: texts are valid UTF-8, and parts begin at characters
        at, states, alone = heads, np.zeros(len(heads), np.int64), np.zeros(size, bool)
        step, found = 0, []
        char = np.zeros(size, np.int64)
        char[heads] = width
        while len(at):
            nxt = self.trie.step(states, data[at + step])
            ok = nxt >= 0
            at, states = at[ok], nxt[ok]
            step += 1
            v = self.trie.value[states]
            hit = v >= 0
            if hit.any():
                start, ids = at[hit], self.ids[v[hit]]
                found.append((start, np.full(len(start), step), ids))
                alone[start[char[start] == step]] = True
            go = at + step < end[at]
            at, states = at[go], states[go]
        lone = heads[~alone[heads]]
        found.append((lone, char[lone], np.full(len(lone), -1, np.int64)))
        start, length, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        score = np.where(ids >= 0, self.points[ids], self.unknown)
        # cut where no piece crosses
        crossed = np.zeros(size + 1, np.int64)
        crossed += np.bincount(start + 1, minlength=size + 2)[: size + 1]
        crossed -= np.bincount(start + length, minlength=size + 1)[: size + 1]
        free = heads[np.cumsum(crossed)[heads] == 0]
        outer, bounds = bounds, np.union1d(bounds, free)
        n = len(bounds) - 1
        part = np.repeat(np.arange(n), np.diff(bounds))
        long = np.diff(bounds) > LONG
        alone = long[part[start]] if size else np.zeros(0, bool)
        out = self._walked(bounds, np.flatnonzero(long), part, start[alone], length[alone], ids[alone], score[alone])
        start, length, ids, score = (x[~alone] for x in (start, length, ids, score))
        offset = start - bounds[part[start]]
        order = np.lexsort((length, offset))
        start, length, ids, score, offset = start[order], length[order], ids[order], score[order], offset[order]
        # position p of part i is p + i: every part has one more position than bytes
        best = np.full(size + n, -(1 << 62), np.int64)
        best[bounds[:-1] + np.arange(n)] = 0
        came, which = np.zeros(size + n, np.int64), np.zeros(size + n, np.int64)
        edge = np.flatnonzero((offset[1:] != offset[:-1]) | (length[1:] != length[:-1])) + 1
        edge = np.concatenate([[0], edge, [len(start)]]) if len(start) else np.zeros(1, np.int64)
        source = start + part[start] if size else start
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            s = source[a:b]
            t = s + length[a]
            candidate = best[s] + score[a:b]
            better = candidate > best[t]
            t = t[better]
            best[t], came[t], which[t] = candidate[better], s[better], ids[a:b][better]
        # back from each part's end
        pos, live = bounds[1:] + np.arange(n), np.flatnonzero((np.diff(bounds) > 0) & ~long)
        pos = pos[live]
        nth = 0
        while len(live):
            back = came[pos]
            out.append((live, np.full(len(live), nth), which[pos], back - live, pos - back))
            pos = back
            nth += 1
            go = pos - live > bounds[live]
            live, pos = live[go], pos[go]
        if not out:
            return np.zeros(0, np.int32), np.zeros(len(outer) - 1, np.int64)
        who, nth, ids, at, length = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((-nth, who))
        who, ids, at, length = who[order], ids[order], at[order], length[order]
        many = np.where(ids < 0, length, 1)
        flat = np.repeat(ids, many)
        lost = flat < 0
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
        flat[lost] = self.byte_ids[data[(np.repeat(at, many) + inner)[lost]]]
        whole = np.searchsorted(outer, bounds[:-1], side="right") - 1
        return flat.astype(np.int32), np.bincount(whole[who], weights=many, minlength=len(outer) - 1).astype(np.int64)

    def _walked(self, bounds: np.ndarray, parts: np.ndarray, part: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, score: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """The best way through each long part, as (part, number from the end, id, position, length) of its pieces."""
        order = np.argsort(start, kind="stable")
        start, length, ids, score = start[order], length[order], ids[order], score[order]
        edge = np.searchsorted(part[start], np.append(parts, parts[-1] + 1)) if len(parts) else []
        out = []
        for p, x, y in zip(parts.tolist(), edge[:-1], edge[1:], strict=True):
            first, last = int(bounds[p]), int(bounds[p + 1])
            size = last - first
            best, came = [-(1 << 62)] * (size + 1), [0] * (size + 1)
            best[0] = 0
            froms, sizes, scores = (start[x:y] - first).tolist(), length[x:y].tolist(), score[x:y].tolist()
            for i, (s, k, v) in enumerate(zip(froms, sizes, scores, strict=True)):
                v += best[s]
                if v > best[s + k]:
                    best[s + k], came[s + k] = v, i
            way, at = [], size
            while at:
                way.append(came[at])
                at = froms[came[at]]
            way = np.array(way, np.int64) + x
            out.append((np.full(len(way), p), np.arange(len(way)), ids[way], start[way], length[way]))
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the texts of a slice, one after another, and the number of each text's ids."""
        n = len(offsets) - 1
        raw, parts, count = data.tobytes(), [], []
        for i in range(n):
            t = raw[offsets[i] : offsets[i + 1]].replace(MARK_BYTES, b" ")
            parts.append(b" " + t if t else b"")
            count.append(len(parts[-1]))
        buf, off = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        space = buf == 32
        cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        bounds = np.union1d(np.concatenate([off, cut]), [])
        bounds = bounds.astype(np.int64)
        start, end = bounds[:-1], bounds[1:]
        h = span_hashes(buf, start, end)
        _, first, where = np.unique(h, return_index=True, return_inverse=True)
        sizes = end[first] - start[first]
        ids, many = self.segment(buf[_ranges(start[first], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
        at = np.cumsum(many) - many
        owner = np.searchsorted(off, start, side="right") - 1
        return ids[_ranges(at[where], many[where])], np.bincount(owner, weights=many[where], minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the id lists; bytes that are no UTF-8 become U+FFFD, ids that are no piece are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.size))] if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)) else ids
        size = self.size[ids]
        raw = self.raw[_ranges(self.at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t.removeprefix(" ") for t in texts]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], and so on."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


def vocabulary(path: str) -> Pieces:
    """The pieces of a .model file.

    A unigram model's log scores are taken as they are.  The scores of a BPE
    model are merge ranks, no log scores: its pieces get Zipf's law,
    -ln(rank + 1) less the logarithm of the harmonic sum.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    raw = [sp.get_score(i) for i in range(n)]
    ranks = sorted((i for i in range(n) if plain[i]), key=lambda i: (-raw[i], i))
    scores = [math.nan] * n
    merges = all(float(raw[i]).is_integer() for i in ranks)
    total = math.log(sum(1 / (k + 1) for k in range(len(ranks))))
    for k, i in enumerate(ranks):
        scores[i] = -math.log(k + 1) - total if merges else raw[i]
    return Pieces([sp.id_to_piece(i) for i in range(n)], scores, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])




def _apply(df: DataFrame, pieces: Pieces, text: str, id_col: str, make, ddl: str) -> DataFrame:
    sent = ship(df.sparkSession).sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            for i, j, data, off in text_slices(b, text, SLICE):
                cols = make(p, data, off)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *cols.values()], names=["id", *cols])

    plain = require(df, id_col, text)
    return plain.mapInArrow(run, f"id {plain.schema[0].dataType.simpleString()}, {ddl}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, pieces: Pieces, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and ids (array of int) of each row's whole text.

    Null and empty texts have no pieces; null ids and repeated rows keep a row
    each; an empty table gives an empty result; other columns are dropped.  Texts may be of
    any length.  A text's own U+2581 is a marker like any other, so decoding gives a space for it.
    """

    def make(p: Pieces, data: np.ndarray, off: np.ndarray) -> dict:
        ids, counts = p.encode(data, off)
        return {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))}

    return _apply(df, pieces, text, id_col, make, "ids array<int>")


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id and text of each row's list of ids; null lists give empty texts, null ids in a list are left out."""
    sent = ship(df.sparkSession).sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [[x for x in v or [] if x is not None and 0 <= x < len(sent.value.size)] for v in b.column(1).to_pylist()]
            flat = np.array([x for v in lists for x in v], np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.decode(flat, np.array([len(v) for v in lists], np.int64)), pa.string())], names=["id", "text"])

    plain = require(df, id_col, ids)
    return plain.mapInArrow(run, f"id {plain.schema[0].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def encode_digest(df: DataFrame, pieces: Pieces, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit integers) and restored (decoding gives the text again)."""

    def make(p: Pieces, data: np.ndarray, off: np.ndarray) -> dict:
        ids, counts = p.encode(data, off)
        at = np.concatenate([[0], np.cumsum(counts)])
        is_byte = np.zeros(len(p.size), bool)
        is_byte[p.byte_ids] = True
        lost = np.concatenate([[0], np.cumsum(is_byte[ids])])[at]
        raw, own = ids.astype("<i4").tobytes(), data.tobytes()
        back = p.decode(ids, counts)
        return {
            "n_pieces": pa.array(counts),
            "n_byte_pieces": pa.array(np.diff(lost).astype(np.int64)),
            "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
            "restored": pa.array([t.encode() == own[off[i] : off[i + 1]] for i, t in enumerate(back)]),
        }

    return _apply(df, pieces, text, id_col, make, "n_pieces long, n_byte_pieces long, ids_sha256 string, restored boolean")
