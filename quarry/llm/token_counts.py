"""Operator 8: token counts of whole texts under a byte-level BPE vocabulary.

Arrow functions cut long texts at safe boundaries, gather the pieces to batches of
about BATCH_BYTES bytes each, have the vocabulary's own library encode a batch at
once, and return lengths only.  Special strings inside texts are handled by
the library, as its default has it.

A boundary is safe before white space that follows a character which is none: a
pre-token of the byte-level pattern never holds white space after another
character, and whether white space belongs to the word after it doesn't depend on
what stands before.  Where a vocabulary's file asks for anything else (a
normaliser, another pre-tokeniser, a leading space, added strings that hold or take in
white space), texts are not cut.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import require, ship

#: Characters from which on a piece ends at the next safe boundary, and bytes of one batch.
PIECE_CHARS = 1 << 14
BATCH_BYTES = 1 << 18
_CUT = re.compile(r"(?<=\S)(?=[\x20\n\t])")


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text whose token counts add up to that of the whole."""
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def _library(vocabulary: str):
    """The vocabulary's tokeniser, and whether texts may be cut for it."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.no_truncation()
    library.no_padding()
    with open(vocabulary, encoding="utf-8") as f:
        asked = json.load(f)
    before = asked.get("pre_tokenizer") or {}
    plain = asked.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return library, plain and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in asked.get("added_tokens", []))


def balanced(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of pieces of about `most` bytes each; a larger piece ends its run."""
    first = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


def count_tokens(texts: list[str], vocabulary: str) -> list[int]:
    """Tokens of each text: the library's own counts, without begin, end or padding."""
    library, cut = _library(vocabulary)
    work, owner = [], []
    for i, text in enumerate(texts):
        for piece in pieces(text) if cut else [text]:
            work.append(piece)
            owner.append(i)
    out = [0] * len(texts)
    for run in balanced([len(p.encode()) for p in work]):
        for i, coded in zip(owner[run], library.encode_batch_fast(work[run], add_special_tokens=False), strict=True):
            out[i] += len(coded)
    return out


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row's whole text.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows
    stay, one row each; an empty table gives an empty result; other columns
    are dropped, whatever their names.  A very long text is counted in pieces; a
    run without a safe boundary (one kind of character, or white space alone) is one
    piece whatever its length, and takes the library's memory for its tokens.
    """
    ship(df.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(count_tokens(texts, vocabulary), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    plain = require(df, id_col, text)
    kind = plain.schema[0].dataType.simpleString()
    out = plain.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
