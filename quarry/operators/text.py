"""Text and dictionary features in long form: (row, term, value), aggregated and joined by Spark.

A vocabulary is a DataFrame (term, index); only its size ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.base import BaseEstimator
from quarry.plans.shipping import ship

#: Words of at least two letters, digits or underscores (a fixed pattern).
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: str, lowercase: bool = True, stop_words: tuple = (), ngram_range: tuple = (1, 1)) -> Column:
    c = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(F.lower(c) if lowercase else c, F.lit(TOKEN), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    lo, hi = ngram_range
    if (lo, hi) == (1, 1):
        return words
    # as a lambda's variable the words are split once for a text, not again for each run
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(*[F.when(F.size(w) >= n, _runs(w, n)).otherwise(F.array().cast("array<string>")) for n in range(lo, hi + 1)])))


def _runs(words: Column, n: int) -> Column:
    """All runs of n words.  The function of one parameter gets the element; one of two would get its index too."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))


class CountVectorizer(BaseEstimator):
    """``transform`` gives (row, term, index, n); terms are sorted by code point."""

    params = {"lowercase": True, "stop_words": (), "ngram_range": (1, 1), "min_df": 1, "max_df": 1.0, "max_features": None, "binary": False, "vocabulary": None}

    def _terms(self, df: DataFrame) -> DataFrame:
        t = tokens(self.text_, self.lowercase, tuple(self.stop_words), tuple(self.ngram_range))
        long = df.select(F.col(self.row_).alias("row"), F.explode(t).alias("term")).groupBy("row", "term").agg(F.count("*").alias("n"))
        return long.withColumn("n", F.lit(1).cast("long")) if self.binary else long

    def fit(self, df: DataFrame, text: str, row: str = "row_id"):
        self.text_, self.row_ = text, row
        if self.vocabulary is not None:
            given = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(self.vocabulary)], "term string, index int")
            self._vocabulary = given
            return self
        docs = df.count()
        least = self.min_df * docs if isinstance(self.min_df, float) and self.min_df < 1 else self.min_df
        most = self.max_df * docs if self.max_df <= 1 else self.max_df
        counts = self._terms(df).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).where(F.col("df").between(least, most))
        if self.max_features:
            counts = counts.orderBy(F.desc("total"), "term").limit(self.max_features)
        self._vocabulary = _numbered(counts.select("term"))
        return self

    def vocabulary_frame(self) -> DataFrame:
        return self._vocabulary

    def transform(self, df: DataFrame) -> DataFrame:
        return self._terms(df).join(self._vocabulary, "term").select("row", "term", "index", "n")


def _numbered(terms: DataFrame) -> DataFrame:
    """Terms numbered in order, without one task for all: ranges are numbered apart and then moved by what comes before."""
    part = terms.repartitionByRange(8, "term").sortWithinPartitions("term").select("term", F.spark_partition_id().alias("p"))
    part = part.withColumn("k", F.row_number().over(W.partitionBy("p").orderBy("term")) - 1).persist()
    ahead = part.groupBy("p").count().withColumn("ahead", F.coalesce(F.sum("count").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(ahead), "p").select("term", (F.col("k") + F.col("ahead")).cast("int").alias("index"))


class TfidfTransformer(BaseEstimator):
    """(row, term, index, n) to weights ``value``; idf = ln((docs + s) / (df + s)) + 1."""

    params = {"norm": "l2", "use_idf": True, "smooth_idf": True, "sublinear_tf": False}

    def fit(self, long: DataFrame, n_docs: int | None = None):
        self.n_docs_ = n_docs if n_docs is not None else long.select("row").distinct().count()
        s = float(self.smooth_idf)
        self._idf = long.groupBy("term").agg((F.log((self.n_docs_ + s) / (F.countDistinct("row") + s)) + 1).alias("idf"))
        return self

    def transform(self, long: DataFrame) -> DataFrame:
        tf = F.col("n").cast("double")
        tf = 1 + F.log(tf) if self.sublinear_tf else tf
        t = long.withColumn("value", tf)
        if self.use_idf:
            t = t.join(self._idf, "term").withColumn("value", F.col("value") * F.col("idf")).drop("idf")
        if self.norm:
            v = F.col("value")
            norms = t.groupBy("row").agg((F.sqrt(F.sum(v * v)) if self.norm == "l2" else F.sum(F.abs(v)) if self.norm == "l1" else F.max(F.abs(v))).alias("norm"))
            t = t.join(norms, "row").withColumn("value", F.when(F.col("norm") == 0, 0.0).otherwise(F.try_divide("value", "norm"))).drop("norm")
        return t


class TfidfVectorizer(CountVectorizer):
    params = {"norm": "l2", "use_idf": True, "smooth_idf": True, "sublinear_tf": False}

    def fit(self, df, text, row="row_id"):
        super().fit(df, text, row)
        self._tfidf = TfidfTransformer(norm=self.norm, use_idf=self.use_idf, smooth_idf=self.smooth_idf, sublinear_tf=self.sublinear_tf)
        self._tfidf.fit(CountVectorizer.transform(self, df), df.count())
        return self

    def transform(self, df):
        return self._tfidf.transform(super().transform(df))


def murmur_hash3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, signed (Appleby's public algorithm; its constants are fixed values)."""
    m, h = 0xFFFFFFFF, seed
    whole = len(data) // 4 * 4
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        k = k * 0xCC9E2D51 & m
        k = ((k << 15 | k >> 17) & m) * 0x1B873593 & m
        h ^= k
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    tail = int.from_bytes(data[whole:], "little")
    if whole < len(data):
        k = tail * 0xCC9E2D51 & m
        h ^= ((k << 15 | k >> 17) & m) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3(column) -> Column:
    """The hash of a string column, with a memory of the words seen."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, int] = {}
        for s in batches:
            yield s.map(lambda v: cache[v] if v in cache else cache.setdefault(v, murmur_hash3(v.encode())))

    return run(column)


def hashed_rows(long: DataFrame, n_features: int, alternate_sign: bool = True) -> DataFrame:
    """(row, term, value) to (row, index, value): index = |hash| mod n_features, sign from the hash; sums of 0 go."""
    ship(long.sparkSession)
    t = long.withColumn("h", murmur3("term"))
    sign = F.when(F.col("h") < 0, -1.0).otherwise(1.0) if alternate_sign else F.lit(1.0)
    index = F.pmod(F.abs(F.col("h").cast("long")), F.lit(n_features)).cast("int")
    return t.groupBy("row", index.alias("index")).agg(F.sum(F.col("value") * sign).alias("value")).where("value <> 0")


class HashingVectorizer(BaseEstimator):
    params = {"n_features": 1 << 20, "lowercase": True, "stop_words": (), "ngram_range": (1, 1), "binary": False, "norm": "l2", "alternate_sign": True}

    def transform(self, df: DataFrame, text: str, row: str = "row_id") -> DataFrame:
        t = df.select(F.col(row).alias("row"), F.explode(tokens(text, self.lowercase, tuple(self.stop_words), tuple(self.ngram_range))).alias("term"))
        out = hashed_rows(t.groupBy("row", "term").agg((F.lit(1.0) if self.binary else F.count("*").cast("double")).alias("value")), self.n_features, self.alternate_sign)
        if not self.norm:
            return out
        v = F.col("value")
        n = out.groupBy("row").agg((F.sqrt(F.sum(v * v)) if self.norm == "l2" else F.sum(F.abs(v))).alias("norm"))
        return out.join(n, "row").select("row", "index", (v / F.col("norm")).alias("value"))


class FeatureHasher(BaseEstimator):
    """input_type 'dict' (a map), 'pair' (array of structs name, value) or 'string' (array of strings)."""

    params = {"n_features": 1 << 20, "input_type": "dict", "alternate_sign": True}

    def transform(self, df: DataFrame, column: str, row: str = "row_id") -> DataFrame:
        r = F.col(row).alias("row")
        if self.input_type == "string":
            t = df.select(r, F.explode(column).alias("term")).withColumn("value", F.lit(1.0))
        else:
            kv = df.select(r, F.explode(column)) if self.input_type == "dict" else df.select(r, F.inline(column)).toDF("row", "key", "value")
            num = F.expr("try_cast(value as double)") if dict(kv.dtypes)["value"] == "string" else F.col("value").cast("double")
            t = kv.select("row", F.when(num.isNotNull(), F.col("key")).otherwise(F.concat_ws("=", "key", F.col("value").cast("string"))).alias("term"), F.coalesce(num, F.lit(1.0)).alias("value"))
        return hashed_rows(t, self.n_features, self.alternate_sign)


class DictVectorizer(BaseEstimator):
    """A map of strings to (row, index, value): numbers stay values, other strings become key=value with 1."""

    params = {"separator": "=", "sort": True}

    def _long(self, df: DataFrame) -> DataFrame:
        kv = df.select(F.col(self.row_).alias("row"), F.explode(self.column_))
        num = F.expr("try_cast(value as double)")
        is_num = num.isNotNull()
        term = F.when(is_num, F.col("key")).otherwise(F.concat(F.col("key"), F.lit(self.separator), F.col("value")))
        return kv.select("row", term.alias("term"), F.coalesce(num, F.lit(1.0)).alias("value")).where(~F.isnan("value") & (F.abs("value") < float("inf")))

    def fit(self, df: DataFrame, column: str, row: str = "row_id"):
        self.column_, self.row_ = column, row
        self._vocabulary = _numbered(self._long(df).select("term").distinct())
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._long(df).join(self._vocabulary, "term").select("row", "term", "index", "value")

    def restrict(self, indices: list[int]):
        self._vocabulary = _numbered(self._vocabulary.where(F.col("index").isin(indices)).select("term"))
        return self

    def inverse_transform(self, long: DataFrame) -> DataFrame:
        return long.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "value"))).alias(self.column_))
