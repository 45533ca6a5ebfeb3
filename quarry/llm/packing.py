"""Operator 3: optimal length buckets and token-budget batches.

The lengths of all rows go to one histogram of the exact lengths: n of them take
n * n / 2 tokens at least, so it stays small.  Dynamic programming over it, by divide
and conquer, finds the bucket boundaries for which the padding of every row to its
bucket's boundary is least in total.  In a bucket, rows form batches in the order
of their ids; a batch holds as many rows as the token budget allows at the padded
length, one at least.

The order within a bucket is made without gathering it: rows are dealt by ranges of
(bucket, id, length, slot), where the slot is the row's own number, so no bucket and no
id, null ids among them, has to fit one task.  The sorted rows are written with
their places, and the rows of the ranges before are added.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import ship, stash

BUCKETS, BUDGET = 8, 16384
#: Bits of a row's place within its partition.
PLACE_BITS = 33


def boundaries(bins: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The least-padding boundaries: a choice of `buckets` of the bins (all, if fewer), the last among them.

    bins: ascending padded lengths with rows; counts: their rows.  Of equal
    choices, the one with the smaller boundaries, from the last but one on back.
    """
    m = len(bins)
    if not m:
        return []
    before = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    cost = before[1:] * bins  # one bucket up to each bin
    back = []
    for k in range(1, min(buckets, m)):
        cost, least = _one_more(cost, before, bins, k)
        back.append(least)
    at, out = m - 1, [m - 1]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return [int(bins[i]) for i in reversed(out)]


def _one_more(cost: np.ndarray, before: np.ndarray, bins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs up to each bin from the k-th on with k boundaries before it, and the last of these.

    The least choice for a bin is never before that for a smaller bin, so the choice
    for the middle bin of an interval bounds those of both halves; all intervals of
    one depth are done at once.
    """
    m = len(bins)
    out, least = np.zeros(m, np.int64), np.zeros(m, np.int64)
    low, high, first, last = (np.array([x]) for x in (k, m - 1, k - 1, m - 2))
    while len(low):
        mid = (low + high) // 2
        end = np.minimum(last, mid - 1)
        size = end - first + 1
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        i = np.arange(size.sum()) + np.repeat(first - at, size)
        j = np.repeat(mid, size)
        value = cost[i] + (before[j + 1] - before[i + 1]) * bins[j]
        best = np.minimum.reduceat(value, at)
        spot = np.minimum.reduceat(np.where(value == np.repeat(best, size), i, m), at)
        out[mid], least[mid] = best, spot
        low, high, first, last = np.concatenate([low, mid + 1]), np.concatenate([mid - 1, high]), np.concatenate([first, spot]), np.concatenate([spot, last])
        some = low <= high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return out, least


def pack(lengths: DataFrame, id_col: str = "doc_id", length: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """id, length, bucket (from 0), pad_to and batch (from 0 in each bucket) of each row.

    Null and negative lengths count as 0, and a row of length 0 is padded to 1 at least.  Null ids
    come last; rows of one id go by length; rows of equal id and length may change
    places.  One id, or null, may have any share of the rows.  An empty table gives an empty result; other columns
    are dropped.
    """
    ship(lengths.sparkSession)
    rows = lengths.select(F.col(f"`{id_col}`").alias(id_col), F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0)).alias(length))
    rows = stash(rows.withColumn("__slot", F.monotonically_increasing_id()), "lengths")  # read several times, made once
    bins = sorted((r.pad, r.n) for r in rows.groupBy(F.greatest(F.lit(1), length).alias("pad")).agg(F.count("*").alias("n")).collect())
    edges = boundaries(np.array([b for b, _ in bins], np.int64), np.array([n for _, n in bins], np.int64), buckets) or [1]
    bucket = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col(length) <= edges[i], i).otherwise(bucket)
    order = ["__bucket", F.col(id_col).asc_nulls_last(), length, "__slot"]
    dealt = rows.withColumn("__bucket", bucket.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stash(dealt.withColumn("__place", F.monotonically_increasing_id()).drop("__slot"), "ordered")
    dealt = dealt.withColumn("__part", F.shiftright("__place", PLACE_BITS)).withColumn("__place", F.col("__place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    runs = dealt.groupBy("__bucket", "__part").agg(F.count("*").alias("n"), F.min("__place").alias("__first"))  # a row for each bucket in each partition
    before = F.sum("n").over(W.partitionBy("__bucket").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("__bucket", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__move"))
    out = dealt.join(runs, ["__bucket", "__part"]).withColumn("__pad", F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("__bucket") + 1))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("__pad")))
    batch = F.floor((F.col("__place") + F.col("__move")) / room).cast("long")
    return out.select(id_col, length, F.col("__bucket").alias("bucket"), F.col("__pad").alias("pad_to"), batch.alias("batch"))


def words(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and n_tokens: the number of words [^\\x20\\x09-\\x0D]+ of each whole text; null texts have none."""
    parts = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "[\\x20\\x09-\\x0D]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return docs.select(F.col(f"`{id_col}`").alias(id_col), (F.size(parts) - ends).cast("long").alias("n_tokens"))


def oracle(table: str = "documents", buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    steps = "".join(
        f"""
, d{k} as (
  select b.i, min({{'c': p.c + (b.before - a.before) * b.pad, 'j': p.i}}) as best
  from (select i, {'c' if k == 2 else 'best.c as c'} from d{k - 1}) p join bins a on a.i = p.i join bins b on b.i > p.i group by b.i
)"""
        for k in range(2, buckets + 1)
    )
    path = f"w{buckets} as (select max(i) as i from bins)" + "".join(f", w{k - 1} as (select best.j as i from d{k} join w{k} using (i))" for k in range(buckets, 1, -1))
    return f"""
with l as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from {table}
), p as (
  select doc_id, n_tokens, greatest(1, n_tokens)::bigint as pad from l
), bins as (
  select row_number() over (order by pad) as i, pad, sum(n) over (order by pad)::bigint as before
  from (select pad, count(*) as n from p group by pad)
), d1 as (
  select i, before * pad as c from bins
){steps}, {path}
, edges as (
  select row_number() over (order by pad) - 1 as bucket, pad as pad_to
  from bins join ({" union all ".join(f"select i from w{k}" for k in range(1, buckets + 1))}) using (i)
), placed as (
  select doc_id, n_tokens, min({{'b': bucket, 'p': pad_to}}) as e from p join edges on pad_to >= pad group by doc_id, n_tokens, pad
), ranked as (
  select doc_id, n_tokens, e.b::int as bucket, e.p as pad_to, row_number() over (partition by e.b order by doc_id, n_tokens) - 1 as nth from placed
)
select doc_id, n_tokens, bucket, pad_to, (nth // greatest(1, {budget} // pad_to))::bigint as batch from ranked
"""
