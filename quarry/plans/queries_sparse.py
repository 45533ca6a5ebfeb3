"""Queries over sparse rows in long form: components above zero of ``embeddings``, words of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import sparse
from quarry.plans.queries_columns import read
from quarry.plans.queries_metrics import EMB, XS, Query, embeddings

Q: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns that words are hashed to.
BUCKETS = 30_000
#: A hash that both engines know.
_HASH = f"(('0x' || substr(md5(term), 1, 8))::bigint % {BUCKETS})::int"


def _items(spark, d):
    """The components above zero of each vector, the others being zeros, with its class y."""
    e = embeddings(spark, d).select("row_id", (F.col("label") > 4).cast("double").alias("y"), *[F.greatest(x, F.lit(0.0)).alias(x) for x in XS])
    return e, sparse.SparseRows.from_dense(e, XS)


#: i holds the zeros too: row, y, column number k, value v.
_I = f"{EMB}, i as (select row_id as row, (label > 4)::int::double as y, unnest(range({len(XS)}))::int as k, greatest(unnest(x), 0) as v from t)"
Q["sparse_rows"] = lambda spark, d: _items(spark, d)[1].check().cells.groupBy("index").agg(F.count("*").alias("nnz"), F.round(F.sum("value"), 6).alias("total"))
SQL["sparse_rows"] = f"with {_I} select k as index, sum((v <> 0)::int)::bigint as nnz, round(sum(v), 6) as total from i group by k"


def _dense(spark, d):
    e, x = _items(spark, d)
    moment = F.aggregate(F.zip_with("values", F.sequence(F.lit(1), F.lit(len(XS))), lambda v, k: v * k), F.lit(0.0), lambda a, b: a + b)
    return x.to_dense(e).select("row", F.round(moment, 6).alias("moment"))


Q["sparse_to_dense"] = _dense
SQL["sparse_to_dense"] = f"with {_I} select row, round(sum((k + 1) * v), 6) as moment from i group by row"
Q["sparse_select_rows"] = lambda spark, d: _items(spark, d)[1].select_rows(_items(spark, d)[0].where("y = 1")).cells.groupBy("row").agg(F.count("*").alias("nnz"))
SQL["sparse_select_rows"] = f"with {_I} select row, count(*) as nnz from i where y = 1 and v <> 0 group by row"


def _bayes(name, make, weights, score, prior=True):
    """weights: w of a class and a column, from the sums of its cells (tw: their sum); score: of a cell."""

    def q(spark, d):
        t, x = _items(spark, d)
        return make().fit(x, t, "y").joint(x, t).select("row", F.round("j0", 5).alias("j0"), F.round("j1", 5).alias("j1"))

    Q[name] = q
    first = "(select ln(count(*) / (select count(*) from i)) from i where y = {0})" if prior else "0"
    SQL[name] = f"with {_I}, g as (select y, k, count(*) as n, sum(v) as s, sum((v > 0.05)::int) as o, avg(v) as m, var_pop(v) as q from i group by all), h as (select k, sum(s) as r from g group by k), e as (select 1e-3 * max(q) as eps from (select var_pop(v) as q from i group by k)), m as (select y, k, {weights} from g join h using (k), e), mt as (select *, sum(w) over (partition by y) as tw from m), j as (select row, mt.y, sum({score}) as s from i join mt using (k) group by all) select row, " + ", ".join(f"round({first.format(c)} + sum(s) filter (y = {c}), 5) as j{c}" for c in (0, 1)) + " from j group by row"


_bayes("sparse_multinomial_nb", sparse.SparseMultinomialNB, "ln((s + 1) / sum(s + 1) over (partition by y)) as w", "v * w")
_bayes("sparse_complement_nb", sparse.SparseComplementNB, "-ln((r - s + 1) / sum(r - s + 1) over (partition by y)) as w", "v * w", prior=False)
_bayes("sparse_complement_nb_norm", lambda: sparse.SparseComplementNB(norm=True), "ln((r - s + 1) / sum(r - s + 1) over (partition by y)) as w", "v * w / tw", prior=False)
_bayes("sparse_bernoulli_nb", lambda: sparse.SparseBernoulliNB(binarize=0.05), "(o + 1) / (n + 2) as w", "case when v > 0.05 then ln(w) else ln(1 - w) end")
_bayes("sparse_gaussian_nb", lambda: sparse.SparseGaussianNB(var_smoothing=1e-3), "m, q + eps as w", "-0.5 * (ln(2 * pi() * w) + (v - m) * (v - m) / w)")


def _words(spark, d):
    """Word counts in BUCKETS columns, and the rows with label 1 for English."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("y"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    terms = docs.select(F.col("row_id").alias("row"), F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    index = (F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")
    return docs, sparse.SparseRows(terms.groupBy("row", index.alias("index")).agg(F.count("*").alias("value")), BUCKETS)


def _text_nb(spark, d):
    docs, x = _words(spark, d)
    return sparse.SparseMultinomialNB().fit(x, docs, "y").joint(x, docs).select("row", F.round(F.col("j1") - F.col("j0"), 4).alias("log_odds"))


Q["sparse_text_nb"] = _text_nb
SQL["sparse_text_nb"] = rf"""with l as (select doc_id as row, (coalesce(lang, '') = 'en')::int as y, lower(coalesce(text, '')) as text from documents), w as (select row, y, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]{{2,}}')) as term from l),
c as (select row, y, {_HASH} as index, count(*)::double as n from w group by all), f as (select index, sum(n) filter (y = 1) as s1, sum(n) filter (y = 0) as s0 from c group by index), t as (select sum(s1) + {BUCKETS} as t1, sum(s0) + {BUCKETS} as t0 from f),
p as (select ln(sum(y) / sum(1 - y)) as p from l), s as (select row, sum(n * (ln((coalesce(s1, 0) + 1) / t1) - ln((coalesce(s0, 0) + 1) / t0))) as s from c join f using (index), t group by row) select l.row, round(p + coalesce(s, 0), 4) as log_odds from l left join s on s.row = l.row, p"""
