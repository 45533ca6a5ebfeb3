"""Queries of statistics, scalers, encoders, imputers, splitters, text, Naive Bayes and linear models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import distances as D
from quarry.operators import bayes, feature_selection, linear, model_selection, preprocessing as P, text
from quarry.plans.queries_metrics import Query

Q: dict[str, Query] = {}
SQL: dict[str, str] = {}
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def read(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df, *cols, n=6):
    return df.select(*[F.round(F.col(f"`{c}`"), n).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes if not cols or c in cols])


# --- statistics and distances ----------------------------------------------------------

for _n, _c, _s in [
    ("stat_sum", lambda: D.total("l_quantity"), "sum(l_quantity)"),
    ("stat_expected", lambda: D.expected("l_quantity"), "avg(l_quantity)"),
    ("stat_mean", lambda: D.mean("l_discount"), "avg(l_discount)"),
    ("stat_variance", lambda: D.variance("l_quantity", 1000), "var_pop(l_quantity) * count(*) / 1000"),
    ("stat_covariance", lambda: D.covariance("l_quantity", "l_extendedprice"), "covar_pop(l_quantity, l_extendedprice)"),
    ("stat_var_sample", lambda: D.var_sample("l_quantity"), "var_samp(l_quantity)"),
    ("stat_sd_sample", lambda: D.sd_sample("l_quantity"), "stddev_samp(l_quantity)"),
    ("stat_var_population", lambda: D.var_population("l_quantity"), "var_pop(l_quantity)"),
    ("stat_sd_population", lambda: D.sd_population("l_quantity"), "stddev_pop(l_quantity)"),
]:
    Q[_n] = lambda spark, d, c=_c: read(spark, d, "lineitem").agg(F.round(c(), 4).alias("value"))
    SQL[_n] = f"select round({_s}, 4) as value from lineitem"
Q["stat_mode"] = lambda spark, d: D.mode(read(spark, d, "part"), "p_size", "p_partkey").select(F.col("value").cast("long").alias("value"))
SQL["stat_mode"] = "select p_size::bigint as value from (select p_size, count(*) as n, min(p_partkey) as f from part group by 1 order by n desc, f limit 1)"
Q["stat_frequencies_to_probabilities"] = lambda spark, d: rounded(D.frequencies_to_probabilities(read(spark, d, "part"), "p_brand"))
SQL["stat_frequencies_to_probabilities"] = "select p_brand, round(count(*)::double / (select count(*) from part), 6) as p from part group by 1"
Q["stat_entropy"] = lambda spark, d: rounded(D.entropy(read(spark, d, "part"), "p_brand"))
SQL["stat_entropy"] = "select round(-sum(p * log2(p)), 6) as value from (select count(*)::double / (select count(*) from part) as p from part group by p_brand)"
Q["stat_gini"] = lambda spark, d: rounded(D.gini(read(spark, d, "part"), "p_brand"))
SQL["stat_gini"] = "select round(1 - sum(p * p), 6) as value from (select count(*)::double / (select count(*) from part) as p from part group by p_brand)"


def _centre_distance(make):
    def q(spark, d):
        e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        first = e.where("vec_id = 0").select(F.col("v").alias("w"))
        return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(make(F.col("v"), F.col("w")), 6).alias("value"))

    return q


_E = "e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), f as (select v as w from e where vec_id = 0)"
for _n, _c, _s in [
    ("distance_manhattan", D.manhattan, "list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - w[i])))"),
    ("distance_euclidean", D.euclidean, "list_distance(v, w)"),
    ("distance_minkowski", lambda a, b: D.minkowski(a, b, 3), "pow(list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(abs(v[i] - w[i]), 3))), 1.0 / 3)"),
]:
    Q[_n] = _centre_distance(_c)
    SQL[_n] = f"with {_E} select vec_id, round({_s}, 6) as value from e, f"
Q["transpose"] = lambda spark, d: D.transpose(read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "value"))).select(F.col("i").cast("long").alias("i"), "j", F.round(F.col("value").cast("double"), 6).alias("value"))
SQL["transpose"] = "select k as i, vec_id as j, round(embedding[k + 1]::double, 6) as value from embeddings, range(64) t(k)"

# --- scalers ----------------------------------------------------------------------------


def scaled(name, make, forms, table="lineitem", cols=COLS, keys=("l_orderkey", "l_linenumber"), stats="", inverse=False):
    """forms: SQL for each column, with {c}, its statistics as m, s, lo, hi and so on from `stats`."""

    def q(spark, d):
        df = read(spark, d, table).select(*keys, *cols)
        t = make().fit(df, list(cols))
        out = t.transform(df)
        return rounded(t.inverse_transform(out) if inverse else out)

    Q[name] = q
    body = ", ".join(f"round({forms.format(c=c)}, 6) + 0 as {c}" for c in cols)
    agg = ", ".join(stats.format(c=c) for c in cols)
    SQL[name] = (f"with s as (select {agg} from {table}) " if stats else "") + f"select {', '.join(keys)}, {body} from {table}" + (", s" if stats else "")


scaled("standard_scaler", lambda: P.StandardScaler(), "({c} - m_{c}) / s_{c}", stats="avg({c}) as m_{c}, stddev_pop({c}) as s_{c}")
scaled("standard_scaler_inverse", lambda: P.StandardScaler(), "{c}", inverse=True)
scaled("min_max_scaler", lambda: P.MinMaxScaler(), "({c} - l_{c}) / (h_{c} - l_{c})", stats="min({c}) as l_{c}, max({c}) as h_{c}")
scaled("max_abs_scaler", lambda: P.MaxAbsScaler(), "{c} / h_{c}", stats="max(abs({c})) as h_{c}")
scaled("robust_scaler", lambda: P.RobustScaler(), "({c} - q_{c}[2]) / (q_{c}[3] - q_{c}[1])", stats="quantile_cont({c}, [0.25, 0.5, 0.75]) as q_{c}")
for _n, _s in (("l1", " + ".join(f"abs({c})" for c in COLS)), ("l2", "sqrt(" + " + ".join(f"{c} * {c}" for c in COLS) + ")"), ("max", f"greatest({', '.join(f'abs({c})' for c in COLS)})")):
    scaled(f"normalizer_{_n}", lambda n=_n: P.Normalizer(norm=n), "{c} / (" + _s + ")")
scaled("binarizer", lambda: P.Binarizer(threshold=0.05), "({c} > 0.05)::int::double")
scaled("function_transformer", lambda: P.FunctionTransformer(func="log1p", inverse_func="expm1"), "ln(1 + {c})")
scaled("k_bins_discretizer_uniform", lambda: P.KBinsDiscretizer(n_bins=4), " + ".join("({c} >= l_{c} + (h_{c} - l_{c}) * " + str(k) + " / 4)::int::double" for k in (1, 2, 3)), stats="min({c}) as l_{c}, max({c}) as h_{c}", cols=["c_acctbal"], table="customer", keys=("c_custkey",))
scaled("k_bins_discretizer_quantile", lambda: P.KBinsDiscretizer(n_bins=4, strategy="quantile"), " + ".join("({c} >= q_{c}[" + str(k) + "])::int::double" for k in (1, 2, 3)), stats="quantile_cont({c}, [0.25, 0.5, 0.75]) as q_{c}", cols=["c_acctbal"], table="customer", keys=("c_custkey",))
Q["quantile_transformer"] = lambda spark, d: rounded(P.QuantileTransformer(n_quantiles=5).fit(read(spark, d, "customer"), ["c_acctbal"]).transform(read(spark, d, "customer").select("c_custkey", "c_acctbal")))
SQL["quantile_transformer"] = """with q as (select quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) as q from customer), i as (select c_custkey, c_acctbal as x, q, case when c_acctbal >= q[4] then 4 when c_acctbal >= q[3] then 3 when c_acctbal >= q[2] then 2 else 1 end as k from customer, q)
select c_custkey, round((k - 1 + (x - q[k]) / (q[k + 1] - q[k])) / 4, 6) as c_acctbal from i"""
Q["polynomial_features"] = lambda spark, d: rounded(P.PolynomialFeatures().fit(read(spark, d, "lineitem"), ["l_quantity", "l_tax"]).transform(read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax")))
SQL["polynomial_features"] = 'select l_orderkey, l_quantity, l_tax, 1.0::double as "1", round(l_quantity ** 2, 6) as "l_quantity^2", round(l_quantity * l_tax, 6) as "l_quantity l_tax", round(l_tax ** 2, 6) as "l_tax^2" from lineitem'
Q["variance_threshold"] = lambda spark, d: rounded(P.VarianceThreshold(threshold=1.0).fit(read(spark, d, "lineitem"), COLS).transform(read(spark, d, "lineitem").select("l_orderkey", *COLS)))
SQL["variance_threshold"] = "select l_orderkey, l_quantity, l_extendedprice from lineitem"
Q["norm_cdf"] = lambda spark, d: read(spark, d, "customer").select("c_custkey", F.round(P.norm_cdf(F.col("c_acctbal") / 5000), 5).alias("value"))
SQL["norm_cdf"] = """with z as (select c_custkey, c_acctbal / 5000 / sqrt(2) as z from customer), t as (select *, 1 / (1 + 0.3275911::double * abs(z)) as t from z)
select c_custkey, round(0.5 * (1 + sign(z) * (1 - (((((1.061405429::double * t - 1.453152027::double) * t) + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-z * z))), 5) as value from t"""

# --- encoders and imputers ----------------------------------------------------------------

LI = "l_orderkey, l_linenumber"
_li = lambda spark, d, *c: read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *c)
Q["label_encoder"] = lambda spark, d: P.LabelEncoder().fit(_li(spark, d, "l_returnflag"), "l_returnflag").transform(_li(spark, d, "l_returnflag"))
SQL["label_encoder"] = f"select {LI}, (dense_rank() over (order by l_returnflag) - 1)::double as l_returnflag from lineitem"
Q["ordinal_encoder"] = lambda spark, d: P.OrdinalEncoder().fit(_li(spark, d, "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"]).transform(_li(spark, d, "l_returnflag", "l_linestatus"))
SQL["ordinal_encoder"] = f"select {LI}, (dense_rank() over (order by l_returnflag) - 1)::double as l_returnflag, (dense_rank() over (order by l_linestatus) - 1)::double as l_linestatus from lineitem"
Q["one_hot_encoder"] = lambda spark, d: P.OneHotEncoder(drop="first").fit(_li(spark, d, "l_returnflag"), ["l_returnflag"]).transform(_li(spark, d, "l_returnflag"))
SQL["one_hot_encoder"] = f"select {LI}, l_returnflag, (l_returnflag = 'N')::int::double as l_returnflag_N, (l_returnflag = 'R')::int::double as l_returnflag_R from lineitem"
Q["label_binarizer"] = lambda spark, d: P.LabelBinarizer().fit(_li(spark, d, "l_returnflag"), "l_returnflag").transform(_li(spark, d, "l_returnflag"))
SQL["label_binarizer"] = f"select {LI}, l_returnflag, (l_returnflag = 'A')::int::double as l_returnflag_A, (l_returnflag = 'N')::int::double as l_returnflag_N, (l_returnflag = 'R')::int::double as l_returnflag_R from lineitem"


def _multi(spark, d):
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return P.MultiLabelBinarizer().fit(t, "f").transform(t).drop("f")


Q["multi_label_binarizer"] = _multi
SQL["multi_label_binarizer"] = "select l_orderkey, max((l_returnflag = 'A')::int)::double as f_A, max((l_returnflag = 'N')::int)::double as f_N, max((l_returnflag = 'R')::int)::double as f_R from lineitem group by 1"
Q["target_encoder"] = lambda spark, d: rounded(P.TargetEncoder().fit(_li(spark, d, "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice").transform(_li(spark, d, "l_returnflag", "l_extendedprice")), n=4)
SQL["target_encoder"] = f"""with g as (select avg(l_extendedprice) as gm, var_pop(l_extendedprice) as gv from lineitem), c as (select l_returnflag as k, count(*) as n, avg(l_extendedprice) as m, var_pop(l_extendedprice) as v from lineitem group by 1),
e as (select k, gv * n / (gv * n + v) as a, m, gm from c, g) select {LI}, round(a * m + (1 - a) * gm, 4) as l_returnflag, round(l_extendedprice, 4) as l_extendedprice from lineitem join e on k = l_returnflag"""


def _gaps(spark, d):
    """c_acctbal with gaps where negative."""
    return read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"))


G = "g as (select c_custkey, case when c_acctbal >= 0 then c_acctbal end as a, c_nationkey::double as b from customer)"
for _s, _e in (("mean", "avg(a)"), ("median", "median(a)"), ("constant", "0.0::double")):
    Q[f"simple_imputer_{_s}"] = lambda spark, d, s=_s: rounded(P.SimpleImputer(strategy=s).fit(_gaps(spark, d), ["a"]).transform(_gaps(spark, d)))
    SQL[f"simple_imputer_{_s}"] = f"with {G} select c_custkey, round(coalesce(a, (select {_e} from g limit 1)), 6) as a, b from g"
Q["simple_imputer_most_frequent"] = lambda spark, d: rounded(P.SimpleImputer(strategy="mostFrequent").fit(_gaps(spark, d), ["a"]).transform(_gaps(spark, d)))
SQL["simple_imputer_most_frequent"] = f"with {G} select c_custkey, round(coalesce(a, (select a from g where a is not null group by a order by count(*) desc, a limit 1)), 6) as a, b from g"
Q["missing_indicator"] = lambda spark, d: P.MissingIndicator().fit(_gaps(spark, d), ["a", "b"]).transform(_gaps(spark, d))
SQL["missing_indicator"] = f"with {G} select c_custkey, a, b, (a is null)::int::double as a_missing from g"
_knn = lambda spark, d: read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
Q["knn_imputer"] = lambda spark, d: rounded(P.KNNImputer(n_neighbors=3).fit(_knn(spark, d), ["a", "b"], "s_suppkey").transform(_knn(spark, d)))
SQL["knn_imputer"] = """with g as (select s_suppkey, case when s_acctbal >= 0 then s_acctbal end as a, s_nationkey::double as b from supplier),
p as (select x.s_suppkey as k, y.a as v, row_number() over (partition by x.s_suppkey order by sqrt((x.b - y.b) ** 2 * 2), y.s_suppkey) as r from g x join g y on x.a is null and y.a is not null),
f as (select k, avg(v) as v from p where r <= 3 group by k) select s_suppkey, round(coalesce(a, v), 6) as a, b from g left join f on k = s_suppkey"""

# --- splitters -----------------------------------------------------------------------------

_part = lambda spark, d: read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
NTH = "n as (select *, row_number() over (order by p_partkey) - 1 as i, count(*) over () as c from part)"
Q["train_test_split"] = lambda spark, d: model_selection.train_test_split(_part(spark, d), "p_partkey", shuffle=False).select("p_partkey", "part")
SQL["train_test_split"] = f"with {NTH} select p_partkey, case when i < c - ceil(c * 0.25) then 'train' else 'test' end as part from n"
Q["k_fold"] = lambda spark, d: model_selection.KFold(n_splits=7).assign(_part(spark, d), "p_partkey").select("p_partkey", "fold")
SQL["k_fold"] = f"with {NTH} select p_partkey, case when i < (c % 7) * (c // 7 + 1) then i // (c // 7 + 1) else (c % 7) + (i - (c % 7) * (c // 7 + 1)) // (c // 7) end::int as fold from n"
Q["stratified_k_fold"] = lambda spark, d: model_selection.StratifiedKFold(n_splits=2).assign(_part(spark, d), "p_partkey", "p_brand").select("p_partkey", "fold")
SQL["stratified_k_fold"] = "select p_partkey, ((row_number() over (partition by p_brand order by p_partkey) - 1) % 2)::int as fold from part"
Q["time_series_split"] = lambda spark, d: model_selection.TimeSeriesSplit(n_splits=3).parts(read(spark, d, "events").select("event_id", "ts"), "event_id").select("event_id", "split", "part")
SQL["time_series_split"] = "with n as (select event_id, row_number() over (order by event_id) - 1 as i, count(*) over () as c from events), s as (select s::int as split from range(3) t(s)) select event_id, split, case when i < c - (3 - split) * (c // 4) then 'train' else 'test' end as part from n, s where i < c - (2 - split) * (c // 4)"
Q["leave_one_out"] = lambda spark, d: model_selection.LeaveOneOut().assign(read(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
SQL["leave_one_out"] = "select s_suppkey, row_number() over (order by s_suppkey) - 1 as fold from supplier"
Q["group_k_fold"] = lambda spark, d: model_selection.GroupKFold(n_splits=3).assign(_part(spark, d), "p_partkey", groups="p_brand").groupBy("fold").agg(F.countDistinct("p_brand").alias("groups"), F.count("*").alias("n"))
for _n, _m, _kw in (("stratified_group_k_fold", "StratifiedGroupKFold", {"label": "p_size", "groups": "p_brand"}),):
    Q[_n] = lambda spark, d, m=_m, kw=_kw: getattr(model_selection, m)(n_splits=3).assign(_part(spark, d), "p_partkey", **kw).groupBy("fold").count()
Q["shuffle_split"] = lambda spark, d: model_selection.ShuffleSplit(n_splits=2).parts(_part(spark, d), "p_partkey").groupBy("split", "part").count()
SQL["shuffle_split"] = "with c as (select count(*) as c from part) select s::int as split, p as part, case p when 'test' then ceil(c * 0.1) else c - ceil(c * 0.1) end::bigint as count from c, range(2) t(s), (values ('train'), ('test')) v(p)"
Q["stratified_shuffle_split"] = lambda spark, d: model_selection.StratifiedShuffleSplit(n_splits=2).parts(_part(spark, d), "p_partkey", "p_brand").groupBy("split", "part").count()
SQL["stratified_shuffle_split"] = SQL["shuffle_split"]
Q["group_shuffle_split"] = lambda spark, d: model_selection.GroupShuffleSplit(n_splits=2).parts(_part(spark, d), "p_partkey", groups="p_brand").groupBy("split", "part").agg(F.countDistinct("p_brand").alias("groups"))
SQL["group_shuffle_split"] = "with c as (select count(distinct p_brand) as c from part) select s::int as split, p as part, case p when 'test' then ceil(c * 0.2) else c - ceil(c * 0.2) end::bigint as groups from c, range(2) t(s), (values ('train'), ('test')) v(p)"
Q["repeated_k_fold"] = lambda spark, d: model_selection.RepeatedKFold(n_splits=4, n_repeats=2).assign_repeats(_part(spark, d), "p_partkey").groupBy("repeat", "fold").count()
SQL["repeated_k_fold"] = "with c as (select count(*) as c from part) select r::int as repeat, f::int as fold, (c // 4 + (f < c % 4)::int)::bigint as count from c, range(2) t(r), range(4) u(f)"
Q["repeated_stratified_k_fold"] = lambda spark, d: model_selection.RepeatedStratifiedKFold(n_splits=4, n_repeats=2).assign_repeats(_part(spark, d), "p_partkey", "p_brand").groupBy("repeat", "fold").count()
SQL["repeated_stratified_k_fold"] = "with c as (select p_brand, count(*) as c from part group by 1) select r::int as repeat, f::int as fold, sum(c // 4 + (f < c % 4)::int)::bigint as count from c, range(2) t(r), range(4) u(f) group by all"

# --- text ------------------------------------------------------------------------------------

_docs = lambda spark, d: read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
TOK = r"tok as (select doc_id as row, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) as term from documents), cnt as (select row, term, count(*) as n from tok group by all), nd as (select count(*) as nd from documents)"
VOC = ", df as (select term, count(*) as df from cnt group by term having count(*) >= 5), voc as (select term, df, (row_number() over (order by term) - 1)::int as index from df)"


def _count(spark, d):
    df = _docs(spark, d)
    return text.CountVectorizer(min_df=5).fit(df, "text").transform(df)


Q["count_vectorizer"] = _count
SQL["count_vectorizer"] = f"with {TOK}{VOC} select row, term, index, n from cnt join voc using (term)"
Q["tfidf_transformer"] = lambda spark, d: text.TfidfTransformer().fit(_count(spark, d), 1000).transform(_count(spark, d)).select("row", "term", F.round("value", 6).alias("value"))
_TF = f"with {TOK}{VOC}, w as (select row, term, n * (ln((1 + {{nd}}) / (1 + df)::double) + 1) as v from cnt join voc using (term)) select row, term, round(v / sqrt(sum(v * v) over (partition by row)), 6) as value from w"
SQL["tfidf_transformer"] = _TF.replace("{nd}", "1000")


def _tfidf(spark, d):
    df = _docs(spark, d)
    return text.TfidfVectorizer(min_df=5).fit(df, "text").transform(df).select("row", "term", F.round("value", 6).alias("value"))


Q["tfidf_vectorizer"] = _tfidf
SQL["tfidf_vectorizer"] = _TF.replace("{nd}", "(select nd from nd)")
def _ngrams(spark, d):
    df = _docs(spark, d)
    return text.CountVectorizer(ngram_range=(2, 2), min_df=20).fit(df, "text").transform(df)


_BI = r"lst as (select doc_id as row, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') as w from documents), tok as (select row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from lst where len(w) >= 2), cnt as (select row, term, count(*) as n from tok group by all), nd as (select count(*) as nd from documents)" + VOC.replace(">= 5", ">= 20")
Q["count_vectorizer_ngrams"] = _ngrams
SQL["count_vectorizer_ngrams"] = f"with {_BI} select row, term, index, n from cnt join voc using (term)"
Q["tfidf_ngrams"] = lambda spark, d: text.TfidfVectorizer(ngram_range=(2, 2), min_df=20).fit(_docs(spark, d), "text").transform(_docs(spark, d)).select("row", "term", F.round("value", 6).alias("value"))
SQL["tfidf_ngrams"] = f"with {_BI}, w as (select row, term, n * (ln((1 + (select nd from nd)) / (1 + df)::double) + 1) as v from cnt join voc using (term)) select row, term, round(v / sqrt(sum(v * v) over (partition by row)), 6) as value from w"
Q["hashing_vectorizer"] = lambda spark, d: text.HashingVectorizer(n_features=1024).transform(_docs(spark, d), "text").select("row", "index", F.round("value", 6).alias("value"))
Q["murmur_hash3"] = lambda spark, d: read(spark, d, "part").select("p_partkey", text.murmur3("p_name").alias("h"))
Q["feature_hasher"] = lambda spark, d: text.FeatureHasher(n_features=64).transform(read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")).alias("m")), "m")


def _dicts(spark, d):
    df = read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")).alias("m"))
    return text.DictVectorizer().fit(df, "m").transform(df)


Q["dict_vectorizer"] = _dicts
SQL["dict_vectorizer"] = "with l as (select p_partkey as row, 'brand=' || p_brand as term, 1.0::double as value from part union all select p_partkey, 'size', p_size::double from part), v as (select term, (row_number() over (order by term) - 1)::int as index from (select distinct term from l)) select row, term, index, value from l join v using (term)"

# --- univariate selection, Naive Bayes, linear models ---------------------------------------------


def _features(spark, d):
    """Four columns, a label of three values and a number."""
    return read(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("key"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *COLS, F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("y"), F.col("l_extendedprice").alias("v"),
    )


YC = "case l_returnflag when 'A' then 0.0::double when 'N' then 1.0 else 2.0 end"
_table = lambda spark, names, values: spark.createDataFrame([(n, float(round(v, 4))) for n, v in zip(names, values, strict=True)], "feature string, score double")
Q["f_regression"] = lambda spark, d: _table(spark, ["l_quantity", "l_discount", "l_tax"], feature_selection.f_regression(_features(spark, d), ["l_quantity", "l_discount", "l_tax"], "v"))
SQL["f_regression"] = " union all ".join(f"select '{c}' as feature, round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 4) as score from lineitem" for c in ("l_quantity", "l_discount", "l_tax"))
Q["chi2"] = lambda spark, d: _table(spark, COLS, feature_selection.chi2(_features(spark, d), COLS, "y")[0])
SQL["chi2"] = " union all ".join(f"select '{c}' as feature, round(sum((s - t * n / a) ** 2 / (t * n / a)), 4) as score from (select sum({c}) as s, count(*)::double as n from lineitem group by l_returnflag), (select sum({c}) as t, count(*) as a from lineitem)" for c in COLS)
Q["f_classif"] = lambda spark, d: _table(spark, COLS, feature_selection.f_classif(_features(spark, d), COLS, "y")[0])
SQL["f_classif"] = " union all ".join(f"select '{c}' as feature, round((sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) as score from (select count(*) as n, avg({c}) as m, var_pop({c}) as v from lineitem group by l_returnflag), (select avg({c}) as g from lineitem)" for c in COLS)
Q["mutual_info_classif"] = lambda spark, d: _table(spark, ["l_quantity", "l_discount"], feature_selection.mutual_info_classif(_features(spark, d), ["l_quantity", "l_discount"], "y", True))
SQL["mutual_info_classif"] = " union all ".join(f"select '{c}' as feature, round(sum(n / t * ln(n * t / (r * k))), 4) as score from (select n, sum(n) over () as t, sum(n) over (partition by x) as r, sum(n) over (partition by y) as k from (select {c} as x, l_returnflag as y, count(*)::double as n from lineitem group by all))" for c in ("l_quantity", "l_discount"))
Q["select_k_best"] = lambda spark, d: feature_selection.SelectKBest(k=1).fit(_features(spark, d), ["l_quantity", "l_extendedprice", "l_tax"], "v").transform(_features(spark, d)).select("l_orderkey", "l_extendedprice")
SQL["select_k_best"] = "select l_orderkey, l_extendedprice from lineitem"


def _predicted(make, *fit, cols=("l_orderkey", "l_linenumber", "prediction")):
    def q(spark, d):
        df = _features(spark, d)
        return rounded(make().fit(df, *fit).predict(df).select(*cols), n=4)

    return q


_NB = ["l_quantity", "l_discount", "l_tax"]
Q["gaussian_nb"] = _predicted(bayes.GaussianNB, _NB, "y")
SQL["gaussian_nb"] = f"""with t as (select *, {YC} as y from lineitem), e as (select 1e-9 * greatest({", ".join(f"var_pop({c})" for c in _NB)}) as eps from t),
c as (select y, ln(count(*)::double / (select count(*) from t)) as p, {", ".join(f"avg({c}) as m_{c}, var_pop({c}) + any_value(eps) as v_{c}" for c in _NB)} from t, e group by y),
j as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, c.y, p {"".join(f" - 0.5 * (ln(2 * pi() * v_{c}) + (t.{c} - m_{c}) ** 2 / v_{c})" for c in _NB)} as s from t, c),
r as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice order by s desc, y) as k from j) select l_orderkey, l_linenumber, y as prediction from r where k = 1"""
Q["multinomial_nb"] = lambda spark, d: _params(spark, bayes.MultinomialNB().fit(_features(spark, d), COLS, "y"), "log_prob_")
SQL["multinomial_nb"] = f"with t as (select *, {YC} as y from lineitem), s as (" + " union all ".join(f"select y, {i} as i, sum({c}) + 1 as s from t group by y" for i, c in enumerate(COLS)) + ") select y as label, i::int as feature, round(ln(s) - ln(sum(s) over (partition by y)), 6) as value from s"
Q["complement_nb"] = lambda spark, d: _params(spark, bayes.ComplementNB().fit(_features(spark, d), COLS, "y"), "weights_")
SQL["complement_nb"] = f"with t as (select *, {YC} as y from lineitem), s as (" + " union all ".join(f"select y, {i} as i, (select sum({c}) from t) + 1 - sum({c}) as s from t group by y" for i, c in enumerate(COLS)) + ") select y as label, i::int as feature, round(-ln(s / sum(s) over (partition by y)), 6) as value from s"
Q["bernoulli_nb"] = lambda spark, d: _params(spark, bayes.BernoulliNB(binarize=0.05).fit(_features(spark, d), COLS, "y"), "on_")
SQL["bernoulli_nb"] = f"with t as (select *, {YC} as y from lineitem), s as (" + " union all ".join(f"select y, {i} as i, (sum(({c} > 0.05)::int) + 1) / (count(*) + 2) as s from t group by y" for i, c in enumerate(COLS)) + ") select y as label, i::int as feature, round(ln(s), 6) as value from s"


def _params(spark, model, name):
    m = getattr(model, name)
    return spark.createDataFrame([(float(c), i, round(float(v), 6)) for c, row in zip(model.classes_, m, strict=True) for i, v in enumerate(row)], "label double, feature int, value double")


def _categorical(spark, d):
    df = _features(spark, d).withColumn("a", (F.col("l_linenumber") % 4).cast("double")).withColumn("b", (F.col("l_quantity") % 3).cast("double"))
    m = bayes.CategoricalNB().fit(df, ["a", "b"], "y")
    return spark.createDataFrame([(float(c), i, v, round(float(t[k, v]), 6)) for i, t in enumerate(m.tables_) for k, c in enumerate(m.classes_) for v in range(t.shape[1])], "label double, feature int, category int, value double")


Q["categorical_nb"] = _categorical
SQL["categorical_nb"] = f"with t as (select {YC} as y, (l_linenumber % 4)::int as a, (l_quantity % 3)::int as b from lineitem), g as (" + " union all ".join(f"select y, {i} as i, v, (select count(*) from t where t.y = k.y and t.{c} = v) + 1 as n from (select distinct y from t) k, (select distinct {c} as v from t)" for i, c in enumerate("ab")) + ") select y as label, i::int as feature, v as category, round(ln(n) - ln(sum(n) over (partition by y, i)), 6) as value from g"

_REGR = "regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b"
Q["linear_regression"] = _predicted(linear.LinearRegression, ["l_quantity"], "v")
SQL["linear_regression"] = f"with r as (select {_REGR} from lineitem) select l_orderkey, l_linenumber, round(a * l_quantity + b, 4) as prediction from lineitem, r"
_RID = "with s as (select covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + {a}) as a, avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem) select l_orderkey, l_linenumber, round(a * (l_quantity - mx) + my, 4) as prediction from lineitem, s"
Q["ridge_regression"] = _predicted(lambda: linear.RidgeRegression(alpha=1000.0), ["l_quantity"], "v")
SQL["ridge_regression"] = _RID.format(a="1000")
Q["ridge"] = _predicted(lambda: linear.Ridge(alpha=10.0), ["l_quantity"], "v")
SQL["ridge"] = _RID.format(a="10")
_LAS = "with s as (select greatest(abs(covar_pop(l_quantity, l_extendedprice)) - {l1}, 0) * sign(covar_pop(l_quantity, l_extendedprice)) / (var_pop(l_quantity) + {l2}) as a, avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem) select l_orderkey, l_linenumber, round(a * (l_quantity - mx) + my, 4) as prediction from lineitem, s"
Q["lasso_regression"] = _predicted(lambda: linear.LassoRegression(alpha=5000.0), ["l_quantity"], "v")
SQL["lasso_regression"] = _LAS.format(l1=5000, l2=0)
Q["lasso"] = _predicted(lambda: linear.Lasso(alpha=100.0), ["l_quantity"], "v")
SQL["lasso"] = _LAS.format(l1=100, l2=0)
Q["elastic_net"] = _predicted(lambda: linear.ElasticNet(alpha=100.0, l1_ratio=0.5), ["l_quantity"], "v")
SQL["elastic_net"] = _LAS.format(l1=50, l2=50)
Q["ridge_classifier"] = _predicted(lambda: linear.RidgeClassifier(alpha=1.0), ["l_quantity"], "y")
SQL["ridge_classifier"] = f"""with t as (select *, {YC} as y from lineitem), k as (select distinct y as c from t), m as (select c, avg(case when y = c then 1.0::double else -1 end) as my, covar_pop(l_quantity, case when y = c then 1.0::double else -1 end) * count(*) / (var_pop(l_quantity) * count(*) + 1) as a, avg(l_quantity) as mx from t, k group by c),
q as (select l_quantity, max_by(c, a * (l_quantity - mx) + my) as prediction from (select distinct l_quantity from t), m group by 1) select l_orderkey, l_linenumber, prediction from t join q using (l_quantity)"""
Q["polynomial_regression"] = _predicted(lambda: linear.PolynomialRegression(degree=1), ["l_quantity"], "v")
SQL["polynomial_regression"] = SQL["linear_regression"]


def _logistic(spark, d):
    df = _features(spark, d).withColumn("x", F.col("l_quantity") / 50).withColumn("t", (F.col("y") == 2).cast("double"))
    m = linear.LogisticRegression(max_iter=3).fit(df, ["x"], "t")
    return spark.createDataFrame([(round(float(m.coef_[0]), 6), round(float(m.intercept_[0]), 6))], "coef double, intercept double")


Q["logistic_regression"] = _logistic
_ls = "".join(f", g{k} as (select any_value(w) - 0.1 * avg(x * (1 / (1 + exp(-(w * x + b))) - t)) as w, any_value(b) - 0.1 * avg(1 / (1 + exp(-(w * x + b))) - t) as b from t, g{k - 1})" for k in (1, 2, 3))
SQL["logistic_regression"] = f"with t as (select l_quantity / 50 as x, (l_returnflag = 'R')::int::double as t from lineitem), g0 as (select 0.0::double as w, 0.0::double as b){_ls} select round(w, 6) as coef, round(b, 6) as intercept from g3"
