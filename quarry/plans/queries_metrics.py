"""Queries of the metrics, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import metrics as M

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Labels y (0, 1, 2) and guesses p, a binary label b with guess g and score s, a number v with estimate e."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    q = F.col("l_quantity")
    return t.select(
        F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("y"),
        F.pmod(F.col("l_linenumber"), F.lit(3)).cast("double").alias("p"),
        (F.col("l_linestatus") == "F").cast("double").alias("b"),
        (q > 25).cast("double").alias("g"),
        (q / 50).alias("s"),
        ((50 - q) / 50).alias("s2"),
        (q * 10 % 7 / 7).alias("s3"),
        F.col("l_extendedprice").alias("v"),
        (q * 1500).alias("e"),
    )


T = """t as (select case l_returnflag when 'A' then 0.0::double when 'N' then 1.0 else 2.0 end as y, (l_linenumber % 3)::double as p,
  (l_linestatus = 'F')::int::double as b, (l_quantity > 25)::int::double as g, l_quantity / 50 as s, (50 - l_quantity) / 50 as s2, (l_quantity * 10 % 7) / 7 as s3,
  l_extendedprice as v, l_quantity * 1500 as e from lineitem)"""


def one(name: str, make: Callable[[DataFrame], DataFrame], select: str, ctes: str = "") -> None:
    """A query of one rounded value; select gives it over t."""
    Q[name] = lambda spark, d: make(lineitem(spark, d)).select(F.round("value", 6).alias("value"))
    SQL[name] = f"with {T}{ctes} select round({select}, 6) as value" + ("" if " from " in f" {select.split('~')[0]} " and select.startswith("(select") else " from t")


PER = """, c as (select c, sum(t) as t, sum(p) as p, sum(h) as h from (select y as c, 1 as t, 0 as p, (y = p)::int as h from t union all select p, 0, 1, 0 from t) group by c),
m as (select c, t, case when p > 0 then h / p else 0 end as pr, case when t > 0 then h / t else 0 end as re from c),
f as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end as f1 from m)"""

one("accuracy_score", lambda t: M.accuracy_score(t, "p", "y"), "avg((p = y)::int)")
one("precision_score", lambda t: M.precision_score(t, "g", "b"), "sum((g = 1 and b = 1)::int) / sum((g = 1)::int)")
one("precision_score_macro", lambda t: M.precision_score(t, "p", "y", "macro"), "(select avg(pr) from f)", PER)
one("recall_score", lambda t: M.recall_score(t, "g", "b"), "sum((g = 1 and b = 1)::int) / sum((b = 1)::int)")
one("recall_score_macro", lambda t: M.recall_score(t, "p", "y", "macro"), "(select avg(re) from f)", PER)
one("f1_score", lambda t: M.f1_score(t, "g", "b"), "2 * sum((g = 1 and b = 1)::int) / (sum((g = 1)::int) + sum((b = 1)::int))")
one("f1_score_macro", lambda t: M.f1_score(t, "p", "y", "macro"), "(select avg(f1) from f)", PER)
Q["precision_recall_fscore_support"] = lambda spark, d: M.precision_recall_fscore_support(lineitem(spark, d), "p", "y").select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
SQL["precision_recall_fscore_support"] = f"with {T}{PER} select c as label, round(pr, 6) as precision, round(re, 6) as recall, round(f1, 6) as f1, t::bigint as support from f"
Q["confusion_matrix"] = lambda spark, d: M.confusion_matrix(lineitem(spark, d), "p", "y")
SQL["confusion_matrix"] = f"with {T} select y as label, p as prediction, count(*) as n from t group by all"
Q["classification_report"] = lambda spark, d: M.classification_report(lineitem(spark, d), "p", "y").select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
SQL["classification_report"] = f"""with {T}{PER}, n as (select sum(t)::bigint as n from f), r as (
select c::varchar as label, pr, re, f1, t::bigint as support from f union all select 'macro avg', avg(pr), avg(re), avg(f1), any_value(n) from f, n
union all select 'weighted avg', sum(pr * t) / sum(t), sum(re * t) / sum(t), sum(f1 * t) / sum(t), any_value(n) from f, n
union all select 'accuracy', a, a, a, n from (select avg((p = y)::int) as a from t), n)
select label, round(pr, 6) as precision, round(re, 6) as recall, round(f1, 6) as f1, support from r"""
one("balanced_accuracy_score", lambda t: M.balanced_accuracy_score(t, "p", "y"), "(select avg(r) from (select avg((p = y)::int) as r from t group by y))")
one("balanced_accuracy_score_adjusted", lambda t: M.balanced_accuracy_score(t, "p", "y", True), "(select (avg(r) - 1 / count(*)) / (1 - 1 / count(*)) from (select avg((p = y)::int) as r from t group by y))")
one("matthews_corrcoef", lambda t: M.matthews_corrcoef(t, "p", "y"), "(select (sum(h) * sum(t) - sum(t * p))::double / sqrt((sum(t)::double * sum(t) - sum(p * p)) * (sum(t)::double * sum(t) - sum(t * t))) from c)", PER)
for _w, _d in (("", "(i <> j)::int"), ("linear", "abs(i - j)"), ("quadratic", "(i - j) * (i - j)")):
    one(
        "cohen_kappa_score" + (f"_{_w}" if _w else ""),
        lambda t, w=_w: M.cohen_kappa_score(t, "p", "y", w or None),
        f"(select 1 - sum({_d} * n) * sum(n) / sum({_d} * ra * rb) from cells)",
        """, l as (select c, row_number() over (order by c) as i from (select distinct y as c from t union select distinct p from t)),
cells as (select a.i, b.i as j, coalesce(n, 0)::double as n, coalesce(ra, 0)::double as ra, coalesce(rb, 0)::double as rb from l a cross join l b
 left join (select p, y, count(*) as n from t group by all) x on x.p = a.c and x.y = b.c left join (select p, count(*) as ra from t group by all) u on u.p = a.c left join (select y, count(*) as rb from t group by all) w on w.y = b.c)""",
    )
one("hinge_loss", lambda t: M.hinge_loss(t.withColumn("d", F.col("s") * 4 - 2), "b", "d"), "avg(greatest(0, 1 - (2 * b - 1) * (s * 4 - 2)))")
one("brier_score_loss", lambda t: M.brier_score_loss(t, "b", "s"), "avg((s - b) ** 2)")
one("log_loss", lambda t: M.log_loss(t.withColumn("r", 1 - F.col("s")), "b", ["r", "s"], [0.0, 1.0]), "avg(-ln(least(greatest(case when b = 1 then s else 1 - s end, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))")
BYS = ", z as (select s, sum(b) as pos, sum(1 - b) as neg from t group by s), k as (select s, pos, neg, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp from z)"
_r = lambda *names: [F.round(c, 6).alias(c) for c in names]
Q["roc_curve"] = lambda spark, d: M.roc_curve(lineitem(spark, d), "b", "s").select(*_r("threshold", "fpr", "tpr"))
SQL["roc_curve"] = f"with {T}{BYS} select round(s, 6) as threshold, round(fp / (select sum(neg) from k), 6) as fpr, round(tp / (select sum(pos) from k), 6) as tpr from k union all select 'inf'::double, 0, 0"
Q["precision_recall_curve"] = lambda spark, d: M.precision_recall_curve(lineitem(spark, d), "b", "s").select(*_r("threshold", "precision", "recall"))
SQL["precision_recall_curve"] = f"with {T}{BYS} select round(s, 6) as threshold, round(tp / (tp + fp), 6) as precision, round(tp / (select sum(pos) from k), 6) as recall from k"
one("roc_auc_score", lambda t: M.roc_auc_score(t, "b", "s"), "(select 1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)) from k)", BYS)
_auc = lambda rows, s, c: f"(select (sum(case when y = {c} then r end) - n1 * (n1 + 1) / 2) / (n1 * (count(*) - n1)) from (select y, (rank() over (order by {s}) + (count(*) over (partition by {s}) - 1) / 2) as r, sum((y = {c})::int) over () as n1 from t where {rows}) group by n1)"
one("roc_auc_score_ovr", lambda t: M.roc_auc_multiclass(t, "y", ["s", "s2", "s3"], [0.0, 1.0, 2.0]), "(select (" + " + ".join(_auc("true", s, c) for c, s in enumerate(("s", "s2", "s3"))) + ") / 3)")
one("roc_auc_score_ovo", lambda t: M.roc_auc_multiclass(t, "y", ["s", "s2", "s3"], [0.0, 1.0, 2.0], "ovo"), "(select (" + " + ".join(_auc(f"y in ({a}, {b})", ("s", "s2", "s3")[c], c) for a, b in ((0, 1), (0, 2), (1, 2)) for c in (a, b)) + ") / 6)")

one("mean_squared_error", lambda t: M.mean_squared_error(t, "e", "v"), "avg((e - v) ** 2)")
one("root_mean_squared_error", lambda t: M.root_mean_squared_error(t, "e", "v"), "sqrt(avg((e - v) ** 2))")
one("mean_absolute_error", lambda t: M.mean_absolute_error(t, "e", "v"), "avg(abs(e - v))")
one("mean_absolute_percentage_error", lambda t: M.mean_absolute_percentage_error(t, "e", "v"), "avg(abs(e - v) / greatest(abs(v), 2.220446049250313e-16))")
one("median_absolute_error", lambda t: M.median_absolute_error(t, "e", "v"), "median(abs(e - v))")
one("mean_squared_log_error", lambda t: M.mean_squared_log_error(t, "e", "v"), "avg((ln(1 + e) - ln(1 + v)) ** 2)")
one("explained_variance_score", lambda t: M.explained_variance_score(t, "e", "v"), "1 - var_pop(e - v) / var_pop(v)")
one("max_error", lambda t: M.max_error(t, "e", "v"), "max(abs(e - v))")
one("r2_score", lambda t: M.r2_score(t, "e", "v"), "1 - sum((e - v) ** 2) / (var_pop(v) * count(*))")

PAIRS = ", n as (select y, p, count(*)::double as n from t group by all), s as (select sum(n) as n, sum(n * n) as cells, (select sum(s * s) from (select sum(n) as s from n group by y)) as r, (select sum(s * s) from (select sum(n) as s from n group by p)) as c from n)"
one("adjusted_rand_score", lambda t: M.adjusted_rand_score(t, "y", "p"), "(select ((cells - n) / 2 - x) / ((r + c - 2 * n) / 4 - x) from (select *, (r - n) / 2 * (c - n) / 2 / (n * (n - 1) / 2) as x from s))", PAIRS)
one("rand_score", lambda t: M.rand_score(t, "y", "p"), "(select (n * (n - 1) / 2 + (cells - n) - (r - n) / 2 - (c - n) / 2) / (n * (n - 1) / 2) from s)", PAIRS)
one("fowlkes_mallows_score", lambda t: M.fowlkes_mallows_score(t, "y", "p"), "(select (cells - n) / sqrt((r - n) * (c - n)) from s)", PAIRS)
INFO = """, n as (select y, p, count(*)::double as n from t group by all), h as (select n, sum(n) over () as t, sum(n) over (partition by y) as r, sum(n) over (partition by p) as c from n),
i as (select sum(n / t * ln(n * t / (r * c))) as mi, -sum(n / t * ln(r / t)) as ha, -sum(n / t * ln(c / t)) as hb from h)"""
one("mutual_info_score", lambda t: M.mutual_info_score(t, "y", "p"), "(select mi from i)", INFO)
for _a, _s in (("arithmetic", "(ha + hb) / 2"), ("min", "least(ha, hb)"), ("geometric", "sqrt(ha * hb)"), ("max", "greatest(ha, hb)")):
    one(f"normalized_mutual_info_score_{_a}", lambda t, a=_a: M.normalized_mutual_info_score(t, "y", "p", a), f"(select mi / ({_s}) from i)", INFO)
one("homogeneity_score", lambda t: M.homogeneity_score(t, "y", "p"), "(select mi / ha from i)", INFO)
one("completeness_score", lambda t: M.completeness_score(t, "y", "p"), "(select mi / hb from i)", INFO)
one("v_measure_score", lambda t: M.v_measure_score(t, "y", "p"), "(select 2 * mi / (ha + hb) from i)", INFO)
one(
    "adjusted_mutual_info_score",
    lambda t: M.adjusted_mutual_info_score(t, "y", "p"),
    "(select (mi - e) / ((ha + hb) / 2 - e) from i, emi)",
    INFO
    + """, m as (select distinct r from h), w as (select distinct c from h), tt as (select max(t) as n from h),
x as (select r, c, n, unnest(range(greatest(1, r + c - n)::bigint, least(r, c)::bigint + 1)) as k from (select y, sum(n) as r from n group by y), (select p, sum(n) as c from n group by p), tt),
emi as (select sum(k / n * ln(n * k / (r * c)) * exp(lgamma(r + 1) + lgamma(c + 1) + lgamma(n - r + 1) + lgamma(n - c + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r - k + 1) - lgamma(c - k + 1) - lgamma(n - r - c + k + 1))) as e from x)""",
)


#: Components of the vectors of the table embeddings, all of which are columns.
DIMENSIONS = 64


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMENSIONS)])


EMB = "t as (select vec_id as row_id, label::double as label, list_transform(embedding, lambda x: x::double) as x from embeddings)"
XS = [f"x{i}" for i in range(DIMENSIONS)]
Q["silhouette_samples"] = lambda spark, d: M.silhouette_samples(embeddings(spark, d), XS, "label").select("row", F.round("value", 6).alias("value"))
_SIL = f"""with {EMB}, m as (select a.row_id as row, a.label as k, b.label as k2, avg(list_distance(a.x, b.x)) as d from t a join t b on a.row_id <> b.row_id group by all),
g as (select row, max(case when k = k2 then d end) as a, min(case when k <> k2 then d end) as b from m group by row),
r as (select row, case when a is null then 0 else (b - a) / greatest(a, b) end as value from g)"""
SQL["silhouette_samples"] = _SIL + " select row, round(value, 6) as value from r"
Q["silhouette_score"] = lambda spark, d: M.silhouette_score(embeddings(spark, d), XS, "label").select(F.round("value", 6).alias("value"))
SQL["silhouette_score"] = _SIL + " select round(avg(value), 6) as value from r"
_CEN = f"with {EMB}, c as (select label, count(*)::double as n, [{', '.join(f'avg(x[{i + 1}])' for i in range(DIMENSIONS))}] as m, {' + '.join(f'var_pop(x[{i + 1}])' for i in range(DIMENSIONS))} as v from t group by label)"
Q["davies_bouldin_score"] = lambda spark, d: M.davies_bouldin_score(embeddings(spark, d), XS, "label").select(F.round("value", 6).alias("value"))
SQL["davies_bouldin_score"] = _CEN + ", s as (select c.label, c.m, avg(list_distance(t.x, c.m)) as s from t join c using (label) group by all), r as (select a.label, max((a.s + b.s) / list_distance(a.m, b.m)) as r from s a join s b on a.label <> b.label group by all) select round(avg(r), 6) as value from r"
Q["calinski_harabasz_score"] = lambda spark, d: M.calinski_harabasz_score(embeddings(spark, d), XS, "label").select(F.round("value", 6).alias("value"))
_BET = " + ".join(f"(sum(n * m[{i}] ** 2) - sum(n * m[{i}]) ** 2 / sum(n))" for i in range(1, DIMENSIONS + 1))
SQL["calinski_harabasz_score"] = _CEN + f" select round(({_BET}) * (sum(n) - count(*)) / (sum(n * v) * (count(*) - 1)), 6) as value from c"
