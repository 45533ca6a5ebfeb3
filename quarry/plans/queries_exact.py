"""Queries whose result is known in closed form, so that SQL can state it.

Over the whole table ``embeddings`` with all components: a number ``w`` that is exactly linear
in them, which regressors must recover; labels of distinct vectors, which trees grown to the
end and what is made of them must give back.  Over ``lineitem``: models of one feature, whose
optimum is a formula of group sums.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import decomposition, feature_selection, linear, meta, mixture, model_selection, neighbors, preprocessing, svm, trees
from quarry.plans.queries_columns import read
from quarry.plans.queries_metrics import DIMENSIONS, EMB, XS, Query
from quarry.plans.queries_models import labelled

Q: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Coefficients of w: whole numbers from -5 to 5, a few of them much larger.
COEFFICIENTS = [(7 * i + 3) % 11 - 5 + (40 + i if i % 9 == 4 else 0) for i in range(DIMENSIONS)]
W = " + ".join(["3", *(f"{c} * x[{i + 1}]" for i, c in enumerate(COEFFICIENTS))])


def linear_rows(spark, d):
    """labelled() with w, and u = exp(w / 100)."""
    w = sum((F.col(x) * c for x, c in zip(XS, COEFFICIENTS, strict=True)), F.lit(3.0))
    return labelled(spark, d).withColumn("w", w).withColumn("u", F.exp(w / 100))


def recovers(name, make, label="w", value=W, digits=4):
    """A regressor that gives the label back, row by row."""

    def q(spark, d):
        df = linear_rows(spark, d)
        m = make()
        m.fit(df, XS, label)
        return m.predict(df).select("row_id", (F.round("prediction", digits) + F.lit(0.0)).alias("prediction"))

    Q[name] = q
    SQL[name] = f"with {EMB} select row_id, round({value}, {digits}) + 0 as prediction from t"


_stack = lambda: meta.StackingRegressor(estimators=[("a", linear.LinearRegression())], final_estimator=linear.LinearRegression(), cv=2)
for _n, _m in [
    ("linear_regression_recovers", linear.LinearRegression),
    ("ransac_regressor", linear.RANSACRegressor),
    ("transformed_target_regressor", lambda: meta.TransformedTargetRegressor(regressor=linear.LinearRegression())),
    ("voting_regressor", lambda: meta.VotingRegressor(estimators=[("a", linear.LinearRegression()), ("b", linear.RANSACRegressor())])),
    ("stacking_regressor", _stack),
    ("pipeline_scaler_regression", lambda: meta.make_pipeline(preprocessing.StandardScaler(), linear.LinearRegression())),
    ("grid_search_cv", lambda: model_selection.GridSearchCV(estimator=linear.Ridge(), param_grid={"alpha": [0.0, 100.0]}, cv=2)),
    ("huber_regressor", lambda: linear.HuberRegressor(alpha=0.0)),
    ("decision_tree_regressor", trees.DecisionTreeRegressor),
    ("extra_tree_regressor", lambda: trees.ExtraTreeRegressor(random_state=1)),
    ("extra_trees_regressor", lambda: trees.ExtraTreesRegressor(n_estimators=8, random_state=1)),
    ("random_forest_regressor", lambda: trees.RandomForestRegressor(n_estimators=8, bootstrap=False, random_state=1)),
    ("bagging_regressor", lambda: trees.BaggingRegressor(n_estimators=4, bootstrap=False, random_state=1)),
    ("k_neighbors_regressor_one", lambda: neighbors.KNeighborsRegressor(n_neighbors=1)),
]:
    recovers(_n, _m)


def gives_back(name, make, label="label"):
    """A classifier that gives the labels of distinct vectors back."""

    def q(spark, d):
        df = labelled(spark, d)
        m = make()
        m.fit(df, XS, label)
        return m.predict(df).select("row_id", "prediction")

    Q[name] = q
    SQL[name] = f"with {EMB} select row_id, {'label' if label == 'label' else '(label > 4)::int::double'} as prediction from t"


_tree = trees.DecisionTreeClassifier
for _n, _m, _l in [
    ("decision_tree_classifier", _tree, "label"),
    ("extra_tree_classifier", lambda: trees.ExtraTreeClassifier(random_state=1), "label"),
    ("extra_trees_classifier", lambda: trees.ExtraTreesClassifier(n_estimators=8, random_state=1), "label"),
    ("random_forest_classifier_without_bootstrap", lambda: trees.RandomForestClassifier(n_estimators=8, bootstrap=False, random_state=1), "label"),
    ("bagging_classifier", lambda: trees.BaggingClassifier(n_estimators=4, bootstrap=False, random_state=1), "label"),
    ("one_vs_rest_classifier", lambda: meta.OneVsRestClassifier(estimator=_tree()), "label"),
    ("one_vs_one_classifier", lambda: meta.OneVsOneClassifier(estimator=_tree()), "b"),
    ("voting_classifier", lambda: meta.VotingClassifier(estimators=[("a", _tree()), ("b", trees.ExtraTreeClassifier(random_state=1)), ("c", trees.ExtraTreeClassifier(random_state=2))]), "label"),
    ("k_nearest_neighbors_one", lambda: neighbors.KNearestNeighbors(n_neighbors=1), "label"),
    ("svc", lambda: svm.SVC(c=1000.0, kernel="rbf", gamma=1.0), "b"),
]:
    gives_back(_n, _m, _l)


def two(name, make):
    """Two labels at once, given back by trees."""
    Q[name] = lambda spark, d: make().fit(labelled(spark, d), XS, ["b", "label"]).predict(labelled(spark, d)).select("row_id", "prediction_b", "prediction_label")
    SQL[name] = f"with {EMB} select row_id, (label > 4)::int::double as prediction_b, label as prediction_label from t"


two("multi_output_classifier", lambda: meta.MultiOutputClassifier(estimator=_tree()))
two("classifier_chain", lambda: meta.ClassifierChain(estimator=_tree()))
two("multi_output_regressor", lambda: meta.MultiOutputRegressor(estimator=trees.DecisionTreeRegressor()))
two("regressor_chain", lambda: meta.RegressorChain(estimator=trees.DecisionTreeRegressor()))

Q["cross_val_predict"] = lambda spark, d: model_selection.cross_val_predict(linear.LinearRegression(), linear_rows(spark, d), XS, "w", model_selection.KFold(n_splits=2)).select("row_id", (F.round("prediction", 4) + F.lit(0.0)).alias("prediction"))
SQL["cross_val_predict"] = f"with {EMB} select row_id, round({W}, 4) + 0 as prediction from t"
Q["cross_val_score"] = lambda spark, d: spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(model_selection.cross_val_score(linear.LinearRegression(), linear_rows(spark, d), XS, "w", 3))], "fold int, score double")
SQL["cross_val_score"] = "select i::int as fold, 1.0::double as score from range(3) t(i)"
_size = [abs(c) for c in COEFFICIENTS]
_kept = [x for x, s in zip(XS, _size, strict=True) if s >= sum(_size) / len(_size)]
Q["select_from_model"] = lambda spark, d: feature_selection.SelectFromModel(estimator=linear.LinearRegression()).fit(linear_rows(spark, d), XS, "w").transform(linear_rows(spark, d).select("row_id", *XS))
SQL["select_from_model"] = f"with {EMB} select row_id, {', '.join(f'x[{int(x[1:]) + 1}] as {x}' for x in _kept)} from t"
_largest = sorted(XS, key=lambda x: -_size[int(x[1:])])[: sum(s > 10 for s in _size)]
Q["rfe"] = lambda spark, d: feature_selection.RFE(estimator=linear.LinearRegression(), n_features_to_select=len(_largest), step=8).fit(linear_rows(spark, d), XS, "w").transform(linear_rows(spark, d).select("row_id", *XS))
SQL["rfe"] = f"with {EMB} select row_id, {', '.join(f'x[{int(x[1:]) + 1}] as {x}' for x in sorted(_largest, key=lambda x: int(x[1:])))} from t"

_line = linear.LinearRegression
Q["rfecv"] = lambda spark, d: spark.createDataFrame([(k, round(float(v), 6)) for k, v in feature_selection.RFECV(estimator=_line(), min_features_to_select=DIMENSIONS - 1, step=1, cv=2).fit(linear_rows(spark, d), XS, "w").cv_scores_.items() if k == DIMENSIONS], "features int, score double")
SQL["rfecv"] = f"select {DIMENSIONS}::int as features, 1.0::double as score"
Q["cross_validate"] = lambda spark, d: spark.createDataFrame([(i, round(float(r["test_score"]), 6), round(float(r["train_score"]), 6)) for i, r in enumerate(model_selection.cross_validate(_line(), linear_rows(spark, d), XS, "w", 3, return_train_score=True))], "fold int, test double, train double")
SQL["cross_validate"] = "select i::int as fold, 1.0::double as test, 1.0::double as train from range(3) t(i)"
Q["learning_curve"] = lambda spark, d: spark.createDataFrame([(r["fold"], r["size"], round(float(r["train"]), 6), round(float(r["test"]), 6)) for r in model_selection.learning_curve(_line(), linear_rows(spark, d), XS, "w", (0.75, 1.0), 2)], "fold int, size int, train double, test double")
SQL["learning_curve"] = "with n as (select count(*) as n from embeddings) select f::int as fold, floor(s * case when f = 0 then n // 2 else n - n // 2 end)::int as size, 1.0::double as train, 1.0::double as test from n, range(2) t(f), (values (0.75), (1.0)) v(s)"
Q["validation_curve"] = lambda spark, d: spark.createDataFrame([(r["fold"], round(float(r["train"]), 6), round(float(r["test"]), 6)) for r in model_selection.validation_curve(linear.Ridge(), linear_rows(spark, d), XS, "w", "alpha", [0.0], 2)], "fold int, train double, test double")
SQL["validation_curve"] = "select f::int as fold, 1.0::double as train, 1.0::double as test from range(2) t(f)"
Q["feature_union"] = lambda spark, d: meta.FeatureUnion(transformer_list=[("scaled", preprocessing.MinMaxScaler()), ("widest", preprocessing.MaxAbsScaler())]).fit(linear_rows(spark, d), XS[:2]).transform(linear_rows(spark, d).select("row_id", *XS[:2])).select("row_id", *[F.round(f"{n}_{c}", 6).alias(f"{n}_{c}") for n in ("scaled", "widest") for c in XS[:2]])
SQL["feature_union"] = f"with {EMB}, s as (select " + ", ".join(f"min(x[{i}]) as l{i}, max(x[{i}]) as h{i}, max(abs(x[{i}])) as a{i}" for i in (1, 2)) + " from t) select row_id, " + ", ".join(f"round((x[{i}] - l{i}) / (h{i} - l{i}), 6) as scaled_x{i - 1}, round(x[{i}] / a{i}, 6) as widest_x{i - 1}" for i in (1, 2)) + " from t, s"
recovers("randomized_search_cv", lambda: model_selection.RandomizedSearchCV(estimator=linear.Ridge(), param_grid={"alpha": [0.0, 100.0]}, n_iter=2, cv=2))

# --- baselines and order ------------------------------------------------------------------

_V = "10 * x[1] + 5 * x[2] * x[2] + x[3]"
Q["dummy_classifier"] = lambda spark, d: meta.DummyClassifier().fit(labelled(spark, d), XS, "label").predict(labelled(spark, d)).select("row_id", "prediction")
SQL["dummy_classifier"] = f"with {EMB}, n as (select label, count(*) as n from t group by 1) select row_id, (select arg_min(label, {{'a': -n, 'b': label}}) from n) as prediction from t"
Q["dummy_regressor"] = lambda spark, d: meta.DummyRegressor(strategy="median").fit(labelled(spark, d), XS, "v").predict(labelled(spark, d)).select("row_id", F.round("prediction", 6).alias("prediction"))
SQL["dummy_regressor"] = f"with {EMB}, m as (select median({_V}) as m from t) select row_id, round(m, 6) as prediction from t, m"
Q["isotonic_regression"] = lambda spark, d: meta.IsotonicRegression().fit(labelled(spark, d), ["x0"], "v").predict(labelled(spark, d)).select("row_id", (F.round("prediction", 5) + F.lit(0.0)).alias("prediction"))
SQL["isotonic_regression"] = f"""with {EMB}, g as (select x[1] as x, sum({_V}) as y, count(*) as n from t group by 1), o as (select *, row_number() over (order by x) as i, sum(y) over (order by x) as sy, sum(n) over (order by x) as sn from g),
p as (select a.i as j, b.i as k, (b.sy - a.sy + a.y) / (b.sn - a.sn + a.n) as m from o a join o b on a.i <= b.i), l as (select j, k as i, min(m) over (partition by j order by k rows between current row and unbounded following) as m from p),
f as (select i, max(m) as m from l group by i) select row_id, round(f.m, 5) + 0 as prediction from t join o on o.x = t.x[1] join f using (i)"""

# --- one feature --------------------------------------------------------------------------

LI = "l_orderkey, l_linenumber"


def items(spark, d):
    """l_quantity as q, its class y (0, 1, 2), and whether the line is open (o)."""
    y = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("v"), y.alias("y"), (F.col("l_linestatus") == "O").cast("double").alias("o"), (F.col("l_extendedprice") * (1 + F.col("l_tax") * (F.col("l_linestatus") == "O").cast("int"))).alias("z"))


_I = "i as (select *, row_number() over () as line, l_quantity as q, l_extendedprice as v, case l_returnflag when 'A' then 0.0::double when 'N' then 1.0 else 2.0 end as y, (l_linestatus = 'O')::int::double as o, l_extendedprice * (1 + l_tax * (l_linestatus = 'O')::int) as z from lineitem)"


def of_one(name, make, column, label, sql, digits=None):
    def q(spark, d):
        df = items(spark, d)
        m = make()
        m.fit(df, [column], label)
        out = F.col("prediction") if digits is None else F.round("prediction", digits)
        return m.predict(df).select("l_orderkey", "l_linenumber", out.alias("prediction"))

    Q[name] = q
    SQL[name] = f"with {_I}{sql}"


_best = f", s as (select line, i.l_orderkey, i.l_linenumber, c.y as c, {{score}} as s from i, c), b as (select line, {LI}, arg_min(c, {{{{'a': -s, 'b': c}}}}) as prediction from s group by all) select {LI}, prediction from b"
of_one("linear_discriminant_analysis", mixture.LinearDiscriminantAnalysis, "v", "y", ", n as (select count(*) as n, count(distinct y) as k from i), g as (select y, count(*) as n, avg(v) as m, var_pop(v) * count(*) as w from i group by y), c as (select y, m, ln(g.n / n.n) as p, sum(w) over () / (n.n - n.k) as var from g, n)" + _best.format(score="(i.v * m - m * m / 2) / var + p"))
of_one("quadratic_discriminant_analysis", mixture.QuadraticDiscriminantAnalysis, "v", "y", ", n as (select count(*) as n from i), c as (select y, avg(v) as m, var_samp(v) as var, ln(count(*) / any_value(n.n)) as p from i, n group by y)" + _best.format(score="-0.5 * ((i.v - m) * (i.v - m) / var + ln(var)) + p"))
# with one yes-or-no feature and a log link the optimum is the mean of each group
for _n, _m in (("poisson_regressor", linear.PoissonRegressor), ("gamma_regressor", linear.GammaRegressor)):
    of_one(_n, lambda m=_m: m(alpha=0.0, max_iter=200, tol=1e-10), "o", "z", f", m as (select o, avg(z) as m from i group by o) select {LI}, round(m, 1) as prediction from i join m using (o)", 1)

# --- two columns: eigenvectors in closed form ------------------------------------------------

_P = "c as (select avg(a) as ma, avg(b) as mb, var_samp(a) as va, var_samp(b) as vb, covar_samp(a, b) as cab from p), r as (select *, 0.5 * atan2(2 * cab, va - vb) as h from c), e as (select *, cos(h) as u, sin(h) as w, case when abs(cos(h)) >= abs(sin(h)) then sign(cos(h)) else sign(sin(h)) end as s from r)"
Q["pca_of_two"] = lambda spark, d: decomposition.PCA(n_components=1).fit(_plane(spark, d), ["a", "b"]).transform(_plane(spark, d)).select("l_orderkey", "l_linenumber", (F.round(F.col("transformed")[0], 5) + F.lit(0.0)).alias("z"))
SQL["pca_of_two"] = f"with p as (select {LI}, l_quantity / 50 as a, l_extendedprice / 100000 as b from lineitem), {_P} select {LI}, round(s * ((a - ma) * u + (b - mb) * w), 5) + 0 as z from p, e"


def _plane(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("b"))
