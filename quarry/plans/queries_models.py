"""Queries of neighbour operators (with SQL) and of the model families that SQL can't express (rows only).

All run over the whole table ``embeddings``, all of its dimensions as columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import cluster, covariance, decomposition, feature_selection, linear, manifold, meta, mixture, model_selection, neighbors, neural, preprocessing, svm, trees
from quarry.plans.queries_columns import _features, _predicted, read, rounded
from quarry.plans.queries_metrics import DIMENSIONS, EMB, XS, Query, embeddings
from quarry.sources import synthetic

Q: dict[str, Query] = {}
SQL: dict[str, str] = {}


def labelled(spark, d):
    """All components as columns, label (0 to 9), binary b and number v."""
    return embeddings(spark, d).withColumns({"b": (F.col("label") > 4).cast("double"), "v": 10 * F.col("x0") + 5 * F.col("x1") ** 2 + F.col("x2")})


# --- neighbours: exact SQL ------------------------------------------------------------------

_NEAR = f"with {EMB}, d as (select a.row_id as q, b.row_id as n, b.label, list_distance(a.x, b.x) as d from t a join t b on true), k as (select *, row_number() over (partition by q order by d, n) as r from d)"


def _near(make, label="label"):
    def q(spark, d):
        e = labelled(spark, d)
        m = make()
        m.fit(e, XS, label)
        return rounded(m.predict(e).select("row_id", "prediction"))

    return q


_VOTE = ", v as (select q, label, sum(w) as w from w group by all) select q as row_id, arg_min(label, (-w, label)) as prediction from v group by q"
Q["k_nearest_neighbors"] = _near(lambda: neighbors.KNearestNeighbors())
SQL["k_nearest_neighbors"] = _NEAR + ", w as (select q, label, 1 as w from k where r <= 5)" + _VOTE.replace("arg_min(label, (-w, label))", "arg_min(label, {'a': -w, 'b': label})")
Q["k_neighbors_classifier_distance"] = _near(lambda: neighbors.KNeighborsClassifier(weights="distance"))
SQL["k_neighbors_classifier_distance"] = _NEAR + ", z as (select *, min(d) over (partition by q) as least from k where r <= 5), w as (select q, label, case when least > 0 then 1 / d else (d = 0)::int end as w from z)" + _VOTE.replace("arg_min(label, (-w, label))", "arg_min(label, {'a': -w, 'b': label})")
Q["k_neighbors_regressor"] = _near(lambda: neighbors.KNeighborsRegressor())
SQL["k_neighbors_regressor"] = _NEAR + " select q as row_id, round(avg(label), 6) as prediction from k where r <= 5 group by q"
Q["radius_neighbors_classifier"] = _near(lambda: neighbors.RadiusNeighborsClassifier(radius=1.2, outlier_label=-1))
SQL["radius_neighbors_classifier"] = _NEAR + ", w as (select q, label, count(*) as w from k where d <= 1.2 group by all), p as (select q, arg_min(label, {'a': -w, 'b': label}) as p from w group by q) select row_id, coalesce(p, -1) as prediction from t left join p on q = row_id"
Q["radius_neighbors_regressor"] = _near(lambda: neighbors.RadiusNeighborsRegressor(radius=1.2))
SQL["radius_neighbors_regressor"] = _NEAR + ", p as (select q, avg(label) as p from k where d <= 1.2 group by q) select row_id, coalesce(round(p, 6), 'nan'::double) as prediction from t left join p on q = row_id"
Q["nearest_neighbors"] = lambda spark, d: rounded(neighbors.NearestNeighbors(n_neighbors=3).fit(labelled(spark, d), XS).kneighbors())
SQL["nearest_neighbors"] = f"with {EMB}, d as (select a.row_id as query, b.row_id as neighbour, list_distance(a.x, b.x) as d from t a join t b on a.row_id <> b.row_id), k as (select *, row_number() over (partition by query order by d, neighbour) as r from d) select query, neighbour, round(d, 6) as d from k where r <= 3"
Q["nearest_neighbors_radius"] = lambda spark, d: rounded(neighbors.NearestNeighbors().fit(labelled(spark, d), XS).radius_neighbors(radius=1.15))
SQL["nearest_neighbors_radius"] = f"with {EMB} select a.row_id as query, b.row_id as neighbour, round(list_distance(a.x, b.x), 6) as d from t a join t b on a.row_id <> b.row_id and list_distance(a.x, b.x) <= 1.15"
Q["nearest_centroid"] = _near(lambda: neighbors.NearestCentroid())
SQL["nearest_centroid"] = f"with {EMB}, c as (select label, [{', '.join(f'avg(x[{i}])' for i in range(1, DIMENSIONS + 1))}] as m from t group by label) select row_id, arg_min(c.label, {{'a': list_distance(x, m), 'b': c.label}}) as prediction from t, c group by row_id"
Q["local_outlier_factor"] = lambda spark, d: rounded(neighbors.LocalOutlierFactor(n_neighbors=10).fit(labelled(spark, d), XS).score_samples())
SQL["local_outlier_factor"] = f"""with {EMB}, d as (select a.row_id as q, b.row_id as n, list_distance(a.x, b.x) as d from t a join t b on a.row_id <> b.row_id), k as (select *, row_number() over (partition by q order by d, n) as r from d qualify r <= 10),
kd as (select q, max(d) as kd from k group by q), l as (select k.q, 1 / (avg(greatest(k.d, kd.kd)) + 1e-10) as lrd from k join kd on kd.q = k.n group by k.q)
select k.q as row_id, round(avg(b.lrd) / any_value(a.lrd), 6) as lof from k join l a on a.q = k.q join l b on b.q = k.n group by k.q"""
Q["kernel_density"] = lambda spark, d: rounded(neighbors.KernelDensity(bandwidth=0.5).fit(labelled(spark, d), XS).score_samples(labelled(spark, d)).select("row_id", "log_density"))
SQL["kernel_density"] = f"with {EMB} select a.row_id, round(ln(sum(exp(-2 * list_distance(a.x, b.x) * list_distance(a.x, b.x)))) - 32 * ln(2 * pi()) - 64 * ln(0.5) - ln((select count(*) from t)), 6) as log_density from t a, t b group by a.row_id"


def _tree(cls):
    def q(spark, d):
        return rounded(cls.of(labelled(spark, d), XS).kneighbors(labelled(spark, d), XS, 3))

    return q


for _n, _c in (("kd_tree", neighbors.KDTree), ("ball_tree", neighbors.BallTree)):
    Q[_n] = _tree(_c)
    SQL[_n] = f"with {EMB}, d as (select a.row_id as query, b.row_id as neighbour, list_distance(a.x, b.x) as d from t a, t b), k as (select *, row_number() over (partition by query order by d, neighbour) as r from d) select query, neighbour, round(d, 6) as d from k where r <= 3"
Q["dbscan"] = lambda spark, d: cluster.DBScan(eps=1.15, min_samples=4).fit_predict(labelled(spark, d), XS).select("row_id", "cluster")
SQL["dbscan"] = f"""with recursive {EMB}, p as (select a.row_id as a, b.row_id as b from t a join t b on list_distance(a.x, b.x) <= 1.15), core as (select a from p group by a having count(*) >= 4),
reach as (select a as x, a as y from core union select reach.x, p.b from reach join p on p.a = reach.y join core on core.a = p.b), root as (select x, min(y) as root from reach group by x),
num as (select root, (row_number() over (order by root) - 1)::int as c from (select distinct root from root)), cc as (select x, c from root join num using (root)), br as (select p.a, min(c) as c from p join cc on cc.x = p.b group by p.a)
select row_id, coalesce(cc.c, br.c, -1)::int as cluster from t left join cc on cc.x = row_id left join br on br.a = row_id"""


def _covariance(make, name):
    def q(spark, d):
        m = make().fit(labelled(spark, d), XS[:3])
        return spark.createDataFrame([(i, j, round(float(m.covariance_[i, j]), 8)) for i in range(3) for j in range(3)], "i int, j int, value double")

    Q[name] = q


_COV = f"with {EMB}, c as (select i::int as i, j::int as j, covar_pop(x[i + 1], x[j + 1]) as s from t, range(3) a(i), range(3) b(j) group by all), n as (select count(*) as n from t), mu as (select avg(s) as mu from c where i = j)"
_covariance(covariance.EmpiricalCovariance, "empirical_covariance")
SQL["empirical_covariance"] = _COV + " select i, j, round(s, 8) as value from c"
_covariance(covariance.ShrunkCovariance, "shrunk_covariance")
SQL["shrunk_covariance"] = _COV + " select i, j, round(0.9 * s + case when i = j then 0.1 * mu else 0 end, 8) as value from c, mu"
_covariance(covariance.OAS, "oas")
SQL["oas"] = _COV + ", a as (select avg(s * s) as al, any_value(mu) as mu, any_value(n) as n from c, mu, n), h as (select mu, least((al + mu * mu) / ((n + 1) * (al - mu * mu / 3)), 1) as h from a) select i, j, round((1 - h) * s + case when i = j then h * mu else 0 end, 8) as value from c, h"
_covariance(covariance.LedoitWolf, "ledoit_wolf")
SQL["ledoit_wolf"] = _COV + """, m as (select avg(x[1]) as a, avg(x[2]) as b, avg(x[3]) as c from t), f as (select avg(((x[1] - a) ** 2 + (x[2] - b) ** 2 + (x[3] - c) ** 2) ** 2) as f from t, m),
q as (select sum(s * s) as ss, sum((s - case when i = j then mu else 0 end) ** 2) / 3 as delta, any_value(mu) as mu from c, mu), h as (select mu, greatest(0, least((f - ss) / (n * 3), delta) / delta) as h from q, f, n)
select i, j, round((1 - h) * s + case when i = j then h * mu else 0 end, 8) as value from c, h"""

# --- rows only ----------------------------------------------------------------------------------


def predicts(name, make, label="b", cols=None, output="prediction"):
    def q(spark, d):
        df = labelled(spark, d)
        m = make()
        m.fit(df, cols or XS, label) if label else m.fit(df, cols or XS)
        return m.predict(df).select("row_id", output)

    Q[name] = q


def embeds(name, make):
    Q[name] = lambda spark, d: make().fit_transform(labelled(spark, d), XS)


def transforms(name, make, label=None, positive=False):
    def q(spark, d):
        df = labelled(spark, d)
        df = df.withColumns({c: F.abs(c) for c in XS}) if positive else df
        return make().fit(df, XS).transform(df).select("row_id", F.transform("transformed", lambda x: F.round(x, 6)).alias("transformed"))

    Q[name] = q


def clusters(name, make):
    def q(spark, d):
        return make().fit_predict(labelled(spark, d), XS)

    Q[name] = q


for _n, _m, _l in [
    ("random_forest_classifier", lambda: trees.RandomForestClassifier(n_estimators=8, random_state=1), "label"),
    ("ada_boost_classifier", lambda: trees.AdaBoostClassifier(n_estimators=10), "b"),
    ("ada_boost_regressor", lambda: trees.AdaBoostRegressor(n_estimators=10), "v"),
    ("gradient_boosting_classifier", lambda: trees.GradientBoostingClassifier(n_estimators=10), "b"),
    ("gradient_boosting_regressor", lambda: trees.GradientBoostingRegressor(n_estimators=10), "v"),
    ("xgboost_classifier", lambda: trees.XGBoostClassifier(n_estimators=5, max_depth=3), "b"),
    ("xgboost_regressor", lambda: trees.XGBoostRegressor(n_estimators=5, max_depth=3), "v"),
    ("isolation_forest", lambda: trees.IsolationForest(n_trees=20), None),
    ("nu_svc", lambda: svm.NuSVC(nu=0.3), "b"),
    ("svr", lambda: svm.SVR(), "v"),
    ("nu_svr", lambda: svm.NuSVR(), "v"),
    ("one_class_svm", lambda: svm.OneClassSVM(nu=0.1), None),
    ("linear_svc", lambda: svm.LinearSVC(), "b"),
    ("linear_svr", lambda: svm.LinearSVR(), "v"),
    ("kernel_ridge", lambda: svm.KernelRidge(kernel="rbf"), "v"),
    ("mlp_classifier", lambda: neural.MLPClassifier(hidden_layer_sizes=(10,)), "b"),
    ("mlp_regressor", lambda: neural.MLPRegressor(hidden_layer_sizes=(10,)), "v"),
    ("sgd_classifier", lambda: linear.SGDClassifier(), "b"),
    ("sgd_regressor", lambda: linear.SGDRegressor(), "v"),
    ("perceptron", lambda: linear.Perceptron(), "b"),
    ("bayesian_ridge", lambda: linear.BayesianRidge(), "v"),
    ("ard_regression", lambda: linear.ARDRegression(), "v"),
    ("theil_sen_regressor", lambda: linear.TheilSenRegressor(max_subpopulation=500), "v"),
    ("gaussian_mixture", lambda: mixture.GaussianMixture(n_components=3), None),
    ("bayesian_gaussian_mixture", lambda: mixture.BayesianGaussianMixture(n_components=3), None),
    ("k_means", lambda: cluster.KMeans(n_clusters=4, n_init=2), None),
    ("mini_batch_k_means", lambda: cluster.MiniBatchKMeans(n_clusters=4), None),
    ("elliptic_envelope", lambda: covariance.EllipticEnvelope(), None),
    ("stacking_classifier", lambda: meta.StackingClassifier(estimators=[("a", mixture.LinearDiscriminantAnalysis()), ("b", trees.DecisionTreeClassifier(max_depth=3))], cv=2), "b"),
    ("calibrated_classifier_cv", lambda: meta.CalibratedClassifierCV(estimator=mixture.LinearDiscriminantAnalysis(), cv=2), "b"),
    ("quantile_regressor", lambda: linear.QuantileRegressor(alpha=0.0, max_iter=20), "v"),
]:
    predicts(_n, _m, _l)
Q["tweedie_regressor"] = _predicted(lambda: linear.TweedieRegressor(power=0, alpha=0.0), ["l_quantity"], "v")
SQL["tweedie_regressor"] = "with r as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem) select l_orderkey, l_linenumber, round(a * l_quantity + b, 4) as prediction from lineitem, r"
for _n, _m in [
    ("agglomerative_clustering", lambda: cluster.AgglomerativeClustering(n_clusters=4)), ("birch", lambda: cluster.Birch(threshold=0.3)), ("spectral_clustering", lambda: cluster.SpectralClustering(n_clusters=3, n_init=2)),
    ("optics", lambda: cluster.OPTICS(eps=0.4)), ("hdbscan", lambda: cluster.HDBScan()), ("mean_shift", lambda: cluster.MeanShift(bandwidth=0.6)), ("affinity_propagation", lambda: cluster.AffinityPropagation()), ("bisecting_k_means", lambda: cluster.BisectingKMeans(n_clusters=4)),
]:
    clusters(_n, _m)
for _n, _m in [
    ("pca", lambda: decomposition.PCA(n_components=3)), ("truncated_svd", lambda: decomposition.TruncatedSVD(n_components=3)), ("sparse_pca", lambda: decomposition.SparsePCA(n_components=2, alpha=0.001)), ("incremental_pca", lambda: decomposition.IncrementalPCA(n_components=3)),
    ("kernel_pca", lambda: decomposition.KernelPCA(n_components=2, kernel="rbf")), ("fast_ica", lambda: decomposition.FastICA(n_components=2)), ("factor_analysis", lambda: decomposition.FactorAnalysis(n_components=2)),
    ("gaussian_random_projection", lambda: decomposition.GaussianRandomProjection(n_components=4)), ("sparse_random_projection", lambda: decomposition.SparseRandomProjection(n_components=4)), ("bernoulli_rbm", lambda: neural.BernoulliRBM(n_components=4)), ("spline_transformer", lambda: preprocessing.SplineTransformer()),
]:
    transforms(_n, _m)
transforms("nmf", lambda: decomposition.NMF(), positive=True)
transforms("latent_dirichlet_allocation", lambda: decomposition.LatentDirichletAllocation(n_components=3), positive=True)
for _n, _m in [("tsne", lambda: manifold.TSNE()), ("mds", lambda: manifold.MDS()), ("spectral_embedding", lambda: manifold.SpectralEmbedding()), ("locally_linear_embedding", lambda: manifold.LocallyLinearEmbedding()), ("isomap", lambda: manifold.Isomap())]:
    embeds(_n, _m)
for _n, _m in (("pls_regression", decomposition.PLSRegression), ("cca", decomposition.CCA)):
    Q[_n] = lambda spark, d, m=_m: m(n_components=1).fit(labelled(spark, d), XS, ["v", "label"]).transform(labelled(spark, d)).select("row_id", "transformed")
for _n, _m in (("label_propagation", meta.LabelPropagation), ("label_spreading", meta.LabelSpreading)):
    Q[_n] = lambda spark, d, m=_m: m(gamma=5.0).fit(labelled(spark, d).withColumn("y", F.when(F.col("row_id") % 3 == 0, F.col("label")).otherwise(-1.0)), XS, "y").predict(labelled(spark, d)).select("row_id", "prediction")
Q["self_training_classifier"] = lambda spark, d: meta.SelfTrainingClassifier(estimator=mixture.LinearDiscriminantAnalysis()).fit(labelled(spark, d).withColumn("y", F.when(F.col("row_id") % 3 == 0, F.col("b")).otherwise(-1.0)), XS, "y").predict(labelled(spark, d)).select("row_id", "prediction")
Q["min_cov_det"] = lambda spark, d: covariance.MinCovDet().fit(labelled(spark, d), XS[:3]).mahalanobis(labelled(spark, d)).select("row_id", "mahalanobis")
Q["graphical_lasso"] = lambda spark, d: covariance.GraphicalLasso(alpha=0.001).fit(labelled(spark, d), XS[:4]).mahalanobis(labelled(spark, d)).select("row_id", "mahalanobis")
Q["mutual_info_regression"] = lambda spark, d: spark.createDataFrame(list(zip(XS, feature_selection.mutual_info_regression(labelled(spark, d), XS, "v").tolist(), strict=True)), "feature string, score double")
Q["power_transformer"] = lambda spark, d: preprocessing.PowerTransformer().fit(labelled(spark, d), ["v"]).transform(labelled(spark, d)).select("row_id", "v")
Q["iterative_imputer"] = lambda spark, d: preprocessing.IterativeImputer().fit(_holes(spark, d), ["x0", "x1", "v"]).transform(_holes(spark, d)).select("row_id", "x0", "x1", "v")
Q["pipeline_scaler_ridge"] = lambda spark, d: meta.make_pipeline(preprocessing.StandardScaler(), linear.Ridge()).fit(labelled(spark, d), XS, "v").predict(labelled(spark, d)).select("row_id", "prediction")
Q["column_transformer"] = lambda spark, d: rounded(meta.ColumnTransformer(transformers=[("a", preprocessing.MinMaxScaler(), ["x0"]), ("b", "passthrough", ["x1"])]).fit(labelled(spark, d), ["x0", "x1", "x2"]).transform(labelled(spark, d).select("row_id", "x0", "x1", "x2")))
SQL["column_transformer"] = f"with {EMB}, s as (select min(x[1]) as l, max(x[1]) as h from t) select row_id, round((x[1] - l) / (h - l), 6) as x0, round(x[2], 6) as x1 from t, s"
Q["partial_dependence"] = lambda spark, d: rounded(model_selection.partial_dependence(linear.LinearRegression().fit(labelled(spark, d), XS[:2], "v"), labelled(spark, d), ["x0"], 10))
Q["permutation_importance"] = lambda spark, d: spark.createDataFrame([(k, float(np.mean(v))) for k, v in model_selection.permutation_importance(linear.LinearRegression().fit(labelled(spark, d), XS[:2], "v"), labelled(spark, d), XS[:2], "v", 1).items()], "feature string, drop double")
Q["make_blobs"] = lambda spark, d: synthetic.make_blobs(spark, 60)
Q["make_moons"] = lambda spark, d: rounded(synthetic.make_moons(spark, 100))
SQL["make_moons"] = "select i as row_id, round(case when i < 50 then cos(pi() * i / 49) else 1 - cos(pi() * (i - 50) / 49) end, 6) + 0 as x0, round(case when i < 50 then sin(pi() * i / 49) else 0.5 - sin(pi() * (i - 50) / 49) end, 6) + 0 as x1, (i >= 50)::int::double as label from range(100) t(i)"
Q["make_circles"] = lambda spark, d: rounded(synthetic.make_circles(spark, 100))
SQL["make_circles"] = "select i as row_id, round(case when i < 50 then 1 else 0.8::double end * cos(2 * pi() * (i % 50) / 50), 6) + 0 as x0, round(case when i < 50 then 1 else 0.8::double end * sin(2 * pi() * (i % 50) / 50), 6) + 0 as x1, (i >= 50)::int::double as label from range(100) t(i)"
Q["make_classification"] = lambda spark, d: synthetic.make_classification(spark)
Q["make_regression"] = lambda spark, d: synthetic.make_regression(spark)[0]


def _holes(spark, d):
    return labelled(spark, d).withColumn("x1", F.when(F.col("row_id") % 7 != 0, F.col("x1"))).withColumn("v", F.when(F.col("row_id") % 5 != 0, F.col("v")))
