import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.config import settings
from tessera.operators import score as R, supervised as S
from tessera.plans import train as T
from tessera.plans.cluster_flow import model_pool, train_clustering
from tessera.sources.registry import Registry


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    n = 400
    x, z = rng.normal(size=n), rng.normal(size=n)
    kind = rng.choice(["a", "b", "c"], n)
    pdf = pd.DataFrame({"x": x, "z": z, "kind": kind, "user_id": np.arange(n)})
    pdf["grade"] = np.select([x + (kind == "a") > 0.8, x < -0.5], ["high", "low"], "mid")
    pdf["spend"] = np.exp(2 * x + 0.1 * z)
    pdf["rare"] = np.where(x > 1.2, 1, 0)
    return spark.createDataFrame(pdf)


def small(name, task, g):
    p = S.sample_params(name, task, g)
    cut = {"n_estimators": 3, "iterations": 3, "max_depth": 3, "depth": 3, "num_leaves": 8}
    return {k: cut.get(k, v) for k, v in p.items()}


@pytest.fixture
def small_defaults(monkeypatch):
    real = S.default_params
    cut = {"n_estimators": 3, "iterations": 3, "max_depth": 3, "depth": 3}
    monkeypatch.setattr(S, "default_params",
                        lambda n, t: {k: cut.get(k, v) for k, v in real(n, t).items()})


def features(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in
                                  enumerate(zip(x, y))], "_rid int, f array<double>, label double"
                                 ).withColumn("features", array_to_vector("f"))


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.2]
    y = x @ [1.0, -2.0, 3.0] + rng.normal(size=120) * 3 + 4
    m = S.estimator("Ridge", "regression", {"alpha": 7.0}, n=120, width=3,
                    label_sd=float(y.std())).fit(features(spark, x, y))
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 7 * np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] + rng.normal(size=150) > 0).astype(float)
    m = S.estimator("LogisticRegression", "classification", {"C": 0.5}, n=150, width=2,
                    classes=2).fit(features(spark, x, y))
    b, a = np.zeros(3), np.c_[x, np.ones(150)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        reg = np.diag([1, 1, 0]) / 0.5
        b -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + reg, a.T @ (p - y) + reg @ b)
    assert np.allclose(m.coefficients.toArray(), b[:2], atol=1e-3)


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_nearest_neighbours_vote(spark, weights):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 2)), rng.integers(0, 3, 60)
    q = rng.normal(size=(20, 2))
    out = S.KNearest(k=5, classes=3, weights=weights).fit(features(spark, x, y)).transform(
        features(spark, q, np.zeros(20))).toPandas().set_index("_rid").sort_index()
    for i in range(20):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        top = np.argsort(d)[:5]
        w = np.ones(5) if weights == "uniform" else 1 / d[top]
        p = np.bincount(y[top], w, 3) / w.sum()
        assert np.allclose(out.probability[i].toArray(), p)
        assert out.prediction[i] == p.argmax()


def test_kernel_features_approach_rbf(spark):
    x = np.array([[0.0, 0.0], [0.5, 0.5], [2.0, 2.0]])
    out = S.RandomFourierFeatures(gamma=0.5, size=4000).transform(
        features(spark, x, np.zeros(3))).toPandas().sort_values("_rid")
    z = np.stack([v.toArray() for v in out.kernel_features])
    want = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(z @ z.T, want, atol=0.06)


def test_classification_run_and_scoring(spark, people, small_defaults, tmp_path):
    c = settings("classification", n_iter=1, cv_folds=2)
    seen = []
    run = T.run_task(people.drop("spend", "rare"), "anything", "grade", c, space=small,
                     models=["SVC", "KNN", "DecisionTree", "GradientBoosting", "NaiveBayes"],
                     progress=lambda step, model=None: seen.append(step))
    board = run.leaderboard().orderBy("place").collect()
    assert len(board) == 5 and board[0]["key"] == "топ-1 модель"
    assert board[0]["metrics"]["accuracy"] > 0.7
    assert all(0 <= b["metrics"]["roc_auc"] <= 1 for b in board)
    assert seen[0] == 1 and seen[-1] == 5
    assert "user_id" not in run.prepared.features
    n = run.prepared.table.where("is_test").count()
    assert n == 100
    for r in run.results:
        assert r.confusion.agg(F.sum("n")).first()[0] == n
        path = str(tmp_path / r.name)
        R.from_run(run, r).save(spark, path)
        scored = R.Artifact.load(spark, path).score(people, keep=["user_id", "grade"])
        assert scored.count() == 400
        assert {x["predicted"] for x in scored.select("predicted").distinct().collect()} <= {
            "high", "mid", "low"}
    by_name = {r.name: r for r in run.results}
    assert by_name["DecisionTree"].importance.first()["importance"] > 0
    assert by_name["KNN"].importance is None


def test_imbalanced_run_uses_f1_and_weights(spark, people):
    c = settings("classification", n_iter=1, cv_folds=2)
    run = T.train_supervised(people.drop("grade", "spend"), "rare", "classification", c,
                             models=["LogisticRegression"])
    assert run.prepared.imbalanced and run.prepared.weight == "weight"
    assert set(run.results[0].metrics) == {"f1_score", "roc_auc"}


def test_regression_run_registry_and_missing_columns(spark, people, tmp_path):
    c = settings("regression", n_iter=1, cv_folds=2)
    run = T.run_task(people.drop("grade", "rare"), "regression", "spend", c,
                     models=["LinearRegression", "SVR"], space=small)
    assert run.prepared.transform == "log1p"
    best = run.results[0]
    assert best.metrics["r2"] > 0.7 and "r2_original" in best.metrics
    reg = Registry(spark, str(tmp_path / "reg"))
    training_id = reg.add_run("regression", "spend", best.start, best.finish)
    R.save_run(run, reg, str(tmp_path / "files"), "chat", training_id)
    models = reg.read("models_metadata").orderBy("place_in_training_batch").collect()
    assert [m["model_name"] for m in models] == [r.name for r in run.results]
    art = R.load_by_id(reg, models[0]["model_id"])
    close = art.score(people, ["spend"]).agg(F.corr("predicted", "spend")).first()[0]
    assert close > 0.7
    assert art.score(people.select("user_id"), ["user_id"]).count() == 400
    with pytest.raises(KeyError):
        R.load_by_id(reg, 99)


def test_scoring_a_stream(spark, people, tmp_path):
    run = T.train_supervised(people.drop("spend", "rare"), "grade", "classification",
                             settings("classification", n_iter=1, cv_folds=2), models=["NaiveBayes"])
    art = R.from_run(run, run.results[0])
    people.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    q = (art.score(stream, ["user_id"]).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["user_id"], r["predicted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["user_id"], r["predicted"]) for r in art.score(people, ["user_id"]).collect()}
    assert got == want and len(got) == 400


def test_centroid_distances(spark):
    art = R.Artifact("clustering", "KMeans_linear", ["x", "y"],
                     R.X.Scaling({"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}),
                     centroids=[("cluster_0", [0.0, 0.0]), ("cluster_-1", [9.0, 9.0]),
                                ("cluster_1", [3.0, 4.0])])
    row = art.score(spark.createDataFrame([(3.0,)], "x double")).first()["distances"]
    assert [(round(r["distance"], 6), r["cluster"]) for r in row] == [
        (3.0, "cluster_0"), (4.0, "cluster_1")]


def test_clustering_run(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 4)]),
                       columns=["a", "b", "c"])
    points = T.cluster_points(spark.createDataFrame(pdf))
    c = settings("clustering", n_trials=1, stability_n_runs=2, gap_n_refs=1)
    run = train_clustering(points, c, models=["KMeans"], spaces=["linear"])
    row = run.leaderboard.first()
    assert row["model_name"] == "KMeans_linear" and 0 < row["unified_score"] <= 1
    assert run.labels["KMeans_linear"].count() == 80
    assert not run.curves["KMeans_linear"].isEmpty()
    with pytest.raises(ValueError):
        T.run_task(spark.createDataFrame(pdf), "clustering", plan_id=1)
    with pytest.raises(ValueError):
        T.run_task(spark.createDataFrame(pdf), "regression")


def test_model_pools():
    assert model_pool(1, "linear") == []
    assert model_pool(2, "view") == []
    assert set(model_pool(2, "linear")) == {"KMeans", "DBSCAN", "Birch",
                                                 "AgglomerativeClustering"}
    assert "AgglomerativeClustering" in model_pool(3, "linear")
    assert model_pool(3, "view") == ["AgglomerativeClustering"]
    assert "GradientBoosting" not in S.model_names("classification", 1)


def test_folds_are_stratified_and_polynomials_keep_their_order(spark):
    df = spark.createDataFrame([(i, "rare" if i % 50 == 0 else "often") for i in range(200)],
                               "_rid int, kind string")
    rows = R.X.stratified_folds(df, ["kind"], "_rid", 3).groupBy("kind", "fold").count().collect()
    sizes = {k: sorted(r["count"] for r in rows if r["kind"] == k) for k in ("rare", "often")}
    assert sizes == {"rare": [1, 1, 2], "often": [65, 65, 66]}
    one = spark.createDataFrame([([2.0, 3.0, 5.0],)], "v array<double>")
    got = one.select(T._poly_vector("v").alias("p")).first()["p"].toArray().tolist()
    named = R.X.polynomial_names(["a", "b", "c"])
    at = {"a": 2.0, "b": 3.0, "c": 5.0}
    assert got == [at[a] * at.get(b, 1.0) for a, b, _ in named]


def test_the_classification_run_is_whole(spark, monkeypatch):
    from tessera.plans import model_queries as Q
    seen = []

    def whole(df, target, task, config=None, plan_id=3, models=None, space=S.sample_params, **more):
        seen.append((target, task, config or settings(task), S.model_names(task, plan_id)
                     if models is None else models, space, more))
        return T.SupervisedRun(task, target, T.Prepared(df, [], [], None, 1.0))
    monkeypatch.setattr(T, "train_supervised", whole)
    monkeypatch.setattr(Q, "part", lambda spark, d: spark.range(1))
    assert Q.t7(spark, "").count() == 0
    assert seen == [("p_type", "classification", settings("classification"),
                     S.CLASSIFIERS + S.BOOSTED, S.sample_params, {})]
