import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sievemill.functions import rng
from sievemill.operators import ml as M


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(600).select(
        "id", rng.normal(1, "a", "id").alias("a"), F.when(F.col("id") % 50 != 0, rng.normal(1, "b", "id")).alias("b"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    signal = F.col("a") * 2 - F.coalesce("b", F.lit(0.0)) + F.when(F.col("kind") == "x", 1.5).otherwise(0.0)
    return df.withColumns({"target": signal, "label": (signal > 0.3).cast("double")}).cache()


STAGES = lambda: M.build_preprocessor(["a", "b"], ["kind"])


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boost", "svm", "logistic_regression", "decision_tree"])
def test_classifiers_learn(data, kind):
    params = {"random_forest": {"numTrees": 10}, "gradient_boost": {"maxIter": 5}}.get(kind, {})
    model = M.train(data, STAGES(), M.make_estimator(kind, "classification", params))
    scores = M.evaluate_classification(M.predict(model, data, ["id", "label"])).first()
    assert scores["accuracy"] > 0.85 and scores["f1"] > 0.85


@pytest.mark.parametrize("kind", ["linear_regression", "ridge", "lasso", "elastic_net", "random_forest", "gradient_boost", "decision_tree"])
def test_regressors_run(data, kind):
    params = {"random_forest": {"numTrees": 10}, "gradient_boost": {"maxIter": 5}, "ridge": {"regParam": 0.01}, "lasso": {"regParam": 0.01}, "elastic_net": {"regParam": 0.01}}.get(kind, {})
    df = data.withColumn("label", F.col("target"))
    model = M.train(df, STAGES(), M.make_estimator(kind, "regression", params))
    assert M.evaluate_regression(M.predict(model, df, ["id", "label"])).first()["r2"] > 0.7


def test_search_and_saved_model(data):
    est = M.make_estimator("logistic_regression", "classification")
    model = M.train(data, STAGES(), M.tune(est, "logistic_regression", "f1", {"regParam": [10.0, 0.01]}, folds=2))
    assert model.stages[-1].bestModel.getRegParam() == 0.01
    final = M.train(data, STAGES(), est)
    path = tempfile.mkdtemp(prefix="run-") + "/m"
    final.write().save(path)
    again = PipelineModel.load(path)
    rows = lambda m: sorted((r["id"], r["prediction"]) for r in M.predict(m, data, ["id"]).collect())
    assert rows(final) == rows(again)


def test_importance_names_the_features(data):
    model = M.train(data, STAGES(), M.make_estimator("decision_tree", "classification", {"maxDepth": 4}))
    rows = M.feature_importance(model, data).collect()
    assert rows[0]["feature"] == "a" and abs(sum(r["importance"] for r in rows) - 1) < 1e-9


def test_split_is_exact_per_class(spark, data):
    parts = M.split(data, "id", stratify="kind").groupBy("kind", "part").count().collect()
    assert {(r["part"], r["count"]) for r in parts} == {("test", 40), ("validation", 32), ("train", 128)}


def test_text_label_and_clusters(spark, data):
    stages = M.build_preprocessor(["a", "b"], [], "kind", "median", label_is_text=True)
    model = M.train(data.drop("label"), stages, M.make_estimator("naive_bayes", "classification", {"modelType": "gaussian"}))
    assert M.predict(model, data.drop("label"), ["id"]).count() == 600
    df = spark.createDataFrame([(float(i % 2 * 10 + i % 5 * 0.1), 0.0) for i in range(100)], "x double, y double")
    fitted = M.train(df, M.build_preprocessor(["x", "y"], scale=False), M.make_estimator("kmeans", "clustering", {"k": 2}))
    row = M.evaluate_clusters(fitted.transform(df), ["x", "y"]).first()
    assert row["n_clusters"] == 2 and row["silhouette"] > 0.95 and row["davies_bouldin"] < 0.1


def test_roc_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "s double, label int")
    pts = [(r["tpr"], round(r["fpr"], 3)) for r in M.roc_curve(df, "s").orderBy(F.desc("threshold")).collect()]
    assert pts == [(0.5, 0.0), (0.5, 0.333), (1.0, 0.667), (1.0, 1.0)]
    assert abs(M.roc_auc(df, "s").first()["roc_auc"] - 4.5 / 6) < 1e-12
