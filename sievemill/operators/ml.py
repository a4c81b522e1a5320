"""Classical machine learning on tables with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import clustering as MK
from pyspark.ml import regression as MR
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions import rng
from sievemill.operators.ordered import ordered_scan


def build_preprocessor(
    numeric: Sequence[str], categorical: Sequence[str] = (), label: str | None = None, missing: str = "mean", scale: bool = True,
    label_is_text: bool = False,
) -> list:
    """Stages: impute, index and one-hot encode, assemble, scale; text labels are indexed too.

    ``missing`` is mean, median, mode or drop.
    """
    stages: list = []
    nums = list(numeric)
    if missing != "drop" and nums:
        filled = [f"{c}__filled" for c in nums]
        stages.append(Imputer(strategy=missing, inputCols=nums, outputCols=filled))
        nums = filled
    inputs = list(nums)
    if categorical:
        codes, hots = [f"{c}__code" for c in categorical], [f"{c}__hot" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=codes, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=codes, outputCols=hots, dropLast=False, handleInvalid="keep"))
        inputs += hots
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="skip" if missing == "drop" else "error"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    else:
        stages[-1].setOutputCol("features")
    if label and label_is_text:
        stages.append(StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip"))
    return stages


def split(df: DataFrame, key: str, test: float = 0.2, validation: float = 0.2, stratify: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``part`` = train / validation / test.

    Membership hangs on a hash of the row key, so it survives re-runs.  With ``stratify`` each class is
    cut at exact counts along the hash order, in a scan that splits large classes.
    """
    if stratify is None:
        u = rng.uniform(seed, "split", key)
        v = rng.uniform(seed, "split.validation", key)
        return df.withColumn("part", F.when(u < test, "test").when(v < validation, "validation").otherwise("train"))
    hashed = df.withColumn("_h", rng.bits(seed, "split", key))
    sizes = df.groupBy(F.col(stratify).alias("_c")).agg(F.count(F.lit(1)).alias("_size"))
    numbered = ordered_scan(hashed, ["_h", key], [stratify], number="_n").join(sizes, F.col(stratify).eqNullSafe(F.col("_c")))
    tests = F.round(F.col("_size") * test)
    checks = F.round((F.col("_size") - tests) * validation)
    part = F.when(F.col("_n") <= tests, "test").when(F.col("_n") <= tests + checks, "validation").otherwise("train")
    return numbered.withColumn("part", part).select(*df.columns, "part")


_CLASSIFIERS = {
    "random_forest": MC.RandomForestClassifier, "gradient_boost": MC.GBTClassifier, "svm": MC.LinearSVC, "logistic_regression": MC.LogisticRegression,
    "decision_tree": MC.DecisionTreeClassifier, "naive_bayes": MC.NaiveBayes, "neural_network": MC.MultilayerPerceptronClassifier,
}
_REGRESSORS = {
    "random_forest": MR.RandomForestRegressor, "gradient_boost": MR.GBTRegressor, "decision_tree": MR.DecisionTreeRegressor,
    "linear_regression": MR.LinearRegression, "ridge": MR.LinearRegression, "lasso": MR.LinearRegression, "elastic_net": MR.LinearRegression,
}
_PENALTY = {"ridge": {"regParam": 1.0, "elasticNetParam": 0.0}, "lasso": {"regParam": 1.0, "elasticNetParam": 1.0}, "elastic_net": {"regParam": 1.0, "elasticNetParam": 0.5}}


def make_estimator(kind: str, task: str, params: Mapping | None = None, seed: int = 42):
    """Spark ML estimator by model name and task (classification, regression, clustering)."""
    params = dict(params or {})
    if task == "clustering":
        if kind != "kmeans":
            raise ValueError(f"unknown clustering {kind}")
        return MK.KMeans(featuresCol="features", seed=seed, **params)
    table = _CLASSIFIERS if task == "classification" else _REGRESSORS
    if kind not in table:
        raise ValueError(f"unknown {task} model {kind}")
    cls = table[kind]
    settings = {**_PENALTY.get(kind, {}), **params, "featuresCol": "features", "labelCol": "label"}
    if hasattr(cls, "seed"):
        settings.setdefault("seed", seed)
    return cls(**settings)


# --- fixed values: searched parameters per model ----------------------------------------------------
GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]},
    "gradient_boost": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
    "svm": {"regParam": [10.0, 1.0, 0.1]},
    "logistic_regression": {"regParam": [100.0, 10.0, 1.0, 0.1]},
    "ridge": {"regParam": [0.01, 0.1, 1.0, 10.0]},
    "lasso": {"regParam": [0.01, 0.1, 1.0, 10.0]},
}
SCORES = {
    "accuracy": ("multiclass", "accuracy"), "precision": ("multiclass", "weightedPrecision"), "recall": ("multiclass", "weightedRecall"),
    "f1": ("multiclass", "f1"), "roc_auc": ("binary", "areaUnderROC"), "mse": ("regression", "mse"), "mae": ("regression", "mae"), "r2": ("regression", "r2"),
}
# -----------------------------------------------------------------------------------------------------


def evaluator(score: str):
    kind, metric = SCORES[score]
    cls = {"multiclass": MulticlassClassificationEvaluator, "binary": BinaryClassificationEvaluator, "regression": RegressionEvaluator}[kind]
    return cls(metricName=metric, labelCol="label")


def tune(estimator, kind: str, score: str, grid: Mapping[str, Sequence] | None = None, folds: int = 5, parallelism: int = 4, seed: int = 42) -> CrossValidator:
    """Grid search with k-fold cross-validation, folds fitted side by side."""
    builder = ParamGridBuilder()
    for name, values in (GRIDS.get(kind, {}) if grid is None else grid).items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator(score), numFolds=folds, parallelism=parallelism, seed=seed)


def train(df: DataFrame, stages: Sequence, estimator) -> PipelineModel:
    """Preprocessing and model fitted as one unit, which is also what is saved."""
    return Pipeline(stages=[*stages, estimator]).fit(df)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions with all preprocessing applied; class probabilities as an array when there are any."""
    out = model.transform(df)
    probability = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
    return out.select(*keep, "prediction", *probability)


def evaluate_classification(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and weighted precision, recall, F1, from the confusion matrix."""
    cells = confusion_matrix(pred, label, prediction)
    actual = cells.groupBy("label").agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    guessed = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("guessed"))
    per_class = actual.join(guessed, "label", "left").na.fill(0, ["guessed"])
    precision = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0)
    recall = F.col("hit") / F.col("actual")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    total = F.sum("actual")
    return per_class.agg(
        (F.sum("hit") / total).alias("accuracy"), (F.sum(precision * F.col("actual")) / total).alias("precision"),
        (F.sum(recall * F.col("actual")) / total).alias("recall"), (F.sum(f1 * F.col("actual")) / total).alias("f1"),
    )


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def roc_curve(pred: DataFrame, score: str, label: str = "label") -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, highest first.

    Rows of one score are counted first; the cumulated counts come from an ordered scan, so no task
    sees all scores of a large table.
    """
    counted = pred.groupBy((-F.col(score)).alias("_neg")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n")
    )
    totals = pred.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("P"), F.count(F.lit(1)).alias("N")).first()
    p, n = totals["P"], totals["N"] - totals["P"]
    summed = ordered_scan(counted, ["_neg"], sums={"tp": F.col("p"), "fp": F.col("n")})
    return summed.select((-F.col("_neg")).alias("threshold"), (F.col("tp") / p).alias("tpr"), (F.col("fp") / n).alias("fpr"),
                         F.col("p").alias("positives"), F.col("n").alias("negatives"), "tp")


def roc_auc(pred: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Area under the curve by trapezoids over the distinct scores."""
    totals = pred.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("P"), F.count(F.lit(1)).alias("N")).first()
    p, n = totals["P"], totals["N"] - totals["P"]
    area = F.sum(F.col("negatives") * (F.col("tp") - F.col("positives") / 2.0)) / F.lit(float(p) * float(n))
    return roc_curve(pred, score, label).agg(area.alias("roc_auc"))


def evaluate_regression(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mse, mae, rmse, r2.  The mean of the label is taken first, which keeps r2 stable."""
    mean = pred.agg(F.avg(label).alias("m")).first()["m"]
    err = F.col(label) - F.col(prediction)
    base = F.sum(F.pow(F.col(label) - F.lit(mean), 2))
    return pred.agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), (1 - F.sum(err * err) / base).alias("r2"))


def davies_bouldin(pred: DataFrame, cols: Sequence[str], cluster: str = "prediction") -> DataFrame:
    """Davies-Bouldin index from centroids and mean distances: two grouped aggregates over the rows,
    then work on one row per cluster."""
    cols = list(cols)
    centres = pred.groupBy(F.col(cluster).alias("c")).agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(cols)])
    centre_rows = centres.collect()  # as many as there are clusters
    where = {r["c"]: [r[f"m_{i}"] for i in range(len(cols))] for r in centre_rows}
    middle = None
    for c, point in where.items():
        away = F.sqrt(sum((F.pow(F.col(x) - F.lit(point[i]), 2) for i, x in enumerate(cols)), F.lit(0.0)))
        middle = F.when(F.col(cluster) == c, away) if middle is None else middle.when(F.col(cluster) == c, away)
    spread = {r["c"]: r["s"] for r in pred.groupBy(F.col(cluster).alias("c")).agg(F.avg(middle).alias("s")).collect()}
    worst = []
    for a in where:
        ratios = []
        for b in where:
            gap = sum((x - y) ** 2 for x, y in zip(where[a], where[b])) ** 0.5
            if a != b and gap > 0:
                ratios.append((spread[a] + spread[b]) / gap)
        worst.append(max(ratios) if ratios else 0.0)
    value = sum(worst) / len(worst) if worst else None
    return pred.sparkSession.createDataFrame([(len(where), value)], "n_clusters int, davies_bouldin double")


def evaluate_clusters(pred: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Silhouette (on squared distances, one pass per cluster) and Davies-Bouldin."""
    db = davies_bouldin(pred, cols).first()
    silhouette = ClusteringEvaluator(featuresCol="features").evaluate(pred) if db["n_clusters"] > 1 else None
    return pred.sparkSession.createDataFrame(
        [(db["n_clusters"], db["davies_bouldin"], silhouette)], "n_clusters int, davies_bouldin double, silhouette double"
    )


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance), highest first: tree importances, or absolute coefficients (their mean
    over the classes when there are several)."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = abs(last.coefficients.toArray())
    schema = model.transform(df.limit(1)).schema
    meta = schema["raw_features" if "raw_features" in schema.names else "features"].metadata
    names = {}
    for group in meta.get("ml_attr", {}).get("attrs", {}).values():
        names |= {a["idx"]: a.get("name", f"feature_{a['idx']}") for a in group}
    rows = [(names.get(i, f"feature_{i}").replace("__filled", "").replace("__hot", ""), float(v)) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "feature string, importance double")
