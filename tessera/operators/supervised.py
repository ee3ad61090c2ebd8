"""Supervised models: estimators by name, their search spaces, and the ones Spark ML lacks.

Regularisation is converted so that a setting means the same objective as in the usual
single-machine libraries: Spark divides the loss by the row count, and its linear regression also
scales the label.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasOutputCol
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tessera.operators.blocks import nearest, points
from tessera.operators.kernel import KernelLinear, cosines as kernel_cosines, projection
from tessera.session import written

# Model names by task; the boosted group needs plan 2.
CLASSIFIERS = ["LogisticRegression", "RandomForest", "SVC", "KNN", "DecisionTree", "NaiveBayes"]
REGRESSORS = ["LinearRegression", "Ridge", "Lasso", "DecisionTree", "RandomForest", "KNN", "SVR"]
BOOSTED = ["GradientBoosting", "XGBoost", "LightGBM", "CatBoost"]
POLYNOMIAL_MODELS = {"LogisticRegression", "LinearRegression", "Ridge", "Lasso"}
WEIGHTED_MODELS = {"LogisticRegression", "RandomForest", "SVC", "DecisionTree"}

NO_DEPTH_LIMIT = 30
"""Deepest tree Spark grows; stands for "no limit"."""
ROWS_A_TASK = 500_000


def model_names(task: str, plan_id: int = 3) -> list[str]:
    names = list(CLASSIFIERS if task == "classification" else REGRESSORS)
    return names + (BOOSTED if plan_id >= 2 else [])


# ---------------------------------------------------------------- nearest neighbours

class KNearest(Estimator, HasFeaturesCol):
    """k nearest neighbours as an exact block join of the scored rows with the training rows.

    ``classes`` > 0 votes for a class and gives probabilities; 0 averages the label. The table
    needs the key column ``_rid``.
    """

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k: int = 5, weights: str = "uniform", classes: int = 0,
                 featuresCol: str = "features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(k=5, weights="uniform", classes=0, featuresCol="features")

    def _fit(self, dataset: DataFrame) -> "KNearestModel":
        train = written(dataset.select(
            F.col("_rid").alias("id"), vector_to_array(self.getFeaturesCol()).alias("vec"),
            F.col("label").cast("double").alias("label")), "knn")
        return KNearestModel(train, self.getOrDefault("k"), self.getOrDefault("weights"),
                             self.getOrDefault("classes"), self.getFeaturesCol())


class KNearestModel(Model):
    def __init__(self, train: DataFrame, k: int, weights: str, classes: int, features: str):
        super().__init__()
        self.train, self.k, self.weights = train, k, weights
        self.classes, self.features = classes, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        q = points(dataset.withColumn("_v", vector_to_array(self.features)), "_rid", "_v")
        near = nearest(q, self.train, self.k, carry="label")
        if self.weights == "distance":
            # An exact match outweighs everything else.
            near = near.join(near.groupBy("id").agg(F.min("dist").alias("least")), "id")
            w = F.when(F.col("least") == 0, (F.col("dist") == 0).cast("double")).otherwise(
                1 / F.col("dist"))
        else:
            w = F.lit(1.0)
        near = near.withColumn("w", w)
        total = F.sum("w")
        if self.classes:
            votes = F.array(*[F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)) / total
                              for c in range(self.classes)])
            out = near.groupBy("id").agg(votes.alias("_p")).select(
                F.col("id").alias("_rid"), array_to_vector("_p").alias("probability"),
                (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("prediction"))
        else:
            out = near.groupBy("id").agg((F.sum(F.col("w") * F.col("label")) / total)
                                         .alias("prediction")).withColumnRenamed("id", "_rid")
        return dataset.join(out, "_rid")


# ---------------------------------------------------------------- kernel features

class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                            DefaultParamsWritable):
    """Random cosine features whose inner products approach the RBF kernel exp(−γ‖x−y‖²)
    (Rahimi and Recht, "Random Features for Large-Scale Kernel Machines", NIPS 2007)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, gamma: float = 1.0, size: int = 128, seed: int = 42,
                 inputCol: str = "features", outputCol: str = "kernel_features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(gamma=1.0, size=128, seed=42, inputCol="features",
                         outputCol="kernel_features")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in ("gamma", "size", "seed"))

        @F.pandas_udf("array<double>")
        def cosines(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy()).astype(float)
            return pd.Series(list(kernel_cosines(x, *projection(x.shape[1], gamma, size, seed))))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(
            cosines(vector_to_array(self.getInputCol()))))


class LabelScale(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``scaled_label`` where there is a label: robust losses expect a label of unit scale."""

    sd = Param(Params._dummy(), "sd", "deviation of the label", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, sd: float = 1.0):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(sd=1.0)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if "label" not in dataset.columns:
            return dataset
        return dataset.withColumn("scaled_label", F.col("label") / self.getOrDefault("sd"))


# ---------------------------------------------------------------- estimators by name

def default_params(name: str, task: str) -> dict[str, Any]:
    """Settings of the baseline."""
    return {
        "LogisticRegression": {"C": 1.0}, "LinearRegression": {}, "Ridge": {"alpha": 1.0},
        "Lasso": {"alpha": 1.0}, "NaiveBayes": {},
        "RandomForest": {"n_estimators": 100, "max_depth": None},
        "DecisionTree": {"max_depth": None}, "SVC": {"C": 1.0, "gamma": "scale"},
        "SVR": {"C": 1.0}, "KNN": {"n_neighbors": 5, "weights": "uniform"},
        "GradientBoosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
        "XGBoost": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6},
        "LightGBM": {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31},
        "CatBoost": {"iterations": 1000, "learning_rate": 0.03, "depth": 6},
    }[name]


CLASSES, NUMBERS = ("classification",), ("regression",)
BOTH = CLASSES + NUMBERS

# Search ranges. Kinds: "int" and "float" are uniform between two ends (both
# included), "log" is log-uniform, "choice" takes one of the values.
SEARCH_SPACE = [
    # model, tasks, parameter, kind, low and high or the values
    ("LogisticRegression", BOTH, "C", "log", (1e-3, 1e2)),
    ("Ridge", BOTH, "alpha", "log", (0.01, 100)),
    ("Lasso", BOTH, "alpha", "log", (0.001, 1)),
    ("RandomForest", CLASSES, "n_estimators", "int", (100, 600)),
    ("RandomForest", CLASSES, "max_depth", "choice", (None, 5, 10, 15, 20)),
    ("RandomForest", CLASSES, "min_samples_split", "int", (2, 10)),
    ("RandomForest", NUMBERS, "n_estimators", "int", (50, 500)),
    ("RandomForest", NUMBERS, "max_depth", "int", (5, 30)),
    ("DecisionTree", CLASSES, "max_depth", "choice", (None, 5, 10, 15, 20)),
    ("DecisionTree", CLASSES, "min_samples_split", "int", (2, 10)),
    ("DecisionTree", NUMBERS, "max_depth", "int", (3, 30)),
    ("SVC", BOTH, "C", "log", (1e-2, 1e2)),
    ("SVC", BOTH, "gamma", "choice", ("scale", "auto")),
    ("SVR", BOTH, "C", "float", (0.1, 5)),
    ("KNN", CLASSES, "n_neighbors", "int", (3, 30)),
    ("KNN", CLASSES, "weights", "choice", ("uniform", "distance")),
    ("KNN", NUMBERS, "n_neighbors", "int", (2, 15)),
    ("GradientBoosting", BOTH, "n_estimators", "int", (100, 500)),
    ("GradientBoosting", BOTH, "learning_rate", "float", (0.01, 0.2)),
    ("GradientBoosting", CLASSES, "max_depth", "int", (2, 6)),
    ("GradientBoosting", NUMBERS, "max_depth", "int", (3, 10)),
    ("XGBoost", CLASSES, "n_estimators", "int", (100, 800)),
    ("XGBoost", NUMBERS, "n_estimators", "int", (100, 500)),
    ("XGBoost", BOTH, "max_depth", "int", (3, 10)),
    ("XGBoost", BOTH, "learning_rate", "float", (0.01, 0.3)),
    ("LightGBM", CLASSES, "n_estimators", "int", (100, 800)),
    ("LightGBM", NUMBERS, "n_estimators", "int", (100, 500)),
    ("LightGBM", CLASSES, "num_leaves", "int", (20, 120)),
    ("LightGBM", NUMBERS, "num_leaves", "int", (20, 100)),
    ("LightGBM", BOTH, "learning_rate", "float", (0.01, 0.3)),
    ("CatBoost", CLASSES, "depth", "int", (4, 10)),
    ("CatBoost", NUMBERS, "depth", "int", (3, 10)),
    ("CatBoost", CLASSES, "iterations", "int", (200, 800)),
    ("CatBoost", NUMBERS, "iterations", "int", (100, 500)),
    ("CatBoost", BOTH, "learning_rate", "float", (0.01, 0.3)),
]

_DRAWS = {
    "int": lambda g, v: int(g.integers(v[0], v[1] + 1)),
    "float": lambda g, v: float(g.uniform(*v)),
    "log": lambda g, v: float(math.exp(g.uniform(math.log(v[0]), math.log(v[1])))),
    "choice": lambda g, v: v[int(g.integers(len(v)))],
}


def sample_params(name: str, task: str, g: np.random.Generator) -> dict[str, Any]:
    """One draw from the model's search space; models without one get no parameters."""
    kind = task if task in CLASSES else NUMBERS[0]
    return {param: _DRAWS[draw](g, values) for model, tasks, param, draw, values in SEARCH_SPACE
            if model == name and kind in tasks}


def _trees(params: dict[str, Any]) -> tuple[int, int, float]:
    """Depth, number and rate of boosted trees, whichever way they are named."""
    depth = params.get("max_depth") or params.get("depth")
    if depth is None:
        depth = max(2, math.ceil(math.log2(params.get("num_leaves", 31))))
    return (min(int(depth), NO_DEPTH_LIMIT),
            int(params.get("n_estimators") or params.get("iterations") or 100),
            float(params.get("learning_rate", 0.1)))


def estimator(name: str, task: str, params: dict[str, Any], *, n: float, width: int,
              classes: int = 0, label_sd: float = 1.0, feature_var: float = 1.0,
              weight: str | None = None, seed: int = 42) -> Estimator:
    """An unfitted estimator over ``features`` and ``label``.

    ``n`` is the number of training rows, or the sum of their weights; ``label_sd`` the population
    deviation of the label.
    """
    w = {"weightCol": weight} if weight and name in WEIGHTED_MODELS else {}
    depth = params.get("max_depth") or NO_DEPTH_LIMIT
    leaf = max(1, int(params.get("min_samples_split", 2)) // 2)
    if name == "LogisticRegression":
        return LogisticRegression(maxIter=1000, regParam=1.0 / (params.get("C", 1.0) * n),
                                  standardization=False, **w)
    if name == "LinearRegression":
        return LinearRegression(regParam=0.0)
    if name == "Ridge":
        alpha = params.get("alpha", 1.0)
        return LinearRegression(elasticNetParam=0.0, standardization=False,
                                regParam=alpha * label_sd / n,
                                solver="normal" if width <= 4096 else "auto")
    if name == "Lasso":
        return LinearRegression(elasticNetParam=1.0, standardization=False, maxIter=1000,
                                regParam=params.get("alpha", 1.0))
    if name == "NaiveBayes":
        return NaiveBayes(modelType="gaussian")
    if name == "KNN":
        return KNearest(k=params.get("n_neighbors", 5), weights=params.get("weights", "uniform"),
                        classes=classes)
    if name in ("SVC", "SVR"):
        gamma = 1.0 / width if params.get("gamma") == "auto" else 1.0 / (
            width * max(feature_var, 1e-12))
        kernel = {"gamma": gamma, "size": min(512, max(64, 8 * width)), "seed": seed,
                  "reg": 1.0 / (params.get("C", 1.0) * n)}
        if name == "SVR":
            sd = float(label_sd) or 1.0
            return Pipeline(stages=[
                LabelScale(sd=sd),
                KernelLinear(label="scaled_label", output="scaled_prediction", **kernel),
                SQLTransformer(statement=f"SELECT *, scaled_prediction * {sd!r} AS prediction "
                                         "FROM __THIS__")])
        margin = KernelLinear(classes=max(2, classes), most=50, weight=w.get("weightCol", ""),
                              **kernel)
        # Probabilities from the margins (Platt).
        return Pipeline(stages=[margin, LogisticRegression(
            featuresCol="rawPrediction", rawPredictionCol="platt", maxIter=100)])
    if name == "RandomForest":
        cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
        if task != "classification":
            w["featureSubsetStrategy"] = "all"
        return cls(numTrees=int(params.get("n_estimators", 100)), maxDepth=depth, maxBins=256,
                   minInstancesPerNode=leaf, seed=seed, **w)
    if name == "DecisionTree":
        cls = DecisionTreeClassifier if task == "classification" else DecisionTreeRegressor
        return cls(maxDepth=depth, maxBins=256, minInstancesPerNode=leaf, seed=seed, **w)
    if name in BOOSTED:
        d, trees, rate = _trees(params)
        if task != "classification":
            return GBTRegressor(maxDepth=d, maxIter=trees, stepSize=rate, seed=seed)
        gbt = GBTClassifier(maxDepth=d, maxIter=trees, stepSize=rate, seed=seed)
        return gbt if classes == 2 else OneVsRest(classifier=gbt, rawPredictionCol="rawPrediction")
    raise ValueError(f"unknown model {name}")


def spread(df: DataFrame, rows: int, most: int = ROWS_A_TASK) -> DataFrame:
    """``df`` in partitions of about ``most`` rows where its own hold more: boosted trees keep and
    read their rows by the partitions that they are given."""
    if rows <= most * df.rdd.getNumPartitions():
        return df
    return df.repartition(-(-rows // most))


def scores_array(predicted: DataFrame):
    """The per-class scores of a prediction table as an array column."""
    for c in ("probability", "rawPrediction"):
        if c in predicted.columns:
            return vector_to_array(F.col(c))
    return None


def feature_importance(model: Any, features: list[str], spark) -> DataFrame | None:
    """``(feature, importance)`` in descending order, for models that have it."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "models") and all(hasattr(m, "featureImportances") for m in last.models):
        values = np.mean([m.featureImportances.toArray() for m in last.models], axis=0)
    else:
        return None
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)],
                                 "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")
