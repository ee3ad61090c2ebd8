"""Supervised runs: split, baseline, seeded search, refit, evaluation and ranking."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from multiprocessing.pool import ThreadPool
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tessera.config import settings
from tessera.functions import metrics as M
from tessera.operators import features as X, supervised as S
from tessera.operators.clean import ROW_KEY, clean, separate, with_row_key
from tessera.session import written

log = logging.getLogger(__name__)

Progress = Callable[[int, str | None], None]

# Fixed value: key under which the model at a place of the ranking is shown.
RESULT_KEY = "топ-{} модель"


@dataclass
class Prepared:
    """One written table with the label, the flag of the test part, folds and feature vectors."""

    table: DataFrame
    features: list[str]
    poly_features: list[str]
    scaling: X.Scaling
    n_train: float
    classes: int = 0
    label_sd: float = 1.0
    feature_var: float = 1.0
    weight: str | None = None
    imbalanced: bool = False
    target_codes: DataFrame | None = None
    transform: str | None = None
    category_codes: DataFrame | None = None
    per_fold: dict[int, tuple[int, float, float]] = field(default_factory=dict)

    def train(self) -> DataFrame:
        return self.table.where("NOT is_test")

    def test(self) -> DataFrame:
        return self.table.where("is_test")

    def view(self, df: DataFrame, name: str) -> DataFrame:
        """Rows with the vector this model reads as ``features``."""
        col = "poly" if name in S.POLYNOMIAL_MODELS else "base"
        extra = [self.weight] if self.weight else []
        return df.select(ROW_KEY, "label", "fold", *extra, F.col(col).alias("features"))

    def width(self, name: str) -> int:
        return len(self.names(name))

    def names(self, name: str) -> list[str]:
        return self.poly_features if name in S.POLYNOMIAL_MODELS else self.features


def _poly_vector(col: str):
    """Degrees 1 and 2 of an array column in the order of ``polynomial_names``, at any width."""
    x = F.col(col)
    return array_to_vector(F.concat(x, F.flatten(F.transform(x, lambda a, i: F.transform(
        F.slice(x, i + 1, F.size(x) - i), lambda b: a * b)))))


def prepare(df: DataFrame, target: str, task: str, config: SimpleNamespace,
            drop: Sequence[str] = (), id_match: str = "substring",
            models: Sequence[str] | None = None) -> Prepared:
    """Clean, encode, split and scale a raw table; every fit statistic comes from the train part.

    Polynomial vectors are made only if one of ``models`` (none named: all) reads them.
    """
    separate(df, target, task)
    cleaned = clean(df, task, drop, target, id_match, snapshot=True)
    cats = [c for c in cleaned.low + cleaned.high if c != target]
    codes = written(X.category_map(cleaned.df, cats, few=cleaned.low), "codes") if cats else None
    data = X.encode_ordinal(cleaned.df, cats, codes) if cats else cleaned.df
    keyed = with_row_key(data, distinct=True)
    features = [c for c in data.columns if c != target and c in [
        *cats, *[f for f in cleaned.numeric]]]
    if not features:
        raise ValueError("no usable feature columns")
    target_codes, transform = None, None
    if task == "classification":
        target_codes = written(X.target_codes(keyed, target), "target")
        keyed = X.encode_target(keyed, target, target_codes)
        stratum = "label"
    else:
        keyed, transform = X.log_target(keyed, target, config.skew_threshold, "label")
        keyed = written(keyed, "labelled")
        keyed = keyed.withColumn("stratum", X.quantile_bin("label", X.quantile_edges(
            keyed, "label")))
        stratum = "stratum"
    keyed = keyed.select(ROW_KEY, "label", *([stratum] if stratum != "label" else []), *[
        F.col(f"`{c}`").cast("double").alias(c) for c in features])
    keyed = written(keyed, "keyed")
    split = X.stratified_split(keyed, stratum, [ROW_KEY], config.test_size, config.seed)
    split = written(X.stratified_folds(written(split, "flagged"), ["is_test", stratum], ROW_KEY,
                                       config.cv_folds, config.seed + 1), "split")
    train = split.where("NOT is_test")
    scaling = X.fit_standard(train, features)
    scaled = scaling.apply(split).withColumn("label", F.col("label").cast("double"))
    weight, imbalanced, classes = None, False, 0
    if task == "classification":
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(
            F.count("*").alias("n")).collect()}
        classes = target_codes.count()
        imbalanced = min(counts.values()) / max(counts.values()) < config.imbalance_threshold
        if imbalanced and config.use_class_weights:
            weight = "weight"
            total = sum(counts.values())
            cells = [x for c, n in counts.items() for x in (
                F.lit(float(c)), F.lit(total / (len(counts) * n)))]
            scaled = scaled.withColumn("weight", F.create_map(*cells)[F.col("label")])
    wanted = models is None or bool(S.POLYNOMIAL_MODELS.intersection(models))
    poly = [n for _, _, n in X.polynomial_names(features)] if wanted else []
    vectors = scaled.select(ROW_KEY, "label", "is_test", "fold", *([weight] if weight else []),
                            F.array(*[F.col(f"`{c}`") for c in features]).alias("values"))
    table = written(vectors.select(
        *[c for c in vectors.columns if c != "values"], array_to_vector("values").alias("base"),
        *([_poly_vector("values").alias("poly")] if wanted else [])), "prepared")
    per_fold = {r["fold"]: (r["n"], r["m"], r["v"]) for r in table.where("NOT is_test").groupBy(
        "fold").agg(F.count("*").alias("n"), F.avg("label").alias("m"),
                    F.var_pop("label").alias("v")).collect()}
    n_train, sd = _pooled(list(per_fold.values()))
    return Prepared(table, features, poly, scaling, n_train, classes, sd, 1.0, weight, imbalanced,
                    target_codes, transform, codes, per_fold)


def _pooled(parts: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    """Rows and population deviation of parts with known (rows, mean, variance)."""
    n = float(sum(c for c, *_ in parts))
    mean = sum(c * m for c, m, _ in parts) / n
    return n, math.sqrt(sum(c * (v + (m - mean) ** 2) for c, m, v in parts) / n) or 1.0


def build(p: Prepared, name: str, task: str, params: dict, seed: int, without: int | None = None):
    """The estimator for the train part, or for the train part without one fold."""
    n, sd = _pooled([v for k, v in p.per_fold.items() if k != without])
    return S.estimator(name, task, params, n=n, width=p.width(name), classes=p.classes,
                       label_sd=sd, feature_var=p.feature_var, weight=p.weight, seed=seed)


def baseline(p: Prepared, names: Sequence[str], task: str, metric: str, config) -> dict[str, float]:
    """Main metric on the test part of every model with default settings."""
    def one(name: str) -> tuple[str, float]:
        try:
            model = build(p, name, task, S.default_params(name, task), config.seed).fit(
                p.view(p.train(), name))
            return name, M.measure(model.transform(p.view(p.test(), name)), metric)
        except Exception as ex:  # a model that cannot be fitted is ranked last
            log.warning("%s failed: %s", name, ex)
            return name, float("-inf")

    with ThreadPool(config.parallelism) as pool:
        return dict(pool.map(one, names))


def cross_validated(p: Prepared, name: str, task: str, params: dict, metric: str, config) -> float:
    """Mean metric over the folds of the train part; a failing fit counts as −inf."""
    train = p.view(p.train(), name)
    scores = []
    for fold in range(config.cv_folds):
        try:
            fit_rows = train.where(F.col("fold") != fold)
            model = build(p, name, task, params, config.seed, fold).fit(fit_rows)
            scores.append(M.measure(model.transform(train.where(F.col("fold") == fold)), metric))
        except Exception as ex:
            log.warning("%s %s failed: %s", name, params, ex)
            return float("-inf")
    return float(np.mean(scores))


def search(p: Prepared, name: str, task: str, metric: str, config,
           space: Callable[[str, str, np.random.Generator], dict] = S.sample_params
           ) -> tuple[dict, float]:
    """Best of ``n_iter`` seeded draws by cross-validated metric."""
    rng = np.random.default_rng(config.seed)
    draws = []
    for _ in range(config.n_iter):
        d = space(name, task, rng)
        if d not in draws:
            draws.append(d)
    if draws == [{}]:
        return {}, float("nan")
    with ThreadPool(config.parallelism) as pool:
        scores = pool.map(lambda d: cross_validated(p, name, task, d, metric, config), draws)
    at = int(np.argmax(scores))
    return draws[at], scores[at]


@dataclass
class ModelResult:
    name: str
    params: dict[str, Any]
    metrics: dict[str, float]
    model: Any
    features: list[str]
    predictions: DataFrame
    confusion: DataFrame | None
    importance: DataFrame | None
    start: datetime
    finish: datetime


@dataclass
class SupervisedRun:
    task: str
    target: str
    prepared: Prepared
    results: list[ModelResult] = field(default_factory=list)
    baseline: dict[str, float] = field(default_factory=dict)

    def leaderboard(self) -> DataFrame:
        """One row per model, best first, keyed as results are shown."""
        spark = self.prepared.table.sparkSession
        rows = [(i, RESULT_KEY.format(i), r.name, {k: str(v) for k, v in r.params.items()},
                 r.metrics, r.features, self.prepared.transform,
                 "binary" if self.prepared.classes == 2 else
                 "multiclass" if self.prepared.classes else "regression",
                 self.prepared.imbalanced, r.start, r.finish)
                for i, r in enumerate(self.results, 1)]
        return spark.createDataFrame(
            rows, "place int, key string, model_name string, hyperparams map<string,string>, "
                  "metrics map<string,double>, selected_features array<string>, "
                  "target_transform string, task_type string, is_imbalanced boolean, "
                  "train_start timestamp, train_finish timestamp")


def evaluate(p: Prepared, task: str, predicted: DataFrame) -> tuple[dict, DataFrame | None]:
    """Metrics of a test prediction, and its confusion cells for classification."""
    if task == "regression":
        rows = {k: float(v) for k, v in M.regression_metrics(
            predicted, "label", "prediction").first().asDict().items()}
        if p.transform == "log1p":
            back = predicted.select(F.expm1("label").alias("label"),
                                    F.expm1("prediction").alias("prediction"))
            rows |= {f"{k}_original": float(v) for k, v in M.regression_metrics(
                back, "label", "prediction").first().asDict().items()}
        return rows, None
    out = {}
    if p.imbalanced:
        out["f1_score"] = M.measure(predicted, "f1" if p.classes == 2 else "f1_macro")
    else:
        out["accuracy"] = M.measure(predicted, "accuracy")
    scores = S.scores_array(predicted)
    if scores is not None:
        scored = predicted.select("label", scores.alias("s"))
        auc = (M.auc_binary(scored.select("label", F.col("s")[1].alias("s")), "label", "s")
               if p.classes == 2 else M.auc_macro(scored, "label", "s")).first()[0]
        if auc is not None:
            out["roc_auc"] = float(auc)
    return out, M.confusion(predicted, "label", "prediction")


def train_supervised(df: DataFrame, target: str, task: str, config=None, plan_id: int = 3,
                     models: Sequence[str] | None = None, drop: Sequence[str] = (),
                     progress: Progress | None = None, id_match: str = "substring",
                     space: Callable = S.sample_params) -> SupervisedRun:
    """The whole run for one target."""
    config = config or settings(task)
    tell = progress or (lambda step, model=None: None)
    tell(1, None)
    names = [n for n in S.model_names(task, plan_id) if models is None or n in models]
    p = prepare(df, target, task, config, drop, id_match, names)
    metric = M.main_metric(task, p.classes, p.imbalanced)
    run = SupervisedRun(task, target, p, baseline=baseline(p, names, task, metric, config))
    ranked = sorted(names, key=lambda n: (-run.baseline[n], names.index(n)))[:config.top_n_models]
    for name in ranked:
        if run.baseline[name] == float("-inf"):
            continue
        tell(2, name)
        start = datetime.now(timezone.utc)
        params, _ = search(p, name, task, metric, config, space)
        model = build(p, name, task, params, config.seed).fit(p.view(p.train(), name))
        predicted = written(model.transform(p.view(p.test(), name)), "predicted")
        tell(3, name)
        metrics, cells = evaluate(p, task, predicted)
        tell(4, name)
        importance = S.feature_importance(model, p.names(name), df.sparkSession)
        run.results.append(ModelResult(name, params, metrics, model, p.names(name), predicted,
                                       cells, importance, start, datetime.now(timezone.utc)))
    tell(5, None)
    return run


def run_task(df: DataFrame, task: str, target: str | None = None, config=None, plan_id: int = 3,
             **options):
    """Dispatch by task name; any name other than clustering and regression is classification."""
    if task == "clustering":
        from tessera.plans.cluster_flow import train_clustering
        if plan_id <= 1:
            raise ValueError("clustering needs plan 2")
        return train_clustering(cluster_points(df, options.pop("drop", ())), config
                                or settings("clustering"), plan_id, **options)
    if target is None:
        raise ValueError("target is required")
    kind = "regression" if task == "regression" else "classification"
    return train_supervised(df, target, kind, config, plan_id, **options)


def cluster_points(df: DataFrame, drop: Sequence[str] = (), scale: bool = True) -> DataFrame:
    """Clean a table and turn it into points: scaled numbers, one-hot and hashed text."""
    cleaned = clean(df, "clustering", drop)
    data = written(with_row_key(written(cleaned.df, "cleaned")), "points")
    nums = cleaned.numeric
    if scale and nums:
        data = X.fit_robust(data, nums).apply(data)
    parts = [F.array(*[F.col(f"`{c}`").cast("double") for c in nums])] if nums else []
    if cleaned.low:
        codes = X.category_map(data, cleaned.low, few=cleaned.low)
        data, hot = X.one_hot(data, cleaned.low, codes)
        parts.append(F.array(*[F.col(f"`{c}`").cast("double") for c in hot]))
    if cleaned.high:
        data = X.hash_slots(data, cleaned.high)
        parts.append(F.col("hashed"))
    vec = F.concat(*parts)
    out = data.select(F.col(ROW_KEY).alias("id"), vec.alias("vec"))
    return X.compress_if_wide(out, "vec", "clustering", "vec")[0]


def ordinal_points(df: DataFrame, drop: Sequence[str] = (), scale: bool = True):
    """Points from numbers and category codes, with the preparation that scores new rows alike."""
    from tessera.operators.score import Artifact
    cleaned = clean(df, "clustering", drop, snapshot=True)
    cats = cleaned.low + cleaned.high
    codes = written(X.category_map(cleaned.df, cats, few=cleaned.low), "codes") if cats else None
    data = X.encode_ordinal(cleaned.df, cats, codes) if cats else cleaned.df
    features = [c for c in data.columns if c in [*cleaned.numeric, *cats]]
    data = written(with_row_key(written(data.select(*features), "cleaned")), "points")
    scaling = X.fit_robust(data, features) if scale else X.Scaling({}, {})
    prep = Artifact("clustering", "clustering", features, scaling, category_codes=codes)
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    points = scaling.apply(data).select(F.col(ROW_KEY).alias("id"), vec.alias("vec"))
    points, prep.projection = X.compress_if_wide(points, "vec", "clustering", "vec")
    return written(points, "points"), prep
