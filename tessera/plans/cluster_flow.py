"""Clustering runs: spaces, tuning, scoring, filtering and ranking."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.config import settings
from tessera.functions.metrics import normalise_runs
from tessera.operators import cluster as K, quality as Q
from tessera.session import written
from tessera.sources.registry import CLUSTER_POOL_2

log = logging.getLogger(__name__)

MODELS = ["KMeans", "BisectingKMeans", "GaussianMixture", "DBSCAN", "MeanShift", "Birch",
          "AgglomerativeClustering"]
LINEAR_ONLY = {"KMeans", "BisectingKMeans", "GaussianMixture", "MeanShift", "Birch", "DBSCAN"}
WITH_K = {"KMeans", "BisectingKMeans", "AgglomerativeClustering", "GaussianMixture", "Birch"}
LOWEST_SCORE = 0.001

Progress = Callable[[int, str | None], None]


def model_pool(plan_id: int, space: str) -> list[str]:
    """Models tried in a space: none on plan 1, a few on plan 2, all from plan 3."""
    if plan_id <= 1 or (plan_id < 3 and space == "view"):
        return []
    names = list(MODELS)
    if plan_id == 2:
        names = [m for m in names if m in CLUSTER_POOL_2]
    return [m for m in names if space == "linear" or m not in LINEAR_ONLY]


def k_curve(space: DataFrame, view: DataFrame, name: str, params: dict, ks: Sequence[int],
            seed: int = 42) -> DataFrame:
    """``(n_clusters, silhouette_score, calinski_harabasz_score)`` for every k tried."""
    rows = []
    for k in sorted(set(ks)):
        key = "n_components" if name == "GaussianMixture" else "n_clusters"
        labels = K.fit(name, space, {**params, key: k}, seed).labels
        p = written(view.join(labels, "id"), "curve")
        m = Q.moments(p)
        sil = 0.0 if len(m.labels) < 2 else Q.penalised_silhouette(p, "squared").first()["silhouette"]
        rows.append((k, float(sil), Q.calinski_harabasz(m)))
    return view.sparkSession.createDataFrame(
        rows, "n_clusters int, silhouette_score double, calinski_harabasz_score double")


def tune(name: str, space: DataFrame, view: Q.View, n: int, config: SimpleNamespace
         ) -> tuple[dict, list[int]]:
    """Best parameters of a seeded random search, and every k that was tried."""
    rng = np.random.default_rng(config.seed)
    draw = K.search_space(name, space, n)
    best, best_score, ks = None, -2.0, []
    for _ in range(config.n_trials):
        params = draw(rng)
        try:
            labels = K.fit(name, space, params, config.seed).labels
            p = written(view.points.join(labels, "id"), "trial")
            score = float(Q.unified_score(p, view, method="squared").first()["unified_score"])
            k = K.k_of(params)
            if k:
                ks.append(k)
        except Exception as ex:  # a trial that cannot be fitted loses, the search goes on
            log.warning("%s %s failed: %s", name, params, ex)
            score = -1.0
        if score > best_score:
            best, best_score = params, score
    return best or draw(rng), sorted(set(ks))


@dataclass
class ClusterRun:
    """``leaderboard`` has one row per model; ``labels[model_name]`` its ``(id, cluster)``."""

    leaderboard: DataFrame | None
    labels: dict[str, DataFrame]
    fits: dict[str, K.Fit]
    view: DataFrame
    curves: dict[str, DataFrame]


RUN_SCHEMA = ("model_name string, space string, hyperparams map<string,string>, "
              "train_start timestamp, train_finish timestamp, " + Q.MEASURE_SCHEMA)


def train_clustering(points: DataFrame, config: SimpleNamespace | None = None, plan_id: int = 3,
                     models: Sequence[str] | None = None, spaces: Sequence[str] = ("linear", "view"),
                     progress: Progress | None = None, curves: bool = True) -> ClusterRun:
    """Tune and score every model of the plan on points ``(id, vec)`` and rank the results."""
    config = config or settings("clustering")
    tell = progress or (lambda step, model=None: None)
    tell(1, None)
    linear = written(points.select("id", "vec"), "linear")
    view_points = written(K.view_2d(linear), "view") if config.eval_space == "view" else linear
    n = linear.count()
    view = Q.View.of(view_points)
    rows, labels, fits, curve = [], {}, {}, {}
    for space in spaces:
        data = linear if space == "linear" else view_points
        for name in model_pool(plan_id, space):
            if models is not None and name not in models:
                continue
            tell(2, name)
            start = datetime.now(timezone.utc)
            params, ks = tune(name, data, view, n, config)
            fit = K.fit(name, data, params, config.seed)
            p = written(view_points.join(fit.labels, "id"), "labelled")
            found = p.where("cluster <> -1").select("cluster").distinct().count()
            if found < 2:
                continue
            tell(3, name)
            stable = Q.stability(
                data, lambda s: K.fit(name, s, params, config.seed).labels,
                config.stability_n_runs, config.stability_sample_frac, config.seed)
            gap = Q.gap_statistic(view_points, found, config.gap_n_refs, config.seed) if (
                name == "KMeans" and space == "linear") else None
            raw = Q.measures(p, view, stable, gap, "squared")
            if curves and name in WITH_K:
                curve[f"{name}_{space}"] = k_curve(data, view_points, name, params, ks,
                                                   config.seed)
            key = f"{name}_{space}"
            labels[key], fits[key] = p.select("id", "cluster"), fit
            measures = [raw[f.split()[0]] for f in Q.MEASURE_SCHEMA.split(", ")]
            rows.append((key, space, {k: str(v) for k, v in params.items()}, start,
                         datetime.now(timezone.utc), *measures))
    board = None
    if rows:
        scored = Q.unified_columns(points.sparkSession.createDataFrame(rows, RUN_SCHEMA))
        kept = scored.where(F.col("unified_score") >= LOWEST_SCORE).withColumn(
            "calinski_harabasz", F.col("ch")).withColumn(
            "silhouette", F.col("silhouette") * (1 - F.col("noise_ratio")))
        board = normalise_runs(kept, ["silhouette", "calinski_harabasz", "gap", "stability"]
                               ).orderBy(F.col("unified_score").desc(), "model_name").limit(
            config.top_n_models)
        board = written(board, "leaderboard")
    tell(5, None)
    return ClusterRun(board, labels, fits, view_points, curve)
