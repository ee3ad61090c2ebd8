"""Clusterers over points ``(id, vec array<double>)``. Each returns ``(id, cluster)``.

Clusters are numbered from 0 by size, then by smallest id, so the numbers do not depend on the
order in which rows arrive; −1 is noise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessera.functions.ordered import exact_quantiles
from tessera.operators.blocks import (nearest, neighbour_counts, radius_links, smallest_within)
from tessera.operators.features import choose_metric, l2_normalise
from tessera.operators.graph import connected_components
from tessera.operators.kth import kth_distance
from tessera.operators.linkage import linkage_clusters
from tessera.operators.pivots import distances
from tessera.operators.quality import CLUSTER_LIMIT, moments
from tessera.operators.shift import find_modes
from tessera.session import written


@dataclass
class Fit:
    name: str
    params: dict[str, Any]
    labels: DataFrame
    model: Any = None
    info: dict[str, Any] = field(default_factory=dict)


def renumber(labels: DataFrame) -> DataFrame:
    """Give clusters the numbers 0.. by size and smallest id; null and −1 become −1."""
    sizes = (labels.where(F.col("cluster").isNotNull() & (F.col("cluster").cast("string") != "-1"))
             .groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    # One row per cluster, so ordering them all is small.
    order = W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "first")
    codes = sizes.select("cluster", (F.row_number().over(order) - 1).alias("code"))
    return labels.join(codes, "cluster", "left").select(
        "id", F.coalesce("code", F.lit(-1)).cast("int").alias("cluster"))


def _vectors(p: DataFrame) -> DataFrame:
    return p.select("id", array_to_vector("vec").alias("features"))


def _from_model(model, p: DataFrame) -> DataFrame:
    return renumber(model.transform(_vectors(p)).select("id", F.col("prediction")
                                                        .alias("cluster")))


def width(p: DataFrame) -> int:
    return p.select(F.size("vec").alias("d")).first()["d"]


# ---------------------------------------------------------------- spaces

def reduced(p: DataFrame, k: int | None = None) -> tuple[DataFrame, Any]:
    """Principal components of the points, at most 50 and fewer than the columns."""
    d = width(p)
    k = min(k or 50, d - 1) if d > 1 else 1
    if d == 1:
        return p, None
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(_vectors(p))
    return model.transform(_vectors(p)).select("id", vector_to_array("pc").alias("vec")), model


def view_2d(p: DataFrame) -> DataFrame:
    """First two principal components: the view for plots and scores."""
    d = width(p)
    if d <= 2:
        return p.select("id", "vec") if d == 2 else p.select(
            "id", F.array(F.col("vec")[0], F.lit(0.0)).alias("vec"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(_vectors(p))
    return model.transform(_vectors(p)).select("id", vector_to_array("pc").alias("vec"))


def for_metric(p: DataFrame) -> DataFrame:
    """Rows of unit length when the points are wide enough for the cosine metric."""
    if choose_metric(width(p)) == "cosine":
        return l2_normalise(p, "vec", "vec")
    return p


# ---------------------------------------------------------------- centroid models

def kmeans(p: DataFrame, k: int, seed: int = 42) -> Fit:
    model = KMeans(k=k, seed=seed).fit(_vectors(p))
    return Fit("KMeans", {"n_clusters": k}, _from_model(model, p), model,
               {"inertia": model.summary.trainingCost})


def bisecting_kmeans(p: DataFrame, k: int, seed: int = 42) -> Fit:
    model = BisectingKMeans(k=k, seed=seed, minDivisibleClusterSize=1.0).fit(_vectors(p))
    return Fit("BisectingKMeans", {"n_clusters": k}, _from_model(model, p), model)


def assign_nearest(p: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(id, cluster, dist)``: nearest of a bounded set of centres, in Arrow batches."""
    schema = T.StructType([p.schema["id"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("dist", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf["vec"].to_numpy()).astype(float), centres)
                c = d.argmin(1)
                yield pd.DataFrame({"id": pdf["id"], "cluster": c.astype("int32"),
                                    "dist": d[np.arange(len(d)), c]})

    return p.select("id", "vec").mapInPandas(run, schema)


def lloyd_step(p: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(cluster, n, centre)`` after one assignment and update."""
    near = assign_nearest(p, centres).select("id", "cluster")
    s = Summarizer.mean(F.col("v"))
    return (p.select("id", array_to_vector("vec").alias("v")).join(near, "id").groupBy("cluster")
            .agg(F.count("*").alias("n"), s.alias("m"))
            .select("cluster", "n", vector_to_array("m").alias("centre")))


def _log_density(x: np.ndarray, w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log of weight × density per component; ``cov`` is k×d (diagonal) or k×d×d (full)."""
    out = np.empty((len(x), len(w)))
    for j in range(len(w)):
        if cov.ndim == 2:
            quad, logdet = ((x - mu[j]) ** 2 / cov[j]).sum(1), np.log(cov[j]).sum()
        else:
            root = np.linalg.cholesky(cov[j])
            quad = (np.linalg.solve(root, (x - mu[j]).T) ** 2).sum(0)
            logdet = 2 * np.log(np.diag(root)).sum()
        out[:, j] = np.log(w[j]) - 0.5 * (quad + logdet + x.shape[1] * np.log(2 * np.pi))
    return out


def gaussian_mixture(p: DataFrame, k: int, covariance: str = "full", seed: int = 42,
                     max_iter: int = 100, tol: float = 1e-3) -> Fit:
    """EM from a k-means start. Each task sums its own rows, so that only the component sums
    travel: k·d numbers for diagonal covariances, k·d² for full ones."""
    full = covariance == "full"
    labels = written(kmeans(p, k, seed).labels, "start")
    start = moments(p.join(labels, "id"))
    n, (k, d) = start.total, start.mean.shape
    w, mu = start.n / n, start.mean
    cov = start.ss / start.n[:, None] + 1e-6
    if full:
        cov = np.stack([np.diag(c) for c in cov])
    last = -np.inf
    for _ in range(max_iter):
        def sums(batches, w=w, mu=mu, cov=cov):
            r, sx, sxx, ll = np.zeros(k), np.zeros((k, d)), np.zeros(cov.shape), 0.0
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["vec"].to_numpy()).astype(float)
                lp = _log_density(x, w, mu, cov)
                top = lp.max(1, keepdims=True)
                norm = top + np.log(np.exp(lp - top).sum(1, keepdims=True))
                resp = np.exp(lp - norm)
                ll += float(norm.sum())
                r += resp.sum(0)
                sx += resp.T @ x
                for j in range(k):
                    y = x - mu[j]
                    sxx[j] += (resp[:, j:j + 1] * y).T @ y if full else resp[:, j] @ (y * y)
            flat = np.concatenate([[ll], r, sx.ravel(), sxx.ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        got = p.select("vec").mapInPandas(sums, "i int, v double").groupBy("i").agg(
            F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        ll, r = got[0] / n, got[1:1 + k] + 1e-12
        new = got[1 + k:1 + k + k * d].reshape(k, d) / r[:, None]
        sxx = got[1 + k + k * d:].reshape(cov.shape)
        step = new - mu  # the sums are around the old means
        if full:
            cov = sxx / r[:, None, None] - step[:, :, None] * step[:, None, :] + 1e-6 * np.eye(d)
        else:
            cov = np.maximum(sxx / r[:, None] - step ** 2, 0) + 1e-6
        mu, w = new, r / n
        if ll - last < tol:
            break
        last = ll
    schema = T.StructType([p.schema["id"], T.StructField("cluster", T.IntegerType())])

    def label(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype(float)
                yield pd.DataFrame({"id": pdf["id"], "cluster": _log_density(
                    x, w, mu, cov).argmax(1).astype("int32")})

    return Fit("GaussianMixture", {"n_components": k, "covariance_type": covariance},
               renumber(p.select("id", "vec").mapInPandas(label, schema)),
               info={"weights": w, "means": mu, "covariances": cov})


def micro_clusters(p: DataFrame, threshold: float) -> DataFrame:
    """``(cell, n, mean)``: points summed per grid cell of the given side."""
    s = Summarizer.mean(F.col("v"))
    return (p.select(F.transform("vec", lambda x: F.floor(x / threshold)).alias("cell"),
                     array_to_vector("vec").alias("v"))
            .groupBy("cell").agg(F.count("*").alias("n"), s.alias("mean")))


def two_stage(p: DataFrame, threshold: float, k: int, seed: int = 42) -> Fit:
    """Grid micro-clusters, then weighted k-means on their means; points follow their cell."""
    cells = written(micro_clusters(p, threshold).withColumn("n", F.col("n").cast("double")),
                    "cells")
    model = KMeans(k=k, seed=seed, featuresCol="mean", weightCol="n").fit(cells)
    by_cell = model.transform(cells).select("cell", F.col("prediction").alias("cluster"))
    labels = p.select("id", F.transform("vec", lambda x: F.floor(x / threshold)).alias("cell")
                      ).join(by_cell, "cell").select("id", "cluster")
    return Fit("Birch", {"threshold": threshold, "n_clusters": k}, renumber(labels), model)


# ---------------------------------------------------------------- density models

def core_components(p: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``(id, root)``: density components by their smallest core point, null for noise.

    A border point joins the smallest component that has a core point within ``eps``.
    """
    counts = neighbour_counts(p, eps)
    flagged = written(p.select("id", "vec").join(counts, "id")
                      .withColumn("core", F.col("n") >= min_samples), "density")
    core = flagged.where("core").select("id", "vec")
    comp = written(connected_components(core, radius_links(core, eps)), "cores")
    core_rows = core.join(comp, "id").withColumnRenamed("component", "root")
    border = smallest_within(flagged.where("NOT core").select("id", "vec"), core_rows, eps, "root")
    return p.select("id").join(core_rows.select("id", "root").unionByName(border), "id", "left")


def dbscan(p: DataFrame, eps: float, min_samples: int) -> Fit:
    roots = core_components(for_metric(p), eps, min_samples)
    return Fit("DBSCAN", {"eps": eps, "min_samples": min_samples},
               renumber(roots.withColumnRenamed("root", "cluster")))


def estimate_eps(p: DataFrame) -> DataFrame:
    """One row ``(eps)``: 90th percentile of the distance to the k-th neighbour, with
    k = max(10, ⌊4 ln n⌋) counting the point itself."""
    n = p.count()
    k = min(max(10, int(math.log(n) * 4)), n) - 1
    last = nearest(p, p, k, skip_self=True).where(F.col("place") == k)
    return exact_quantiles(last, ["dist"], [0.9], rows=n).select(F.col("quantiles")[0].alias("eps"))


def estimate_bandwidth(p: DataFrame, quantile: float = 0.3) -> DataFrame:
    """One row ``(bandwidth)``: mean distance to the ⌊quantile·n⌋-th neighbour, the point itself
    counted, over all points. As k grows with n every pair is looked at, in blocks."""
    k = max(1, int(p.count() * quantile)) - 1
    if k < 1:
        return p.sparkSession.createDataFrame([(0.0,)], "bandwidth double")
    return kth_distance(p, k).agg(F.avg("dist").alias("bandwidth"))


def mean_shift(p: DataFrame, bandwidth: float, max_iter: int = 300) -> Fit:
    """Flat-kernel mean shift from grid seeds; seeds that end within one bandwidth are one mode."""
    modes, info = find_modes(p, bandwidth, max_iter)
    if info["modes"] > CLUSTER_LIMIT:
        raise ValueError(f"more than {CLUSTER_LIMIT} modes")
    labels = nearest(p.select("id", "vec"), modes.select("id", "vec"), 1).select(
        "id", F.col("nbr").alias("cluster"))
    centres = np.array([r["vec"] for r in modes.orderBy("id").collect()], dtype=float)
    return Fit("MeanShift", {"bandwidth": bandwidth}, renumber(labels),
               info={"centres": centres, **info})


# ---------------------------------------------------------------- linkage

def single_linkage(p: DataFrame, k: int) -> Fit:
    """The k clusters that are left when the spanning tree loses its k − 1 heaviest edges."""
    return Fit("AgglomerativeClustering", {"n_clusters": k, "linkage": "single"},
               renumber(linkage_clusters(p, k).withColumnRenamed("component", "cluster")))


# ---------------------------------------------------------------- search spaces

def k_limit(n: int) -> int:
    return min(15, max(3, int(math.sqrt(n))))


FITTERS: dict[str, Callable[..., Fit]] = {
    "KMeans": lambda p, s, n_clusters: kmeans(p, n_clusters, s),
    "BisectingKMeans": lambda p, s, n_clusters: bisecting_kmeans(p, n_clusters, s),
    "GaussianMixture": lambda p, s, n_components, covariance_type: gaussian_mixture(
        p, n_components, covariance_type, s),
    "MeanShift": lambda p, s, bandwidth: mean_shift(p, bandwidth),
    "Birch": lambda p, s, threshold, n_clusters: two_stage(p, threshold, n_clusters, s),
    "DBSCAN": lambda p, s, eps, min_samples: dbscan(p, eps, min_samples),
    "AgglomerativeClustering": lambda p, s, n_clusters: single_linkage(p, n_clusters),
}


def fit(name: str, p: DataFrame, params: dict[str, Any], seed: int = 42) -> Fit:
    return FITTERS[name](p, seed, **params)


def search_space(name: str, p: DataFrame, n: int) -> Callable[[np.random.Generator], dict]:
    """A function that draws parameters; data-dependent ranges are measured once."""
    top = k_limit(n)
    if name in ("KMeans", "BisectingKMeans"):
        return lambda g: {"n_clusters": int(g.integers(2, top + 1))}
    if name == "GaussianMixture":
        return lambda g: {"n_components": int(g.integers(2, top + 1)),
                          "covariance_type": ["full", "diag"][int(g.integers(2))]}
    if name == "MeanShift":
        bw = estimate_bandwidth(for_metric(p)).first()[0]
        return lambda g: {"bandwidth": float(g.uniform(max(0.1, bw * 0.5), max(1.0, bw * 2.0)))}
    if name == "Birch":
        return lambda g: {"threshold": float(g.uniform(0.1, 0.7)),
                          "n_clusters": int(g.integers(2, top + 1))}
    if name == "DBSCAN":
        eps = estimate_eps(for_metric(p)).first()[0]
        most = int(np.clip(n * 0.05, 5, 200))
        return lambda g: {"eps": float(g.uniform(eps * 0.5, eps * 2.0)),
                          "min_samples": int(g.integers(5, most + 1))}
    if name == "AgglomerativeClustering":
        return lambda g: {"n_clusters": int(g.integers(2, 9))}
    raise ValueError(f"unknown model {name}")


def k_of(params: dict[str, Any]) -> int | None:
    return params.get("n_clusters") or params.get("n_components")
