"""Saved models and their application to new rows, batch or stream."""

from __future__ import annotations

import importlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators import features as X, supervised as S
from tessera.operators.clean import ROW_KEY, with_row_key
from tessera.sources.registry import Registry, models_with_task
from tessera.sources.tables import model_path

NOISE = "cluster_-1"


@dataclass
class Artifact:
    """Everything needed to score: the preparation, the model and the way back to the target."""

    task: str
    model_name: str
    features: list[str]
    scaling: X.Scaling
    model: Any = None
    category_codes: DataFrame | None = None
    target_codes: DataFrame | None = None
    transform: str | None = None
    projection: X.Projection | None = None
    centroids: list[tuple[str, list[float]]] | None = None

    # ------------------------------------------------------------ save and load

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"task": self.task, "model_name": self.model_name, "features": self.features,
                "centre": self.scaling.centre, "scale": self.scaling.scale,
                "transform": self.transform, "centroids": self.centroids,
                "projection": None if self.projection is None else {
                    "matrix": self.projection.matrix.tolist(),
                    "centre": None if self.projection.centre is None else
                    self.projection.centre.tolist()},
                "categories": self.category_codes is not None,
                "target": self.target_codes is not None, "model": None}
        if isinstance(self.model, S.KNearestModel):
            m = self.model
            m.train.write.mode("overwrite").parquet(f"{path}/model")
            meta["model"] = {"class": "KNearestModel", "k": m.k, "weights": m.weights,
                             "classes": m.classes, "features": m.features}
        elif self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
            cls = type(self.model)
            meta["model"] = {"class": cls.__name__, "module": cls.__module__}
        if self.category_codes is not None:
            self.category_codes.write.mode("overwrite").parquet(f"{path}/feature_encoder")
        if self.target_codes is not None:
            self.target_codes.write.mode("overwrite").parquet(f"{path}/target_encoder")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Artifact":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        model = None
        if meta["model"]:
            m = meta["model"]
            if m["class"] == "KNearestModel":
                model = S.KNearestModel(spark.read.parquet(f"{path}/model"), m["k"], m["weights"],
                                        m["classes"], m["features"])
            else:
                if not m["module"].startswith("pyspark.ml"):
                    raise ValueError(f"unexpected model class {m['module']}.{m['class']}")
                cls = getattr(importlib.import_module(m["module"]), m["class"])
                model = cls.load(f"{path}/model")
        import numpy as np
        proj = meta["projection"]
        return Artifact(
            meta["task"], meta["model_name"], meta["features"],
            X.Scaling(meta["centre"], meta["scale"]), model,
            spark.read.parquet(f"{path}/feature_encoder") if meta["categories"] else None,
            spark.read.parquet(f"{path}/target_encoder") if meta["target"] else None,
            meta["transform"],
            None if proj is None else X.Projection(
                np.array(proj["matrix"]),
                None if proj["centre"] is None else np.array(proj["centre"])),
            None if meta["centroids"] is None else [(n, list(c)) for n, c in meta["centroids"]])

    # ------------------------------------------------------------ preparation

    def prepared(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encode, coerce and scale the columns that are there; absent features are 0."""
        cats: list[str] = []
        if self.category_codes is not None:
            known = [r["column"] for r in self.category_codes.select("column").distinct().collect()]
            cats = [c for c in known if c in df.columns]
        own = [c for c in self.features if c in df.columns]
        out = df.withColumns({f"_k_{c}": F.col(c) for c in keep}) if keep else df
        out = X.encode_ordinal(out, cats, self.category_codes) if cats else out
        out = out.withColumns({c: X.to_number(c, 0.0) for c in own if c not in cats})
        out = self.scaling.apply(out)
        return X.align(out, self.features, [f"_k_{c}" for c in keep]).withColumnsRenamed(
            {f"_k_{c}": f"key_{c}" for c in keep})

    def vectors(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Prepared rows with ``features`` in the form this model reads."""
        rows = self.prepared(df, keep)
        if self.model_name.split("_")[0] in S.POLYNOMIAL_MODELS:
            vec = F.array(*[F.col(f"`{a}`") if b is None else F.col(f"`{a}`") * F.col(f"`{b}`")
                            for a, b, _ in X.polynomial_names(self.features)])
        else:
            vec = F.array(*[F.col(f"`{c}`") for c in self.features])
        out = rows.select(*[f"key_{c}" for c in keep], vec.alias("vec"))
        if self.projection is not None:
            out = self.projection.apply(out, "vec", "vec")
        return out.withColumnsRenamed({f"key_{c}": c for c in keep})

    # ------------------------------------------------------------ scoring

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Add ``predicted`` (or, for clusters with centroids, ``distances``) to the kept columns."""
        if self.task == "clustering" and self.centroids:
            rows = self.vectors(df, keep)
            return rows.select(*keep, centroid_distances(F.col("vec"), self.centroids)
                               .alias("distances"))
        if isinstance(self.model, S.KNearestModel):
            df = with_row_key(df)
            keep = [*keep, ROW_KEY]
        rows = self.vectors(df, keep).withColumn("features", array_to_vector("vec"))
        out = self.model.transform(rows)
        if self.task == "classification" and self.target_codes is not None:
            out = X.decode_target(out, self.target_codes)
        elif self.task == "regression" and self.transform == "log1p":
            out = out.withColumn("predicted", F.expm1("prediction"))
        else:
            out = out.withColumn("predicted", F.col("prediction"))
        extra = [] if "probability" not in out.columns else [
            vector_to_array("probability").alias("probability")]
        return out.select(*[c for c in keep if c != ROW_KEY], "predicted", *extra)


def centroid_distances(vec: Column, centroids: Sequence[tuple[str, Sequence[float]]]) -> Column:
    """``array<struct<distance, cluster>>`` in ascending order; the noise centre is left out.

    The centres are a literal of the plan: as many numbers as the model has.
    """
    cells = []
    for name, centre in centroids:
        if name == NOISE:
            continue
        c = F.lit([float(x) for x in centre])
        d = F.sqrt(F.aggregate(F.zip_with(vec, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                               lambda s, x: s + x))
        cells.append(F.struct(d.alias("distance"), F.lit(name).alias("cluster")))
    return F.array_sort(F.array(*cells))


def from_run(run, result) -> Artifact:
    """The artifact of one model of a supervised run."""
    p = run.prepared
    return Artifact(run.task, result.name, p.features, p.scaling, result.model, p.category_codes,
                    p.target_codes, p.transform)


def from_cluster_run(prep: Artifact, run, name: str, points: DataFrame) -> Artifact:
    """The artifact of one clustering: its centres in the space of the prepared rows."""
    from dataclasses import replace
    from tessera.operators.quality import CLUSTER_LIMIT, centroids
    rows = centroids(points.join(run.labels[name], "id")).limit(CLUSTER_LIMIT + 1).collect()
    if len(rows) > CLUSTER_LIMIT:
        raise ValueError(f"more than {CLUSTER_LIMIT} clusters")
    return replace(prep, model_name=name, centroids=[(r["cluster_name"], list(r["centroid"]))
                                                     for r in rows])


def load_by_id(registry: Registry, model_id: int) -> Artifact:
    """Artifact of a registered model; its place is in the model's metadata."""
    rows = models_with_task(registry.read("models_metadata").where(F.col("model_id") == model_id),
                            registry.read("training_x_models"), registry.read("training_result"))
    row = rows.select("model_metadata").first()
    if row is None:
        raise KeyError(f"model {model_id} not found")
    path = (row["model_metadata"] or {}).get("path")
    if not path:
        raise KeyError(f"model {model_id} has no saved artifact")
    return Artifact.load(registry.spark, path)


MODEL_ROW = ("model_name string, hyperparameters map<string,string>, metrics map<string,double>, "
             "place_in_training_batch int, model_metadata map<string,string>, "
             "train_start timestamp, train_finish timestamp")


def save_run(run, registry: Registry, root: str, chat_id: str, training_id: int) -> None:
    """Save every model of a supervised run under its place and append the model rows."""
    rows = []
    for place, r in enumerate(run.results, 1):
        path = model_path(root, chat_id, run.task, place)
        from_run(run, r).save(registry.spark, path)
        rows.append((r.name, {k: str(v) for k, v in r.params.items()}, r.metrics, place,
                     {"path": path, "selected_features": json.dumps(r.features)},
                     r.start, r.finish))
    if rows:
        registry.add_models(training_id, registry.spark.createDataFrame(rows, MODEL_ROW))


def save_cluster_run(run, prep: Artifact, points: DataFrame, registry: Registry, root: str,
                     chat_id: str, training_id: int) -> None:
    """The same for a clustering run, in the order of its leaderboard."""
    if run.leaderboard is None:
        return
    board = run.leaderboard.orderBy(F.col("unified_score").desc(), "model_name").collect()
    rows = []
    for place, r in enumerate(board, 1):
        path = model_path(root, chat_id, "clustering", place)
        from_cluster_run(prep, run, r["model_name"], points).save(registry.spark, path)
        metrics = {k: float(v) for k, v in r.asDict().items() if isinstance(v, float)}
        rows.append((r["model_name"], r["hyperparams"], metrics, place,
                     {"path": path, "n_clusters": str(r["n_clusters"]),
                      "selected_features": json.dumps(prep.features)},
                     r["train_start"], r["train_finish"]))
    registry.add_models(training_id, registry.spark.createDataFrame(rows, MODEL_ROW))
