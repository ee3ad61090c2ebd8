"""Registry of chats, runs and models as Parquet tables, and the questions asked of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera.session import new_path
from tessera.sources.tables import file_name

SCHEMAS = {
    "automl_chats": "chat_id string, user_id string, dataset_name string, files_key string, "
                    "training_id long, created_at timestamp, updated_at timestamp",
    "training_result": "training_id long, task_type string, target string, "
                       "overall_train_start timestamp, overall_train_finish timestamp, "
                       "status string, plan_id int",
    "models_metadata": "model_id long, model_name string, hyperparameters map<string,string>, "
                       "metrics map<string,double>, graphics string, "
                       "place_in_training_batch int, model_metadata map<string,string>, "
                       "train_start timestamp, train_finish timestamp",
    "training_x_models": "pair_id long, training_id long, model_id long",
    "users": "id string, plan_id int, is_active boolean, is_banned boolean",
}

# Models open to each plan. Clustering needs plan 2.
CLUSTER_POOL_2 = ["KMeans", "DBSCAN", "Birch", "AgglomerativeClustering"]
CLUSTER_POOL_3 = ["BisectingKMeans", "HDBSCAN", "OPTICS", "MeanShift", "GaussianMixture"]
SUPERVISED_POOL_1 = ["LogisticRegression", "DecisionTree", "NaiveBayes", "KNN", "RandomForest",
                     "SVC", "LinearRegression", "Ridge", "Lasso", "SVR"]
SUPERVISED_POOL_2 = ["GradientBoosting", "XGBoost", "LightGBM", "CatBoost"]


@dataclass
class Registry:
    """Tables under one root. Rewrites go to a new version folder that a pointer table names, so
    readers of the old version are not disturbed and a lost task can always read its input."""

    spark: SparkSession
    root: str

    def _pointer(self, name: str) -> str:
        return f"{self.root}/_current/{name}"

    def _path(self, name: str) -> str | None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self._pointer(name))
        fs = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jvm_path):
            return None
        rows = self.spark.read.schema("path string, version long").parquet(self._pointer(name))
        return rows.agg(F.max_by("path", "version")).first()[0]

    def read(self, name: str) -> DataFrame:
        path = self._path(name)
        if path is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(path)

    def replace(self, name: str, df: DataFrame) -> None:
        old = self._path(name)
        version = 0 if old is None else int(old.rsplit("v", 1)[1]) + 1
        path = f"{self.root}/{name}/v{version}"
        df.write.parquet(path)
        self.spark.createDataFrame([(path, version)], "path string, version long").coalesce(
            1).write.mode("append").parquet(self._pointer(name))

    def append(self, name: str, rows: DataFrame) -> None:
        path = self._path(name)
        cols = self.spark.createDataFrame([], SCHEMAS[name]).schema
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None))
                               .cast(f.dataType).alias(f.name) for f in cols])
        if path is None:
            self.replace(name, shaped)
        else:
            shaped.write.mode("append").parquet(path)

    def next_id(self, name: str, column: str) -> int:
        return (self.read(name).agg(F.max(column)).first()[0] or 0) + 1

    def add_run(self, task_type: str, target: str | None, start, finish,
                status: str = "completed", plan_id: int = 3) -> int:
        new = self.next_id("training_result", "training_id")
        self.append("training_result", self.spark.createDataFrame(
            [(new, task_type, target, start, finish, status, plan_id)],
            SCHEMAS["training_result"]))
        return new

    def add_models(self, training_id: int, models: DataFrame) -> None:
        """Append model rows (with a ``place_in_training_batch``) and their links to the run."""
        first = self.next_id("models_metadata", "model_id")
        pair = self.next_id("training_x_models", "pair_id")
        numbered = models.withColumn("model_id", F.lit(first - 1).cast("long")
                                     + F.col("place_in_training_batch"))
        self.append("models_metadata", numbered)
        self.append("training_x_models", numbered.select(
            (F.lit(pair - 1).cast("long") + F.col("place_in_training_batch")).alias("pair_id"),
            F.lit(training_id).cast("long").alias("training_id"), "model_id"))

    def add_chat(self, chat_id: str, user_id: str, dataset_name: str, files_key: str) -> None:
        now = F.current_timestamp()
        self.append("automl_chats", self.spark.createDataFrame(
            [(chat_id, user_id, dataset_name, files_key)],
            "chat_id string, user_id string, dataset_name string, files_key string")
            .withColumns({"created_at": now, "updated_at": now}))

    def delete_run(self, training_id: int) -> bool:
        ids = self.spark.createDataFrame([(training_id,)], "training_id long")
        runs, links, models = (self.read(n) for n in (
            "training_result", "training_x_models", "models_metadata"))
        found = not runs.where(F.col("training_id") == training_id).isEmpty()
        kept = cascade_delete(runs, links, models, ids)
        for name, df in zip(("models_metadata", "training_x_models", "training_result"),
                            (kept["models"], kept["links"], kept["runs"])):
            self.replace(name, df)
        return found


# ---------------------------------------------------------------- questions

def history(chats: DataFrame, runs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Chats of one user (or of all) with the state of their run, running ones first, then newest.

    ``created_at`` shows the last update, as callers expect; the real one is ``first_created_at``.
    ``place`` numbers a user's chats in that order (ties by id), so it outlives any later shuffle.
    """
    running = F.coalesce(F.col("status") == "training", F.lit(False))
    place = W.partitionBy("user_id").orderBy(running.desc(), F.col("updated_at").desc(), "chat_id")
    mine = chats if user_id is None else chats.where(F.col("user_id") == user_id)
    r = runs.select("training_id", "task_type", "target", "status")
    return (mine.join(r, "training_id", "left").withColumn("place", F.row_number().over(place))
            .orderBy(running.desc(), F.col("updated_at").desc(), "chat_id")
            .select(F.col("chat_id").alias("id"), "user_id", F.col("dataset_name"),
                    "task_type", "target", "files_key", F.col("updated_at").alias("created_at"),
                    F.col("created_at").alias("first_created_at"),
                    F.coalesce("status", F.lit("idle")).alias("status"),
                    F.col("training_id").cast("string").alias("training_id"), "place"))


def run_header(runs: DataFrame, chats: DataFrame) -> DataFrame:
    """Every run with its chat's user and file, where it has one."""
    c = chats.select("training_id", "user_id", "files_key")
    key = F.col("files_key")
    return runs.join(c, "training_id", "left").withColumn(
        "filename", file_name(key, F.concat(F.lit("Dataset_"), F.col("training_id"))))


def run_detail(links: DataFrame, models: DataFrame) -> DataFrame:
    """Models of each run; of models with one name the highest id stays, metadata keys are merged
    over the record's own."""
    names = models.select("model_id", "model_name")
    newest = (links.select("training_id", "model_id").join(names, "model_id")
              .groupBy("training_id", "model_name").agg(F.max("model_id").alias("model_id")))
    # Only keys are grouped; the wide columns join what is left.
    wide = models.dropDuplicates(["model_id", "model_name"]).select(
        F.col("model_id").alias("_id"), F.col("model_name").alias("_name"),
        F.struct("model_id", "hyperparameters", "metrics", "model_metadata",
                 "place_in_training_batch").alias("m"))
    last = newest.join(wide, (F.col("model_id") == F.col("_id"))
                       & F.col("model_name").eqNullSafe(F.col("_name"))).select(
        "training_id", "model_name", "m")
    own = F.create_map(F.lit("model_id"), F.col("m.model_id").cast("string"),
                       F.lit("model_name"), F.col("model_name"),
                       F.lit("place_in_training_batch"),
                       F.col("m.place_in_training_batch").cast("string"))
    meta = F.coalesce("m.model_metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(meta), k))
    return last.select("training_id", F.col("m.model_id").alias("model_id"), "model_name",
                       F.col("m.place_in_training_batch").alias("place_in_training_batch"),
                       F.col("m.hyperparameters").alias("hyperparams"),
                       F.col("m.metrics").alias("metrics"), F.map_concat(kept, meta).alias("record"))


def models_with_task(models: DataFrame, links: DataFrame, runs: DataFrame) -> DataFrame:
    """Each model with the task of its run; a model without a run reads as classification."""
    t = (links.select("model_id", "training_id")
         .join(runs.select("training_id", "task_type", "target"), "training_id")
         .groupBy("model_id").agg(F.min_by(F.struct("task_type", "target"), "training_id")
                                  .alias("t")))
    return models.join(t, "model_id", "left").select(
        *models.columns, F.coalesce("t.task_type", F.lit("classification")).alias("task_type"),
        F.col("t.target").alias("target"))


def is_allowed(model_name: Column, task: Column, plan: Column) -> Column:
    """Whether a plan may use a model; the part of the name before ``_`` decides."""
    base = F.split_part(model_name, F.lit("_"), F.lit(1))
    cluster = F.when(plan <= 1, False).when(plan == 2, base.isin(CLUSTER_POOL_2)).otherwise(
        base.isin(CLUSTER_POOL_2 + CLUSTER_POOL_3))
    other = F.when(plan == 1, base.isin(SUPERVISED_POOL_1)).otherwise(
        base.isin(SUPERVISED_POOL_1 + SUPERVISED_POOL_2))
    return F.when(task == "clustering", cluster).otherwise(other)


def backfill_chats(chats: DataFrame, old_runs: DataFrame) -> DataFrame:
    """Add a chat for every run that has none; the new id is the digest of the run id."""
    key = F.col("files_key")
    new = (old_runs.join(chats.select("training_id").where("training_id IS NOT NULL"),
                         "training_id", "left_anti")
           .select(F.md5(F.concat(F.lit("run-"), F.col("training_id"))).alias("chat_id"), "user_id",
                   F.when(key.contains("/"), F.element_at(F.split(key, "/"), -1)).otherwise(
                       F.coalesce(key, F.lit("Dataset"))).alias("dataset_name"), "files_key",
                   "training_id", F.col("overall_train_start").alias("created_at"),
                   F.col("overall_train_finish").alias("updated_at")))
    return chats.unionByName(new)


def cascade_delete(runs: DataFrame, links: DataFrame, models: DataFrame,
                   ids: DataFrame) -> dict[str, DataFrame]:
    """The three tables without the runs in ``ids`` and without their models."""
    gone = links.join(ids, "training_id", "left_semi").select("model_id").distinct()
    return {"runs": runs.join(ids, "training_id", "left_anti"),
            "links": links.join(ids, "training_id", "left_anti"),
            "models": models.join(gone, "model_id", "left_anti")}


def delete_untrained(chats: DataFrame, users: DataFrame | None = None,
                     user_id: str | None = None) -> DataFrame:
    """Chats that stay when untrained chats of a user (or of a table of users) are removed."""
    if users is None:
        return chats.where((F.col("user_id") != user_id) | F.col("training_id").isNotNull())
    hit = users.select("user_id").distinct().withColumn("_hit", F.lit(True))
    return (chats.join(hit, "user_id", "left")
            .where(F.col("_hit").isNull() | F.col("training_id").isNotNull())
            .select(*chats.columns))


def delete_chat(chats: DataFrame, chat_id: str) -> DataFrame:
    return chats.where(F.col("chat_id") != chat_id)


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set the columns of ``changes`` (one row per key) where they are not null."""
    cols = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_n_{x}") for x in cols])
    return table.join(c, key, "left").select(*[
        F.coalesce(f"_n_{x}", x).alias(x) if x in cols else F.col(x) for x in table.columns])


def user_state(asked: DataFrame, users: DataFrame) -> DataFrame:
    """Plan and status per asked user id; an unknown user has plan 1 and is not active."""
    u = users.select(F.col("id").alias("user_id"), "plan_id", "is_active", "is_banned")
    return asked.join(u, "user_id", "left").select(
        "user_id", F.coalesce("plan_id", F.lit(1)).alias("plan_id"),
        F.when(F.col("is_active").isNull(), "unknown").when(F.col("is_banned"), "banned")
        .when(~F.col("is_active"), "inactive").otherwise("active").alias("state"))


ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys into tasks of about ``ROWS_A_TASK`` of its ``rows``, where they are
    more than that. The number is given, as Spark would merge tasks by the bytes of narrow rows."""
    return df.repartition(-(-rows // ROWS_A_TASK), *keys) if rows > ROWS_A_TASK else df


def ranked(models: DataFrame, metric: str, by: list[str], n: int,
           ties: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Best ``n`` models per group of a leaderboard with their place. A large one is ``dealt`` by
    the groups first."""
    w = W.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), *ties)
    return models.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def scratch_registry(spark: SparkSession) -> Registry:
    return Registry(spark, new_path(spark, "registry"))
