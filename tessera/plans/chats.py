"""The session of a user with one dataset: open, train, look back, predict, delete."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.config import PROGRESS_STEPS
from tessera.operators import score as R
from tessera.operators.assoc import mixed_matrix
from tessera.operators.clean import clean
from tessera.operators.features import category_map, encode_ordinal
from tessera.plans import train as T
from tessera.sources import registry as H, tables
from tessera.sources.registry import Registry

log = logging.getLogger(__name__)

Publish = Callable[[dict[str, Any]], None]


@dataclass
class Workspace:
    """A registry and a folder for datasets and models."""

    spark: SparkSession
    registry: Registry
    root: str

    # ------------------------------------------------------------ datasets

    def open_chat(self, df: DataFrame, user_id: str, filename: str) -> tuple[str, DataFrame]:
        """Clean and keep a dataset; returns the chat id and the association matrix.

        Earlier chats of the user that were never trained are removed.
        """
        chat_id = uuid.uuid4().hex
        cleaned = clean(df)
        tables.write_snapshot(cleaned.df, self.root, chat_id)
        data = tables.read_snapshot(self.spark, self.root, chat_id)
        chats = self.registry.read("automl_chats")
        stale = chats.where((F.col("user_id") == user_id) & F.col("training_id").isNull())
        if not stale.isEmpty():
            self.registry.replace("automl_chats", H.delete_untrained(chats, user_id=user_id))
        self.registry.add_chat(chat_id, user_id, filename, f"{chat_id}/{filename}")
        return chat_id, self.matrix(data)

    def matrix(self, data: DataFrame, encoded: bool = True) -> DataFrame:
        """Association matrix of a cleaned dataset, of its category codes or of its raw columns."""
        cats = [f.name for f in data.schema if f.dataType.simpleString() == "string"]
        if encoded and cats:
            data = encode_ordinal(data, cats, category_map(data, cats))
        return mixed_matrix(data, complete=True)

    def chat(self, chat_id: str):
        row = self.registry.read("automl_chats").where(F.col("chat_id") == chat_id).first()
        if row is None:
            raise KeyError(f"chat {chat_id} not found")
        return row

    def plan_of(self, user_id: str) -> tuple[int, str]:
        asked = self.spark.createDataFrame([(user_id,)], "user_id string")
        row = H.user_state(asked, self.registry.read("users")).first()
        return row["plan_id"], row["state"]

    # ------------------------------------------------------------ training

    def train(self, chat_id: str, task: str, target: str | None = None,
              drop: Sequence[str] = (), config=None, publish: Publish | None = None,
              **options) -> int:
        """Train on the chat's dataset; a chat that was trained keeps its run id."""
        chat = self.chat(chat_id)
        plan, _ = self.plan_of(chat["user_id"])
        if task == "clustering" and plan == 1:
            raise PermissionError("clustering needs plan 2")
        now = datetime.now(timezone.utc)
        training_id = chat["training_id"]
        if training_id:
            self._set(training_id, task_type=task, target=target, overall_train_finish=now,
                      status="training", plan_id=plan)
        else:
            training_id = self.registry.add_run(task, target, now, now, "training", plan)
            changed = self.spark.createDataFrame([(chat_id, training_id, now)],
                                                 "chat_id string, training_id long, "
                                                 "updated_at timestamp")
            self.registry.replace("automl_chats", H.update_rows(
                self.registry.read("automl_chats"), changed, "chat_id"))

        def tell(step: int, model: str | None = None) -> None:
            if publish:
                publish({"training_id": training_id, "step": PROGRESS_STEPS[step],
                         "step_index": step, "model_name": model,
                         "ts": datetime.now(timezone.utc)})

        tell(0)
        try:
            data = tables.read_snapshot(self.spark, self.root, chat_id)
            if task == "clustering":
                from tessera.plans.cluster_flow import train_clustering
                points, prep = T.ordinal_points(data, drop)
                run = train_clustering(points, config, plan, progress=tell, **options)
                R.save_cluster_run(run, prep, points, self.registry, self.root, chat_id,
                                   training_id)
            else:
                run = T.run_task(data, task, target, config, plan, drop=drop, progress=tell,
                                 **options)
                R.save_run(run, self.registry, self.root, chat_id, training_id)
        except Exception:
            log.exception("training %s failed", training_id)
            self._set(training_id, status="failed", overall_train_finish=datetime.now(timezone.utc))
            raise
        self._set(training_id, status="completed", overall_train_finish=datetime.now(timezone.utc))
        tell(6)
        return training_id

    def _set(self, training_id: int, **values) -> None:
        schema = {"task_type": "string", "target": "string", "overall_train_finish": "timestamp",
                  "status": "string", "plan_id": "int"}
        names = [k for k, v in values.items() if v is not None]
        row = self.spark.createDataFrame(
            [(training_id, *[values[n] for n in names])],
            ", ".join(["training_id long", *[f"{n} {schema[n]}" for n in names]]))
        self.registry.replace("training_result", H.update_rows(
            self.registry.read("training_result"), row, "training_id"))

    # ------------------------------------------------------------ looking back

    def history(self, user_id: str) -> DataFrame:
        return H.history(self.registry.read("automl_chats"),
                         self.registry.read("training_result"), user_id)

    def detail(self, chat_id: str) -> dict[str, Any]:
        """Run header, allowed models, dataset and association matrix of a chat."""
        chat = self.chat(chat_id)
        plan, _ = self.plan_of(chat["user_id"])
        runs = self.registry.read("training_result").where(
            F.col("training_id") == chat["training_id"])
        header = H.run_header(runs, self.registry.read("automl_chats")).first()
        task = header["task_type"] if header else ""
        models = H.run_detail(
            self.registry.read("training_x_models").where(
                F.col("training_id") == chat["training_id"]),
            self.registry.read("models_metadata")).where(
            H.is_allowed(F.col("model_name"), F.lit(task), F.lit(plan))).withColumn(
            "is_locked", F.lit(False)).orderBy("place_in_training_batch")
        data = tables.read_snapshot(self.spark, self.root, chat_id)
        return {"training_id": header["training_id"] if header else None,
                "filename": header["filename"] if header else chat["dataset_name"],
                "task_type": task or None, "target": header["target"] if header else None,
                "status": header["status"] if header else "idle",
                "trained_plan_id": header["plan_id"] if header else None,
                "models": models, "data": data, "matrix": self.matrix(data)}

    def predict(self, model_id: int, rows: DataFrame, user_id: str, keep: Sequence[str] = ()
                ) -> DataFrame:
        """Score rows with a registered model; the user must be known and active."""
        _, state = self.plan_of(user_id)
        if state != "active":
            raise PermissionError(f"user is {state}")
        return R.load_by_id(self.registry, model_id).score(rows, keep)

    def delete(self, chat_id: str) -> None:
        """Remove a chat, its run and the run's models."""
        chat = self.chat(chat_id)
        if chat["training_id"]:
            self.registry.delete_run(chat["training_id"])
        self.registry.replace("automl_chats", H.delete_chat(
            self.registry.read("automl_chats"), chat_id))
