import numpy as np
import pandas as pd
import pytest

from tessera.config import settings
from tessera.plans.chats import Workspace
from tessera.sources.registry import Registry


def test_life_of_a_chat(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "reg"))
    reg.append("users", spark.createDataFrame(
        [("u1", 3, True, False), ("u2", 1, True, False), ("u3", 3, True, True)],
        "id string, plan_id int, is_active boolean, is_banned boolean"))
    ws = Workspace(spark, reg, str(tmp_path / "files"))
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({
        "x": x, "y": rng.normal(size=200), "kind": rng.choice(["a", "b"], 200),
        "grade": np.where(x > 0, "high", "low"), "user_id": np.arange(200)}))

    first, _ = ws.open_chat(df, "u1", "first.csv")
    chat, matrix = ws.open_chat(df, "u1", "second.csv")
    assert matrix.count() == 16
    assert [h["id"] for h in ws.history("u1").collect()] == [chat]
    assert ws.detail(chat)["status"] == "idle"

    events = []
    run = ws.train(chat, "classification", "grade", config=settings("classification", n_iter=1, cv_folds=2),
                   models=["NaiveBayes", "DecisionTree"], publish=events.append)
    assert events[0]["step_index"] == 0 and events[-1]["step_index"] == 6
    d = ws.detail(chat)
    models = d["models"].collect()
    assert (d["status"], d["filename"], len(models)) == ("completed", "second.csv", 2)
    scored = ws.predict(models[0]["model_id"], df, "u1", ["grade"])
    assert scored.where("predicted = grade").count() > 150
    with pytest.raises(PermissionError):
        ws.predict(models[0]["model_id"], df, "u3")

    again = ws.train(chat, "clustering", config=settings(
        "clustering",
        n_trials=1, stability_n_runs=2, gap_n_refs=1), models=["KMeans"], spaces=["linear"],
        curves=False)
    assert again == run
    k = reg.read("models_metadata").where("model_name = 'KMeans_linear'").first()
    if k is not None:  # a clustering of no structure may be filtered out
        row = ws.predict(k["model_id"], df, "u1", ["user_id"]).first()
        assert row["distances"][0]["distance"] <= row["distances"][-1]["distance"]

    other, _ = ws.open_chat(df, "u2", "t.csv")
    with pytest.raises(PermissionError):
        ws.train(other, "clustering")
    with pytest.raises(ValueError):
        ws.train(other, "regression")
    assert [h["status"] for h in ws.history("u2").collect()] == ["failed"]
    ws.delete(chat)
    assert ws.history("u1").isEmpty() and reg.read("training_result").count() == 1
    with pytest.raises(KeyError):
        ws.detail(chat)
