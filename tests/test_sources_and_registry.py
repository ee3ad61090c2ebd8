import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import registry as R, tables as T


def test_csv_types_and_null_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "n, price ,flag,text,empty\n1,1.5,true,a,NA\n2,NaN,False,\"x,y\",\nn/a,3,TRUE,null,None\n")
    df = T.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "price": "double", "flag": "boolean",
                               "text": "string", "empty": "double"}
    rows = [tuple(r) for r in df.orderBy("n").collect()]
    assert rows == [(None, 3.0, True, None, None), (1, 1.5, True, "a", None),
                    (2, None, False, "x,y", None)]
    typed = T.read_csv(spark, str(tmp_path / "t.csv"), df.select("n", "text").schema)
    assert typed.columns == ["n", "text"] and typed.count() == 3


def test_records_write_null_for_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, "x")], "a int, b double, c string")
    got = [json.loads(r[0]) for r in T.to_records(df).collect()]
    assert got == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": 1.5, "c": "x"}]


def test_split_result_merges_metadata(spark):
    df = spark.createDataFrame(
        [("m", {"d": "1"}, {"n_clusters": "old", "z": "z"}, 3, 1)],
        "model_name string, hyperparams map<string,string>, model_metadata map<string,string>, "
        "n_clusters int, place int")
    r = T.split_result(df, "place").first()
    assert r["model_metadata"] == {"n_clusters": "3", "z": "z"}
    assert (r["place_in_training_batch"], r["hyperparams"]) == (1, {"d": "1"})


def test_report(spark, tmp_path):
    runs = spark.createDataFrame([(1, "KMeans", 0.5, float("nan"), 12.3, None)],
                                 "place int, model_name string, unified_score double, "
                                 "silhouette double, calinski_harabasz double, gap double")
    T.write_report(runs, str(tmp_path / "r"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "1. KMeans - " in text and "Unified score: 0.5000" in text and "Silhouette: N/A" in text


def test_names(spark):
    df = spark.createDataFrame([("c1/f.csv",), ("plain.csv",), (None,), ("",)], "k string")
    k = F.col("k")
    got = [r[0] for r in df.select(T.file_name(k, F.lit("Dataset_7"))).collect()]
    assert got == ["f.csv", "plain.csv", "Dataset_7", "Dataset_7"]
    row = spark.createDataFrame([("мой файл(1).csv",)], "n string").select(
        T.safe_filename(F.col("n")), T.dataset_key(F.lit("u"), F.col("n")),
        T.encoder_key(F.lit("a/b/c")), T.encoder_key(F.lit("x.csv"))).first()
    assert row[0] == "мой_файл_1_.csv" and row[1] == "u/мой файл(1)/мой файл(1).csv"
    assert (row[2], row[3]) == ("a/b/feature_encoder.pkl", "x_feature_encoder.pkl")


def test_registry_life(spark, tmp_path):
    reg = R.Registry(spark, str(tmp_path / "reg"))
    now = dt.datetime(2024, 1, 1)
    reg.add_chat("c1", "u1", "f.csv", "c1/f.csv")
    reg.add_chat("c2", "u1", "g.csv", "g.csv")
    run = reg.add_run("regression", "y", now, now, "training", 2)
    models = spark.createDataFrame(
        [("Ridge", 1, {"r2": 0.5}), ("Lasso", 2, {"r2": 0.4})],
        "model_name string, place_in_training_batch int, metrics map<string,double>")
    reg.add_models(run, models)
    second = reg.add_run("classification", "y", now, now)
    reg.add_models(second, models)
    assert (run, second) == (1, 2)
    chats = R.update_rows(reg.read("automl_chats"), spark.createDataFrame(
        [("c1", run)], "chat_id string, training_id long"), "chat_id")
    reg.replace("automl_chats", chats)
    hist = R.history(reg.read("automl_chats"), reg.read("training_result"), "u1").collect()
    assert [(h["id"], h["status"], h["training_id"]) for h in hist] == [
        ("c1", "training", "1"), ("c2", "idle", None)]
    detail = R.run_detail(reg.read("training_x_models"), reg.read("models_metadata"))
    assert detail.count() == 4
    assert R.models_with_task(reg.read("models_metadata"), reg.read("training_x_models"),
                              reg.read("training_result")).where("model_id = 3").first()[
        "task_type"] == "classification"
    assert reg.delete_run(run) and not reg.delete_run(77)
    assert [r["model_id"] for r in reg.read("models_metadata").orderBy("model_id").collect()] == [3, 4]
    assert reg.read("training_result").count() == 1
    left = R.delete_untrained(reg.read("automl_chats"), user_id="u1")
    assert [r["chat_id"] for r in left.collect()] == ["c1"]
    assert R.delete_chat(left, "c1").isEmpty()


def test_same_model_name_last_wins(spark):
    links = spark.createDataFrame([(1, 5), (1, 9)], "training_id long, model_id long")
    models = spark.createDataFrame(
        [(5, "KNN", 1, {"model_name": "shown"}), (9, "KNN", 2, {"k": "v"})],
        "model_id long, model_name string, place_in_training_batch int, "
        "model_metadata map<string,string>").withColumns({
            "hyperparameters": F.create_map().cast("map<string,string>"),
            "metrics": F.create_map().cast("map<string,double>")})
    rows = R.run_detail(links, models).collect()
    assert len(rows) == 1 and rows[0]["model_id"] == 9
    assert rows[0]["record"]["k"] == "v" and rows[0]["record"]["model_name"] == "KNN"


@pytest.mark.parametrize("model,task,plan,ok", [
    ("KMeans_linear", "clustering", 1, False), ("KMeans_linear", "clustering", 2, True),
    ("MeanShift_linear", "clustering", 2, False), ("MeanShift_linear", "clustering", 3, True),
    ("Ridge", "regression", 1, True), ("XGBoost", "classification", 1, False),
    ("XGBoost", "classification", 2, True)])
def test_plans(spark, model, task, plan, ok):
    got = spark.range(1).select(R.is_allowed(F.lit(model), F.lit(task), F.lit(plan))).first()[0]
    assert got is ok


def test_unknown_user_has_plan_one(spark):
    users = spark.createDataFrame([("a", 3, True, False), ("b", 2, True, True)],
                                  "id string, plan_id int, is_active boolean, is_banned boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "user_id string")
    got = {r["user_id"]: (r["plan_id"], r["state"]) for r in R.user_state(asked, users).collect()}
    assert got == {"a": (3, "active"), "b": (2, "banned"), "z": (1, "unknown")}


def test_run_detail_groups_keys_only(spark):
    maps = "map('k', 'v') AS hyperparameters, map('s', 1D) AS metrics, map('b', x) AS model_metadata"
    models = spark.sql(f"""SELECT id AS model_id, name AS model_name, 1 AS place_in_training_batch,
        {maps} FROM VALUES (1L, 'A', 'one'), (2L, 'A', 'two'), (3L, NULL, 'three'), (3L, NULL, 'three')
        t(id, name, x)""")
    links = spark.sql("SELECT * FROM VALUES (7L, 1L), (7L, 2L), (7L, 3L), (8L, 1L) t(training_id, model_id)")
    out = R.run_detail(links, models)
    assert "SortAggregate(key=[training_id" not in out._jdf.queryExecution().sparkPlan().toString()
    got = {(r.training_id, r.model_id, r.record["b"]) for r in out.collect()}
    assert got == {(7, 2, "two"), (7, 3, "three"), (8, 1, "one")} and out.count() == 3


def test_large_leaderboard_is_ranked_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_A_TASK", 500)
    rows = [(t, f"m{(7 * i) % 13}", i, float(i % 5)) for t in range(40) for i in range(100)]
    df = spark.createDataFrame(rows, "run int, model_name string, model_id int, score double")
    dealt = R.dealt(df, len(rows), "run")
    top = R.ranked(dealt, "score", ["run"], 3, ("model_name", "model_id"))
    assert top.rdd.getNumPartitions() == 8
    got = {(r["run"], r["model_id"], r["place"]) for r in top.collect()}
    want = {(t, r[2], k + 1) for t in range(40) for k, r in enumerate(sorted(
        (x for x in rows if x[0] == t), key=lambda x: (-x[3], x[1], x[2]))[:3])}
    assert got == want
    assert R.dealt(df, 500, "run") is df
