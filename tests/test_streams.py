import datetime as dt

from pyspark.sql import functions as F

from tessera.streaming import progress as P

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def batches(spark, path, schema, parts):
    """One file per micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


PROGRESS = "training_id long, step string, step_index int, model_name string, ts timestamp"


def test_latest_progress_over_batches(spark, tmp_path):
    """Late rows and expiry over several micro-batches leave what the batch form leaves."""
    parts = [[(1, "a", 1, None, at(0)), (2, "a", 1, "m", at(1)), (3, "x", 1, None, at(60))],
             [(1, "b", 2, "KNN", at(5)), (3, "y", 2, None, at(80)), (3, "z", 2, None, at(70))],
             [(1, "old", 0, None, at(2)), (4, "q", 1, "m", at(150))],
             [(3, "late", 3, None, at(100)), (5, "r", 1, None, at(200))],   # late, but not expired
             [(1, "expired", 3, None, at(20)), (2, "z", 6, None, at(210))]]
    s = batches(spark, str(tmp_path / "in"), PROGRESS, parts)
    checkpoint = str(tmp_path / "c")
    P.run_available(P.stream_latest_progress(s), checkpoint)
    got = sorted(tuple(r) for r in P.read_latest(spark, checkpoint).collect())
    rows = spark.createDataFrame([r for p in parts for r in p], PROGRESS)
    want = P.latest_progress(rows, F.lit(at(210))).select(
        "training_id", "step", "step_index", "model_name", "ts").collect()
    assert got == sorted(tuple(r) for r in want)
    assert [r[:2] for r in got] == [(2, "z"), (3, "late"), (4, "q"), (5, "r")]


def test_feed_stops_at_the_last_step(spark, tmp_path):
    parts = [[(1, "a", 1, None, at(0)), (2, "a", 1, None, at(0))],
             [(1, "end", 6, None, at(3)), (1, "late", 2, None, at(4))],
             [(1, "again", 1, None, at(9)), (2, "b", 2, None, at(9))]]
    s = batches(spark, str(tmp_path / "in"), PROGRESS, parts)
    P.run_feed(s, str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted((r["training_id"], r["step"]) for r in spark.read.parquet(
        str(tmp_path / "out")).collect())
    assert got == [(1, "a"), (1, "end"), (2, "a"), (2, "b")]
    rows = spark.createDataFrame([r for p in parts for r in p], PROGRESS)
    assert sorted((r["training_id"], r["step"]) for r in P.feed(rows).collect()) == got


def test_active_dataset(spark, tmp_path):
    schema = "user_id string, files_key string, filename string, ts timestamp"
    rows = [("u", "k1", "f1", at(0)), ("u", "k2", "f2", at(2)), ("v", "k3", "f3", at(30))]
    s = batches(spark, str(tmp_path / "in"), schema, [rows])
    P.run_available(P.stream_active_datasets(s), str(tmp_path / "c"))
    got = {r["user_id"]: r["files_key"] for r in P.read_latest(spark, str(tmp_path / "c")).collect()}
    assert got == {"v": "k3"}
    live = P.active_datasets(spark.createDataFrame(rows, schema), F.lit(at(31))).collect()
    assert [r["user_id"] for r in live] == ["v"]
