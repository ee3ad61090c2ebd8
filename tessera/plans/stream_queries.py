"""Queries for progress and active datasets, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.plans.catalog import query, table
from tessera.session import new_path
from tessera.streaming import progress as P

STEPS = {"click": 1, "error": 6, "purchase": 5, "signup": 0, "view": 2}


def progress(ev: DataFrame) -> DataFrame:
    index = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])[F.col("event_type")]
    return ev.select(F.col("user_id").alias("training_id"), F.col("event_type").alias("step"),
                     F.coalesce(index, F.lit(3)).alias("step_index"),
                     F.when(F.col("value") > 10, F.col("props")).alias("model_name"),
                     F.col("ts").cast("timestamp").alias("ts"))


def datasets(ev: DataFrame) -> DataFrame:
    return ev.select(F.concat(F.lit("u"), "user_id").alias("user_id"),
                     F.concat_ws("/", "event_type", "props").alias("files_key"),
                     F.col("event_type").alias("filename"), F.col("ts").cast("timestamp")
                     .alias("ts"))


IDX = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STEPS.items()) + " ELSE 3 END"
PROG = f"""p AS (SELECT user_id AS training_id, event_type AS step, CAST({IDX} AS INT) AS step_index,
  CASE WHEN value > 10 THEN props END AS model_name, ts FROM events)"""
LAST = """SELECT training_id, step, step_index, model_name FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY training_id ORDER BY ts DESC) AS rn FROM p) WHERE rn = 1
    AND ts > (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR"""
FEED = """SELECT p.training_id, step, step_index, model_name FROM p LEFT JOIN (
  SELECT training_id, MIN(ts) AS fin FROM p WHERE step_index = 6 GROUP BY 1) e USING (training_id)
  WHERE fin IS NULL OR ts <= fin"""


@query("w1_latest_progress", f"""WITH {PROG}, l AS (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY training_id ORDER BY ts DESC) AS rn FROM p)
  SELECT training_id, step, step_index, model_name FROM l WHERE rn = 1
    AND ts > (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR""")
def w1(spark, d):
    ev = table(spark, d, "events")
    now = ev.agg(F.max("ts").cast("timestamp")).first()[0]
    return P.latest_progress(progress(ev), F.lit(now)).drop("ts")


@query("w2_progress_feed", f"WITH {PROG} {FEED}")
def w2(spark, d):
    return P.feed(progress(table(spark, d, "events"))).drop("ts")


@query("w3_active_datasets", """WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
    ORDER BY ts DESC) AS rn FROM events)
  SELECT 'u' || user_id AS user_id, event_type || '/' || props AS files_key, event_type AS filename
  FROM l WHERE rn = 1 AND ts > (SELECT MAX(ts) FROM events) - INTERVAL 15 MINUTE""")
def w3(spark, d):
    ev = table(spark, d, "events")
    now = ev.agg(F.max("ts").cast("timestamp")).first()[0]
    return P.active_datasets(datasets(ev), F.lit(now)).drop("ts")


def _events_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("w1_latest_progress_stream", f"WITH {PROG} {LAST}")
def w1_stream(spark, d):
    state = new_path(spark, "stream-state")
    P.run_available(P.stream_latest_progress(progress(_events_stream(spark, d))), state)
    return P.read_latest(spark, state).drop("ts")


@query("w2_progress_feed_stream", f"WITH {PROG} {FEED}")
def w2_stream(spark, d):
    sink = new_path(spark, "stream")
    P.run_feed(progress(_events_stream(spark, d)), sink, new_path(spark, "stream-state"))
    return spark.read.parquet(sink).drop("ts")


@query("w3_active_datasets_stream", """SELECT 'u' || user_id AS user_id,
  event_type || '/' || props AS files_key, event_type AS filename FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1
    AND ts > (SELECT MAX(ts) FROM events) - INTERVAL 15 MINUTE""")
def w3_stream(spark, d):
    state = new_path(spark, "stream-state")
    P.run_available(P.stream_active_datasets(datasets(_events_stream(spark, d))), state)
    return P.read_latest(spark, state).drop("ts")
