"""Queries for sources, sinks and the registry. Registry tables are derived from orders, lineitem,
part and customer, so that their size follows the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.clean import drop_ids
from tessera.plans.catalog import query, table
from tessera.session import new_path
from tessera.sources import registry as R, tables as T

CHATS = """chats AS (SELECT 'c' || o_orderkey AS chat_id, 'u' || o_custkey AS user_id,
    'set ' || o_orderpriority || '.csv' AS dataset_name,
    CASE o_orderstatus WHEN 'O' THEN 'flat_' || o_orderkey ELSE 'c' || o_orderkey || '/set.csv' END
      AS files_key,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS training_id,
    o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS updated_at FROM orders)"""
RUNS = """runs AS (SELECT o_orderkey AS training_id,
    CASE LEFT(o_orderpriority, 1) WHEN '1' THEN 'clustering' WHEN '2' THEN 'regression'
      ELSE 'classification' END AS task_type,
    CASE WHEN LEFT(o_orderpriority, 1) <> '1' THEN 'price' END AS target,
    o_orderdate AS overall_train_start, o_orderdate + INTERVAL 2 HOUR AS overall_train_finish,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'training' ELSE 'failed' END AS status,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS plan_id FROM orders)"""
LINKS = """links AS (SELECT DISTINCT l_orderkey AS training_id, l_partkey AS model_id FROM lineitem)"""
NAMES = {"small": "KMeans_linear", "red": "GradientBoosting", "blue": "DBSCAN_linear",
         "large": "Ridge", "green": "MeanShift_linear"}
NAME_SQL = "CASE SPLIT_PART(p_name, ' ', 1) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE 'RandomForest' END"
MODELS = f"models AS (SELECT p_partkey AS model_id, {NAME_SQL} AS model_name, " \
         "p_size AS place_in_training_batch, p_retailprice AS score, p_brand AS brand FROM part)"


def chats(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.concat(F.lit("c"), key).alias("chat_id"),
        F.concat(F.lit("u"), "o_custkey").alias("user_id"),
        F.concat(F.lit("set "), "o_orderpriority", F.lit(".csv")).alias("dataset_name"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("flat_"), key)).otherwise(
            F.concat(F.lit("c"), key, F.lit("/set.csv"))).alias("files_key"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("training_id"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))


def runs(spark, d):
    o = table(spark, d, "orders")
    kind = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("training_id"),
        F.when(kind == "1", "clustering").when(kind == "2", "regression")
        .otherwise("classification").alias("task_type"),
        F.when(kind != "1", "price").alias("target"),
        F.col("o_orderdate").alias("overall_train_start"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 HOUR")).alias("overall_train_finish"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(
            F.col("o_orderstatus") == "O", "training").otherwise("failed").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
        .otherwise(3).alias("plan_id"))


def links(spark, d, rows: int = 0):
    """Each link once; ``rows`` of lineitem, where known, give the number of tasks."""
    return R.dealt(table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("training_id"), F.col("l_partkey").alias("model_id")), rows,
        "training_id", "model_id").distinct()


def models(spark, d):
    p = table(spark, d, "part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    name = F.lit(None).cast("string")
    for k, v in NAMES.items():
        name = F.when(first == k, v).otherwise(name)
    return p.select(
        F.col("p_partkey").alias("model_id"),
        F.coalesce(name, F.lit("RandomForest")).alias("model_name"),
        F.col("p_size").alias("place_in_training_batch"),
        F.create_map(F.lit("depth"), F.col("p_size").cast("string")).alias("hyperparameters"),
        F.create_map(F.lit("score"), F.col("p_retailprice")).alias("metrics"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("model_metadata"))


def users(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("u"), "c_custkey").alias("id"),
                    F.when(F.col("c_acctbal") > 5000, 3).when(F.col("c_acctbal") > 0, 2)
                    .otherwise(1).alias("plan_id"),
                    (F.col("c_mktsegment") != "MACHINERY").alias("is_active"),
                    (F.col("c_mktsegment") == "BUILDING").alias("is_banned"))


# ---------------------------------------------------------------- sources and sinks

@query("s1_csv_source", """
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
         o_orderpriority, o_orderstatus = 'F' AS done, NULLIF(o_orderstatus, 'O') AS order_status
  FROM orders""")
def s1(spark, d):
    path = new_path(spark, "csv")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(
            F.col("o_totalprice").cast("string")).alias("o_totalprice"), "o_orderpriority",
        (F.col("o_orderstatus") == "F").alias("done"),
        F.when(F.col("o_orderstatus") == "O", "null").otherwise(F.col("o_orderstatus"))
        .alias("order status"))
    o.write.option("header", True).csv(path)
    return T.read_csv(spark, path)


@query("s2_s3_snapshot", "SELECT ts, event_type, value FROM events")
def s3(spark, d):
    root = new_path(spark, "chats")
    T.write_snapshot(drop_ids(table(spark, d, "events")).drop("props"), root, "chat-1")
    return T.read_snapshot(spark, root, "chat-1")


@query("s5_append_rows", f"""WITH {RUNS}, {LINKS} SELECT task_type, status, COUNT(*) AS n_runs,
  CAST(SUM(n) AS BIGINT) AS n_links FROM runs LEFT JOIN (SELECT training_id, COUNT(*) AS n FROM links GROUP BY 1)
  USING (training_id) GROUP BY 1, 2""")
def s5(spark, d):
    reg = R.scratch_registry(spark)
    r = runs(spark, d)
    reg.append("training_result", r.where("status = 'completed'"))
    reg.append("training_result", r.where("status <> 'completed'"))
    reg.append("training_x_models", links(spark, d))
    n = reg.read("training_x_models").groupBy("training_id").agg(F.count("*").alias("n"))
    return (reg.read("training_result").join(n, "training_id", "left")
            .groupBy("task_type", "status").agg(F.count("*").alias("n_runs"),
                                                F.sum("n").alias("n_links")))


@query("s6_json_records", """
  SELECT '{"l_orderkey":' || l_orderkey || ',"l_quantity":' || l_quantity || ',"ratio":' ||
    CASE WHEN l_discount = 0 THEN 'null' ELSE CAST(l_quantity AS VARCHAR) END ||
    ',"l_returnflag":' || CASE l_returnflag WHEN 'R' THEN 'null' ELSE '"' || l_returnflag || '"' END
    || '}' AS record FROM lineitem""")
def s6(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_quantity", F.when(F.col("l_discount") == 0, float("inf")).otherwise(
            F.col("l_quantity")).alias("ratio"), F.nullif("l_returnflag", F.lit("R"))
        .alias("l_returnflag"))
    return T.to_records(li)


@query("s7_split_result", f"""WITH {MODELS}
  SELECT model_name, '50' AS trees, CAST(model_id AS VARCHAR) AS n_clusters, brand,
    place_in_training_batch AS place_in_training_batch FROM models""")
def s7(spark, d):
    m = models(spark, d).select(
        "model_name", "metrics", F.create_map(F.lit("trees"), F.lit("50")).alias("hyperparams"),
        "model_metadata", F.col("model_id").alias("n_clusters"), "place_in_training_batch")
    out = T.split_result(m, "place_in_training_batch")
    return out.select("model_name", F.col("hyperparams.trees").alias("trees"),
                      F.col("model_metadata.n_clusters").alias("n_clusters"),
                      F.col("model_metadata.brand").alias("brand"), "place_in_training_batch")


@query("s8_cluster_report", """
  SELECT p_partkey AS place, p_partkey || '. ' || p_name || ' - ' || chr(10) ||
    'Unified score: ' || printf('%.4f', p_size / 50.0) || chr(10) ||
    'Silhouette: ' || CASE WHEN p_size > 25 THEN printf('%.4f', p_retailprice) ELSE 'N/A' END || chr(10) ||
    'Calinski-Harabasz: ' || printf('%.4f', p_retailprice) || chr(10) || 'Gap: N/A' AS text
  FROM part""")
def s8(spark, d):
    runs_ = table(spark, d, "part").select(
        F.col("p_partkey").alias("place"), F.col("p_name").alias("model_name"),
        (F.col("p_size") / 50.0).alias("unified_score"),
        F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(float("nan"))
        .alias("silhouette"), F.col("p_retailprice").alias("calinski_harabasz"),
        F.lit(None).cast("double").alias("gap"))
    return T.report_lines(runs_)


# ---------------------------------------------------------------- registry

@query("h1_history", f"""WITH {CHATS}, {RUNS}
  SELECT chat_id AS id, user_id, dataset_name, task_type, target, files_key, updated_at AS created_at,
         created_at AS first_created_at, COALESCE(status, 'idle') AS status,
         CAST(training_id AS VARCHAR) AS training_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id
           ORDER BY COALESCE(status = 'training', FALSE) DESC, updated_at DESC, chat_id) AS INT) AS place
  FROM chats LEFT JOIN runs USING (training_id)""")
def h1(spark, d):
    return R.history(chats(spark, d), runs(spark, d))


@query("h2_run_header", f"""WITH {CHATS}, {RUNS}
  SELECT r.*, user_id, files_key, CASE WHEN files_key LIKE '%/%' THEN SPLIT_PART(files_key, '/', -1)
    ELSE COALESCE(files_key, 'Dataset_' || r.training_id) END AS filename
  FROM runs r LEFT JOIN chats c ON r.training_id = c.training_id""")
def h2(spark, d):
    return R.run_header(runs(spark, d), chats(spark, d))


@query("h3_run_detail", f"""WITH {LINKS}, {MODELS}
  SELECT training_id, model_name, model_id, place_in_training_batch, brand, depth, score FROM (
    SELECT training_id, model_name, model_id, place_in_training_batch, brand,
           CAST(place_in_training_batch AS VARCHAR) AS depth, score,
           ROW_NUMBER() OVER (PARTITION BY training_id, model_name ORDER BY model_id DESC) AS rn
    FROM links JOIN models USING (model_id)) WHERE rn = 1""")
def h3(spark, d):
    return R.run_detail(links(spark, d), models(spark, d)).select(
        "training_id", "model_name", "model_id", "place_in_training_batch",
        F.col("record.brand").alias("brand"), F.col("hyperparams.depth").alias("depth"),
        F.col("metrics.score").alias("score"))


@query("h4_model_task", f"""WITH {LINKS}, {MODELS}, {RUNS}
  SELECT model_id, model_name, COALESCE(task_type, 'classification') AS task_type, target
  FROM models LEFT JOIN (SELECT model_id AS mid, MIN(training_id) AS training_id
                         FROM links JOIN runs USING (training_id) GROUP BY 1)
    ON model_id = mid LEFT JOIN runs USING (training_id)""")
def h4(spark, d):
    return R.models_with_task(models(spark, d), links(spark, d), runs(spark, d)).select(
        "model_id", "model_name", "task_type", "target")


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("h5_allowed_models", f"""WITH {LINKS}, {MODELS}, {RUNS},
  a AS (SELECT training_id, model_id, model_name, task_type, plan_id,
               SPLIT_PART(model_name, '_', 1) AS b
        FROM links JOIN models USING (model_id) JOIN runs USING (training_id))
  SELECT training_id, model_id, model_name FROM a WHERE CASE WHEN task_type = 'clustering' THEN
    CASE WHEN plan_id <= 1 THEN FALSE WHEN plan_id = 2 THEN b IN {_in(R.CLUSTER_POOL_2)}
         ELSE b IN {_in(R.CLUSTER_POOL_2 + R.CLUSTER_POOL_3)} END
    WHEN plan_id = 1 THEN b IN {_in(R.SUPERVISED_POOL_1)}
    ELSE b IN {_in(R.SUPERVISED_POOL_1 + R.SUPERVISED_POOL_2)} END""")
def h5(spark, d):
    all_ = links(spark, d).join(models(spark, d), "model_id").join(runs(spark, d), "training_id")
    return all_.where(R.is_allowed(F.col("model_name"), F.col("task_type"), F.col("plan_id"))
                      ).select("training_id", "model_id", "model_name")


@query("h6_file_names", r"""
  SELECT url, CASE WHEN url LIKE '%/%' THEN SPLIT_PART(url, '/', -1) ELSE url END AS filename,
    LEFT(REGEXP_REPLACE(TRIM(url), '[^A-Za-z0-9_.\-]', '_', 'g'), 100) AS safe,
    CASE WHEN url LIKE '%/%' THEN SPLIT_PART(url, '/', 1) || '/' || SPLIT_PART(url, '/', 2) ||
      '/feature_encoder.pkl' ELSE url || '_feature_encoder.pkl' END AS encoder
  FROM pages""")
def h6(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "url", T.file_name(url, F.lit("Dataset")).alias("filename"),
        T.safe_filename(url).alias("safe"), T.encoder_key(url).alias("encoder"))


@query("h7_backfill", f"""WITH {CHATS}, {RUNS},
  new AS (SELECT MD5('run-' || training_id) AS chat_id, 'u' || o_custkey AS user_id,
          'old' AS dataset_name, 'k/old' AS files_key, training_id,
          overall_train_start AS created_at, overall_train_finish AS updated_at
          FROM runs JOIN orders ON o_orderkey = training_id
          WHERE NOT EXISTS (SELECT 1 FROM chats WHERE chats.training_id = runs.training_id))
  SELECT * FROM chats UNION ALL SELECT * FROM new""")
def h7(spark, d):
    owner = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("training_id"), F.concat(F.lit("u"), "o_custkey")
        .alias("user_id"))
    old = runs(spark, d).join(owner, "training_id").withColumn("files_key", F.lit("k/old"))
    return R.backfill_chats(chats(spark, d), old)


@query("h8_cascade_delete", f"""WITH {LINKS}, {MODELS}, {RUNS},
  ids AS (SELECT training_id FROM runs WHERE status = 'failed'),
  gone AS (SELECT DISTINCT model_id FROM links WHERE training_id IN (SELECT training_id FROM ids))
  SELECT 'runs' AS part, COUNT(*) AS n FROM runs WHERE training_id NOT IN (SELECT training_id FROM ids)
  UNION ALL SELECT 'links', COUNT(*) FROM links WHERE training_id NOT IN (SELECT training_id FROM ids)
  UNION ALL SELECT 'models', COUNT(*) FROM models WHERE model_id NOT IN (SELECT model_id FROM gone)""")
def h8(spark, d):
    r = runs(spark, d)
    ids = r.where("status = 'failed'").select("training_id")
    kept = R.cascade_delete(r, links(spark, d), models(spark, d), ids)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
             for k, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("h9_delete_untrained", f"""WITH {CHATS} SELECT chat_id, user_id, training_id FROM chats
  WHERE NOT (training_id IS NULL AND user_id IN (
    SELECT 'u' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""")
def h9(spark, d):
    who = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("u"), "c_custkey").alias("user_id"))
    return R.delete_untrained(chats(spark, d), who).select("chat_id", "user_id", "training_id")


@query("h10_update_status", f"""WITH {RUNS} SELECT training_id, plan_id,
  CASE WHEN status = 'training' THEN 'completed' ELSE status END AS status,
  CASE WHEN status = 'training' THEN overall_train_start + INTERVAL 1 DAY
       ELSE overall_train_finish END AS overall_train_finish FROM runs""")
def h10(spark, d):
    r = runs(spark, d)
    done = r.where("status = 'training'").select(
        "training_id", F.lit("completed").alias("status"),
        (F.col("overall_train_start") + F.expr("INTERVAL 1 DAY")).alias("overall_train_finish"))
    return R.update_rows(r, done, "training_id").select("training_id", "plan_id", "status",
                                                        "overall_train_finish")


@query("h11_user_plan", """
  WITH asked AS (SELECT DISTINCT 'u' || o_custkey AS user_id FROM orders UNION
                 SELECT DISTINCT 'u' || (100000000 + o_custkey) FROM orders),
       users AS (SELECT 'u' || c_custkey AS user_id, CASE WHEN c_acctbal > 5000 THEN 3
                   WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS plan_id, c_mktsegment AS m FROM customer)
  SELECT user_id, COALESCE(plan_id, 1) AS plan_id, CASE WHEN m IS NULL THEN 'unknown'
    WHEN m = 'BUILDING' THEN 'banned' WHEN m = 'MACHINERY' THEN 'inactive' ELSE 'active' END AS state
  FROM asked LEFT JOIN users USING (user_id)""")
def h11(spark, d):
    o = table(spark, d, "orders")
    asked = o.select(F.concat(F.lit("u"), "o_custkey").alias("user_id")).union(
        o.select(F.concat(F.lit("u"), F.col("o_custkey") + 100000000))).distinct()
    return R.user_state(asked, users(spark, d))


@query("t3_leaderboard", f"""WITH {LINKS}, {MODELS} SELECT training_id, model_id, score,
  CAST(place AS INT) AS place FROM (SELECT training_id, model_id, score, ROW_NUMBER() OVER (
    PARTITION BY training_id ORDER BY score DESC, model_name, model_id) AS place
    FROM links JOIN models USING (model_id)) WHERE place <= 3""")
def t3(spark, d):
    rows = table(spark, d, "lineitem").count()
    # Only what the ranking reads goes through the join, not the models' maps.
    m = models(spark, d).select("model_id", "model_name", F.col("metrics.score").alias("score"))
    lb = R.dealt(links(spark, d, rows), rows, "model_id").join(m, "model_id")
    return R.ranked(R.dealt(lb, rows, "training_id"), "score", ["training_id"], 3,
                    ("model_name", "model_id")).select("training_id", "model_id", "score", "place")


@query("q13_normalise_runs", """
  SELECT p_partkey, ROUND((p_retailprice - MIN(p_retailprice) OVER ()) /
    (MAX(p_retailprice) OVER () - MIN(p_retailprice) OVER ()), 6) AS price_norm, 1.0 AS flat_norm
  FROM part""")
def q13(spark, d):
    from tessera.functions.metrics import normalise_runs
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"),
                                       F.lit(2.0).alias("flat"))
    return normalise_runs(p, ["price", "flat"]).select(
        "p_partkey", F.round("price_norm", 6).alias("price_norm"), "flat_norm")
