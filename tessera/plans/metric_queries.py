"""Queries for the evaluation metrics, on rule-based predictions over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.plans.catalog import query, table

# y: return flag as 0..2; p: a rule on quantity; s: a score for "flag is R"
BASE = """b AS (SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INT) AS y,
    CAST(CASE WHEN l_quantity > 33 THEN 2 WHEN l_quantity > 16 THEN 1 ELSE 0 END AS INT) AS p,
    CAST(l_linestatus = 'O' AS INT) AS y2, CAST(l_quantity > 25 AS INT) AS p2,
    l_extendedprice AS score, l_quantity / 50 AS s0, l_discount * 10 AS s1, l_tax * 10 AS s2,
    l_extendedprice AS t, l_quantity * 1500 + l_discount * 1000 AS q FROM lineitem)"""


def base(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
        .otherwise(2).alias("y"),
        F.when(q > 33, 2).when(q > 16, 1).otherwise(0).alias("p"),
        (F.col("l_linestatus") == "O").cast("int").alias("y2"), (q > 25).cast("int").alias("p2"),
        F.col("l_extendedprice").alias("score"),
        F.array(q / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("probability"),
        F.col("l_extendedprice").alias("t"), (q * 1500 + F.col("l_discount") * 1000).alias("q"))


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("e1_accuracy", f"WITH {BASE} SELECT ROUND(AVG(CAST(y = p AS INT)), 6) AS accuracy FROM b")
def e1(spark, d):
    return r6(M.accuracy(base(spark, d), "y", "p"), "accuracy")


F1 = """SELECT k AS label, SUM(CAST(y = k AND p = k AS INT)) AS tp,
    SUM(CAST(y <> k AND p = k AS INT)) AS fp, SUM(CAST(y = k AND p <> k AS INT)) AS fn
    FROM b, (SELECT DISTINCT y AS k FROM b) g GROUP BY k"""


@query("e2_f1_macro", f"""WITH {BASE}, f AS ({F1})
  SELECT ROUND(AVG(2.0 * tp / (2 * tp + fp + fn)), 6) AS f1_score FROM f""")
def e2(spark, d):
    return r6(M.f1_macro(base(spark, d), "y", "p"), "f1_score")


@query("e2_f1_binary", f"""WITH {BASE} SELECT ROUND(2.0 * SUM(y2 * p2) / (SUM(y2) + SUM(p2)), 6)
  AS f1_score FROM b""")
def e2_binary(spark, d):
    return r6(M.f1_binary(base(spark, d), "y2", "p2"), "f1_score")


@query("e2_class_scores", f"""WITH {BASE}, f AS ({F1})
  SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
         ROUND(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM f""")
def e2_scores(spark, d):
    return r6(M.class_scores(base(spark, d), "y", "p"), "f1")


def _auc(hit, score):
    return f"""SELECT (SUM(CASE WHEN h = 1 THEN r END) - SUM(h) * (SUM(h) + 1) / 2.0)
       / (SUM(h) * 1.0 * SUM(1 - h)) AS a
     FROM (SELECT h, RANK() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
           FROM (SELECT CAST({hit} AS INT) AS h, {score} AS s FROM b))"""


@query("e3_auc", f"WITH {BASE} SELECT ROUND(a, 6) AS roc_auc FROM ({_auc('y2 = 1', 'score')})")
def e3(spark, d):
    return r6(M.auc_binary(base(spark, d), "y2", "score"), "roc_auc")


@query("e4_auc_macro", f"""WITH {BASE} SELECT ROUND(AVG(a), 6) AS roc_auc FROM (
  {_auc('y = 0', 's0')} UNION ALL {_auc('y = 1', 's1')} UNION ALL {_auc('y = 2', 's2')})""")
def e4(spark, d):
    return r6(M.auc_macro(base(spark, d), "y", "probability"), "roc_auc")


@query("e5_confusion", f"""WITH {BASE}, k AS (SELECT DISTINCT y AS v FROM b UNION SELECT p FROM b)
  SELECT g.y, g.p, COUNT(b.y) AS n FROM (SELECT a.v AS y, c.v AS p FROM k a, k c) g
  LEFT JOIN b ON b.y = g.y AND b.p = g.p GROUP BY 1, 2""")
def e5(spark, d):
    return M.confusion(base(spark, d), "y", "p")


@query("e6_mse_rmse", f"""WITH {BASE} SELECT ROUND(AVG((t - q) * (t - q)), 2) AS mse,
  ROUND(SQRT(AVG((t - q) * (t - q))), 4) AS rmse FROM b""")
def e6(spark, d):
    return M.regression_metrics(base(spark, d), "t", "q").select(
        F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"))


@query("e7_mae", f"WITH {BASE} SELECT ROUND(AVG(ABS(t - q)), 4) AS mae FROM b")
def e7(spark, d):
    return M.regression_metrics(base(spark, d), "t", "q").select(F.round("mae", 4).alias("mae"))


@query("e8_r2", f"""WITH {BASE} SELECT ROUND(1 - SUM((t - q) * (t - q)) / (VAR_POP(t) * COUNT(*)), 6)
  AS r2 FROM b""")
def e8(spark, d):
    return M.regression_metrics(base(spark, d), "t", "q").select(F.round("r2", 6).alias("r2"))


@query("e9_predicted_vs_true", f"WITH {BASE} SELECT t AS y_true, ROUND(q, 6) AS y_pred FROM b")
def e9(spark, d):
    return base(spark, d).select(F.col("t").alias("y_true"), F.round("q", 6).alias("y_pred"))


@query("t2_main_metric", f"""WITH {BASE}, f AS ({F1})
  SELECT CASE WHEN (SELECT MIN(n) * 1.0 / MAX(n) FROM (SELECT COUNT(*) AS n FROM b GROUP BY y)) < 0.5
    THEN (SELECT ROUND(AVG(2.0 * tp / (2 * tp + fp + fn)), 6) FROM f)
    ELSE (SELECT ROUND(AVG(CAST(y = p AS INT)), 6) FROM b) END AS main_metric""")
def t2(spark, d):
    from tessera.operators.features import imbalance
    b = base(spark, d)
    shape = imbalance(b, "y").first()
    name = M.main_metric("classification", 3, shape["is_imbalanced"])
    out = M.f1_macro(b, "y", "p") if name == "f1_macro" else M.accuracy(b, "y", "p")
    return out.select(F.round(F.col(out.columns[0]), 6).alias("main_metric"))
