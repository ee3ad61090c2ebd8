"""Queries for feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.ordered import most_frequent
from tessera.operators import features as X
from tessera.operators.clean import with_row_key
from tessera.plans.catalog import query, table
from tessera.session import written


def gaps(spark, d):
    """lineitem keys and numbers, with nulls where the quantity or discount takes some value."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.nullif("l_quantity", F.lit(13.0)).alias("l_quantity"),
        F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"))


GAPS = """t AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
    NULLIF(l_quantity, 13.0) AS l_quantity, NULLIF(l_discount, 0.05) AS l_discount,
    NULLIF(l_returnflag, 'R') AS l_returnflag FROM lineitem)"""


def sixes(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("f1_median_imputation", f"""WITH {GAPS} SELECT l_orderkey, l_linenumber,
  COALESCE(l_quantity, (SELECT QUANTILE_CONT(l_quantity, 0.5) FROM t)) AS l_quantity,
  COALESCE(l_discount, (SELECT QUANTILE_CONT(l_discount, 0.5) FROM t)) AS l_discount FROM t""")
def f1(spark, d):
    return X.impute_median(gaps(spark, d).select("l_orderkey", "l_linenumber", "l_quantity",
                                                 "l_discount"), ["l_quantity", "l_discount"])


@query("f2_robust_scaling", """
  WITH q AS (SELECT QUANTILE_CONT(l_extendedprice, [0.25, 0.5, 0.75]) AS p,
                    QUANTILE_CONT(l_quantity, [0.25, 0.5, 0.75]) AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber,
         ROUND((l_extendedprice - p[2]) / (p[3] - p[1]), 6) AS l_extendedprice,
         ROUND((l_quantity - s[2]) / (s[3] - s[1]), 6) AS l_quantity, 0.0 AS flat
  FROM lineitem, q""")
def f2(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                            "l_quantity", F.lit(7.0).alias("flat"))
    cols = ["l_extendedprice", "l_quantity", "flat"]
    return sixes(X.fit_robust(li, cols).apply(li), *cols)


@query("f3_most_frequent_imputation", f"""
  WITH {GAPS} SELECT l_orderkey, l_linenumber, COALESCE(l_returnflag,
    (SELECT l_returnflag FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1
     ORDER BY COUNT(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag FROM t""")
def f3(spark, d):
    return X.impute_most_frequent(gaps(spark, d).select("l_orderkey", "l_linenumber",
                                                        "l_returnflag"), ["l_returnflag"])


@query("f3_most_frequent_values", """
  SELECT * FROM (SELECT 'p_name' AS "column", p_name AS value FROM part GROUP BY p_name
                 ORDER BY COUNT(*) DESC, p_name LIMIT 1) UNION ALL
  SELECT * FROM (SELECT 'p_brand', p_brand FROM part GROUP BY p_brand
                 ORDER BY COUNT(*) DESC, p_brand LIMIT 1)""")
def f3_values(spark, d):
    return most_frequent(table(spark, d, "part"), ["p_name", "p_brand"])


@query("f4_one_hot", """SELECT l_orderkey, l_linenumber,
  CAST(l_returnflag = 'A' AS INT) AS "l_returnflag=A",
  CAST(l_returnflag = 'N' AS INT) AS "l_returnflag=N",
  CAST(l_linestatus = 'F' AS INT) AS "l_linestatus=F",
  CAST(l_linestatus = 'O' AS INT) AS "l_linestatus=O" FROM lineitem""")
def f4(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                            "l_linestatus")
    cols = ["l_returnflag", "l_linestatus"]
    # Fitted without R: an R row is then all zeros.
    codes = X.category_map(li.where("l_returnflag <> 'R'"), cols)
    return X.one_hot(li, cols, codes)[0].drop(*cols)


@query("f5_hashed_text")
def f5(spark, d):
    part = table(spark, d, "part")
    hashed = X.hash_slots(part, ["p_name", "p_brand"], signed=False)
    return (hashed.select(F.posexplode("hashed").alias("slot", "v")).where("v > 0")
            .groupBy("slot").agg(F.sum("v").alias("tokens")))


@query("f6_truncated_svd")
def f6(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    reduced, svd = X.compress_if_wide(emb, "embedding", "clustering", "features")
    return reduced.select("vec_id", F.size("features").alias("width"), F.transform(
        F.slice("features", 1, 3), lambda x: F.round(F.abs(x), 6)).alias("first3"))


ORD = """WITH m AS (SELECT v, DENSE_RANK() OVER (ORDER BY v) - 1 AS c FROM (
    SELECT DISTINCT COALESCE(NULLIF(l_returnflag, 'R'), 'missing') AS v FROM lineitem))"""


@query("f7_ordinal_codes", f"""{ORD} SELECT l_orderkey, l_linenumber,
  CAST(COALESCE(c, -1) AS DOUBLE) AS l_returnflag
  FROM lineitem LEFT JOIN m ON CASE l_returnflag WHEN 'R' THEN 'R' ELSE l_returnflag END = m.v""")
def f7(spark, d):
    # R is null when fitting and text when scoring: unknown there, so −1.
    fit = gaps(spark, d).select("l_returnflag")
    codes = X.category_map(fit, ["l_returnflag"])
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return X.encode_ordinal(li, ["l_returnflag"], codes)


@query("f7_ordinal_codes_many_values", """
  WITH m AS (SELECT v, DENSE_RANK() OVER (ORDER BY v) - 1 AS c
             FROM (SELECT DISTINCT c_name AS v FROM customer))
  SELECT c_custkey, CAST(c AS DOUBLE) AS c_name FROM customer JOIN m ON c_name = v""")
def f7_many(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_name")
    return X.encode_ordinal(cu, ["c_name"], X.category_map(cu, ["c_name"]))


@query("f8_category_map", f"""{ORD}
  SELECT 'l_returnflag' AS "column", v AS value, CAST(c AS INT) AS code FROM m""")
def f8(spark, d):
    return X.category_map(gaps(spark, d), ["l_returnflag"])


@query("f9_target_labels", """
  WITH m AS (SELECT v, DENSE_RANK() OVER (ORDER BY v) - 1 AS c
             FROM (SELECT DISTINCT p_size AS v FROM part))
  SELECT p_partkey, CAST(c AS INT) AS label, v AS predicted FROM part JOIN m ON p_size = v""")
def f9(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size")
    codes = X.target_codes(part, "p_size")
    labelled = X.encode_target(part, "p_size", codes)
    return X.decode_target(labelled.withColumn("prediction", F.col("label").cast("double")),
                           codes).select("p_partkey", "label", "predicted")


@query("f10_to_number", """
  SELECT o_orderkey, TRY_CAST(SPLIT_PART(o_orderpriority, '-', 1) AS DOUBLE) AS parsed,
         COALESCE(TRY_CAST(o_orderpriority AS DOUBLE), 0) AS filled FROM orders""")
def f10(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey",
                    X.to_number(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
                    .alias("parsed"), X.to_number("o_orderpriority", 0.0).alias("filled"))


@query("f11_standard_scaling", """
  WITH s AS (SELECT AVG(l_quantity) AS m, STDDEV_POP(l_quantity) AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber, ROUND((l_quantity - m) / s, 6) AS l_quantity, 0.0 AS flat
  FROM lineitem, s""")
def f11(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                            F.lit(3.0).alias("flat"))
    cols = ["l_quantity", "flat"]
    return sixes(X.fit_standard(li, cols).apply(li), *cols)


@query("f12_polynomial", """SELECT l_orderkey, l_linenumber, l_quantity, l_tax,
  ROUND(l_quantity * l_quantity, 6) AS "l_quantity^2",
  ROUND(l_quantity * l_tax, 6) AS "l_quantity l_tax", ROUND(l_tax * l_tax, 6) AS "l_tax^2"
  FROM lineitem""")
def f12(spark, d):
    out = X.polynomial(table(spark, d, "lineitem"), ["l_quantity", "l_tax"],
                       ["l_orderkey", "l_linenumber"])
    return sixes(out, *out.columns[4:])


NUMS = ["l_quantity", "l_extendedprice", "l_discount"]


def _anova(c):
    return f"""SELECT '{c}' AS feature, ROUND((b / (k - 1)) / ((t - b) / (n - k)), 6) AS f_score
      FROM (SELECT SUM(cn * (cm - g) * (cm - g)) AS b, MAX(t) AS t, COUNT(*) AS k, SUM(cn) AS n
            FROM (SELECT COUNT(*) AS cn, AVG({c}) AS cm FROM lineitem GROUP BY l_returnflag) a,
                 (SELECT AVG({c}) AS g, VAR_POP({c}) * COUNT(*) AS t FROM lineitem) b) z"""


def _freg(c):
    return f"""SELECT '{c}' AS feature, ROUND(r * r / (1 - r * r) * (n - 2), 6) AS f_score
      FROM (SELECT CORR({c}, l_tax) AS r, COUNT(*) AS n FROM lineitem)"""


@query("f13_anova_f", " UNION ALL ".join(map(_anova, NUMS)))
def f13(spark, d):
    return sixes(X.anova_f(table(spark, d, "lineitem"), "l_returnflag", NUMS), "f_score")


@query("f14_regression_f", " UNION ALL ".join(map(_freg, NUMS)))
def f14(spark, d):
    return sixes(X.regression_f(table(spark, d, "lineitem"), "l_tax", NUMS), "f_score")


@query("f15_select_features", f"""SELECT feature, f_score, CAST(ROW_NUMBER() OVER (
  ORDER BY f_score DESC, feature) AS INT) AS place FROM ({' UNION ALL '.join(map(_anova, NUMS))})""")
def f15(spark, d):
    return sixes(X.select_features(X.anova_f(table(spark, d, "lineitem"), "l_returnflag", NUMS)),
                 "f_score")


def _skew(t, c):
    return f"""SELECT COUNT({c}) AS n, ROUND((SUM(POWER({c} - m, 3)) / COUNT(*)) /
      POWER(MAX(v), 1.5) * SQRT(COUNT(*) * (COUNT(*) - 1.0)) / (COUNT(*) - 2), 6) AS skew
      FROM {t}, (SELECT AVG({c}) AS m, VAR_POP({c}) AS v FROM {t}) s"""


@query("f16_corrected_skew", _skew("events", "value"))
def f16(spark, d):
    return sixes(X.corrected_skew(table(spark, d, "events"), "value"), "skew")


@query("f16_log1p_gate", f"""
  WITH g AS ({_skew('events', 'value')}), h AS ({_skew('lineitem', 'l_quantity')})
  SELECT event_id AS id, ROUND(CASE WHEN ABS((SELECT skew FROM g)) > 1.0 THEN LN(1 + value)
                               ELSE value END, 6) AS y FROM events""")
def f16_gate(spark, d):
    out, _ = X.log_target(table(spark, d, "events").select("event_id", "value"), "value")
    return out.select(F.col("event_id").alias("id"), F.round("y", 6).alias("y"))


DECILES = """e AS (SELECT LIST_DISTINCT(QUANTILE_CONT(l_quantity,
    [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q FROM lineitem)"""


@query("f17_decile_bins", f"""WITH {DECILES}, i AS (SELECT LIST_SORT(q)[2:LEN(q) - 1] AS q FROM e)
  SELECT l_orderkey, l_linenumber, CAST(LEN(LIST_FILTER(q, LAMBDA x: x < l_quantity)) AS INT) AS bin
  FROM lineitem, i""")
def f17(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    edges = X.quantile_edges(li, "l_quantity")
    return li.select("l_orderkey", "l_linenumber",
                     X.quantile_bin("l_quantity", edges).alias("bin"))


@query("f18_split_counts", """
  WITH c AS (SELECT l_returnflag AS s, COUNT(*) AS n FROM lineitem GROUP BY 1),
       tot AS (SELECT SUM(n) AS n, SUM(n) - CEIL(SUM(n) * 0.25) AS n_train FROM c),
       share AS (SELECT s, c.n, c.n * n_train / tot.n AS x, n_train FROM c, tot),
       low AS (SELECT s, n, FLOOR(x) AS f, n_train, ROW_NUMBER() OVER (
               ORDER BY ROUND(x - FLOOR(x), 9) DESC, s) AS place,
               n_train - SUM(FLOOR(x)) OVER () AS short FROM share)
  SELECT s AS l_returnflag, CAST(f + CASE WHEN place <= short THEN 1 ELSE 0 END AS BIGINT) AS n_train,
         CAST(n - f - CASE WHEN place <= short THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM low""")
def f18(spark, d):
    keyed = written(with_row_key(table(spark, d, "lineitem")), "keyed")
    split = X.stratified_split(keyed, "l_returnflag", ["_rid"])
    return split.groupBy("l_returnflag").agg(F.count_if(~F.col("is_test")).alias("n_train"),
                                             F.count_if("is_test").alias("n_test"))


@query("f19_imbalance", """
  SELECT ROUND(MIN(n) * 1.0 / MAX(n), 6) AS ratio, MIN(n) * 1.0 / MAX(n) < 0.5 AS is_imbalanced
  FROM (SELECT COUNT(*) AS n FROM labels GROUP BY toxic)""")
def f19(spark, d):
    return sixes(X.imbalance(table(spark, d, "labels"), "toxic"), "ratio")


@query("f20_class_weights", """
  WITH c AS (SELECT toxic, COUNT(*) AS n FROM labels GROUP BY 1)
  SELECT doc_id, toxic, ROUND((SELECT SUM(n) FROM c) * 1.0 / ((SELECT COUNT(*) FROM c) * n), 6)
    AS weight FROM labels JOIN c USING (toxic)""")
def f20(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    weights = X.class_weights(lab, "toxic").select("toxic", "weight")
    return sixes(lab.join(weights, "toxic"), "weight")


@query("f21_base_names", """
  WITH n AS (SELECT DISTINCT p_type || '^2' AS name FROM part UNION
             SELECT DISTINCT p_type || ' ' || p_brand FROM part)
  SELECT DISTINCT SPLIT_PART(p, '^', 1) AS base
  FROM (SELECT UNNEST(STRING_SPLIT(name, ' ')) AS p FROM n)""")
def f21(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.concat("p_type", F.lit("^2")).alias("name")).union(
        part.select(F.concat_ws(" ", "p_type", "p_brand"))).distinct()
    return X.base_names_table(names)


@query("f22_align", """
  SELECT l_orderkey, l_linenumber, l_tax, 0.0 AS absent, l_quantity FROM lineitem""")
def f22(spark, d):
    return X.align(table(spark, d, "lineitem"), ["l_tax", "absent", "l_quantity"],
                   ["l_orderkey", "l_linenumber"])


@query("f23_l2_normalise", """
  WITH x AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS v FROM embeddings),
       n AS (SELECT vec_id, SQRT(SUM(v * v)) AS norm FROM x GROUP BY 1)
  SELECT vec_id, 'cosine' AS metric, ROUND(SUM(v / norm), 5) AS total,
         ROUND(MAX(v / norm), 6) AS largest FROM x JOIN n USING (vec_id) GROUP BY 1""")
def f23(spark, d):
    emb = table(spark, d, "embeddings")
    width = 64
    unit = X.l2_normalise(emb, "embedding", "u")
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.lit(X.choose_metric(width)).alias("metric"),
                       F.round(total, 5).alias("total"),
                       F.round(F.array_max("u"), 6).alias("largest"))
