"""Queries for the cleaning rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.plans.catalog import query, table

# lineitem with gaps, copies, a name to drop by each rule and an empty column
DIRTY_SQL = """
  SELECT l_linenumber AS "Unnamed: 0", l_suppkey AS user_id, l_partkey AS width,
         NULLIF(l_quantity, 13.0) AS quantity, l_discount AS discount,
         CASE WHEN l_returnflag = 'R' AND l_discount < 0.02 THEN NULL ELSE l_returnflag END AS flag,
         l_linestatus AS status, CAST(NULL AS DOUBLE) AS empty
  FROM lineitem"""


def dirty(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_linenumber").alias("Unnamed: 0"), F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("width"),
        F.when(F.col("l_quantity") == 13.0, float("nan")).otherwise(F.col("l_quantity"))
        .alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.02), None)
        .otherwise(F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("status"), F.lit(None).cast("double").alias("empty"))


@query("p1_drop_unnamed", """SELECT l_orderkey, l_quantity FROM lineitem""")
def p1(spark, d):
    return C.drop_unnamed(table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("unNamed_1"),
        F.col("l_suppkey").alias("Unnamed: 0"), "l_quantity"))


@query("p2_drop_ids", """SELECT ts, event_type, value, props FROM events""")
def p2(spark, d):
    return C.drop_ids(table(spark, d, "events"))


@query("p2_drop_ids_by_word", """SELECT ts, event_type, value, props, value AS width FROM events""")
def p2_word(spark, d):
    ev = table(spark, d, "events").withColumn("width", F.col("value"))
    return C.drop_ids(ev, match="token")


@query("p3_drop_requested", """SELECT o_orderkey, o_totalprice FROM orders""")
def p3(spark, d):
    return table(spark, d, "orders").drop(
        "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "not_there")


@query("p4_drop_empty", f"""
  WITH t AS ({DIRTY_SQL}) SELECT discount, flag, status FROM t""")
def p4(spark, d):
    return C.drop_empty(dirty(spark, d).select("discount", "flag", "status", "empty"))


@query("p5_drop_copies", """
  SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""")
def p5(spark, d):
    return table(spark, d, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus").dropDuplicates()


@query("p6_drop_null_rows", f"""
  WITH t AS ({DIRTY_SQL}) SELECT quantity, discount, flag, status FROM t
  WHERE quantity IS NOT NULL AND flag IS NOT NULL""")
def p6(spark, d):
    return C.drop_null_rows(dirty(spark, d).select("quantity", "discount", "flag", "status"))


@query("p7_row_key", """
  SELECT COUNT(*) AS n, COUNT(*) AS n_keys, COUNT(DISTINCT (l_returnflag, l_linestatus, l_tax))
         AS n_first FROM lineitem""")
def p7(spark, d):
    keyed = C.with_row_key(table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_tax"))
    return keyed.agg(F.count("*").alias("n"), F.count_distinct(C.ROW_KEY).alias("n_keys"),
                     F.count_if(F.col(C.ROW_KEY).endswith("-0")).alias("n_first"))


@query("p7_row_key_all_columns", """
  SELECT COUNT(*) AS n, COUNT(*) AS n_keys, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM t)) AS n_first
  FROM t""".replace("FROM t", """FROM (SELECT * FROM lineitem UNION ALL
    SELECT * FROM lineitem WHERE l_linenumber = 7) t"""))
def p7_all(spark, d):
    """All columns, and every row of line number 7 twice."""
    li = table(spark, d, "lineitem")
    keyed = C.with_row_key(li.unionByName(li.where("l_linenumber = 7")))
    return keyed.agg(F.count("*").alias("n"), F.count_distinct(C.ROW_KEY).alias("n_keys"),
                     F.count_if(F.col(C.ROW_KEY).endswith("-0")).alias("n_first"))


@query("p8_column_kinds", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS n, '{k}' AS kind FROM lineitem" for c, k in [
        *[(c, "numeric") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                   "l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        ("l_returnflag", "categorical"), ("l_linestatus", "categorical")]))
def p8(spark, d):
    li = table(spark, d, "lineitem")
    kinds = [(c, "numeric") for c in C.numeric_columns(li)] + [
        (c, "categorical") for c in C.categorical_columns(li)]
    kind = F.create_map(*[F.lit(x) for pair in kinds for x in pair])
    counts = li.agg(*[F.count(c).alias(c) for c, _ in kinds])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).alias("n")) for c, _ in kinds]))).withColumn(
        "kind", kind[F.col("column")])


@query("p9_cardinality", """
  WITH u AS (
    SELECT 'p_name' AS "column", COUNT(DISTINCT p_name) AS n_distinct FROM part UNION ALL
    SELECT 'p_brand', COUNT(DISTINCT p_brand) FROM part UNION ALL
    SELECT 'p_type', COUNT(DISTINCT p_type) FROM part)
  SELECT "column", n_distinct, CASE WHEN n_distinct > 50 THEN 'high' ELSE 'low' END AS kind
  FROM u""")
def p9(spark, d):
    part = table(spark, d, "part")
    low, _ = C.split_by_cardinality(part)
    return C.distinct_counts(part, C.categorical_columns(part)).withColumn(
        "kind", F.when(F.col("column").isin(low), "low").otherwise("high"))


@query("p10_report", f"""
  WITH t AS ({DIRTY_SQL}),
       kept AS (SELECT DISTINCT quantity, discount, flag, status FROM t),
       full_rows AS (SELECT * FROM kept WHERE quantity IS NOT NULL AND flag IS NOT NULL)
  SELECT CAST(4 AS BIGINT) AS cols_deleted_n,
         'Unnamed: 0,empty,user_id,width' AS cols_deleted,
         (SELECT COUNT(*) FROM t) - (SELECT COUNT(*) FROM full_rows) AS rows_deleted_n,
         '' AS high_cardinality_cols, 'flag,status' AS low_cardinality_cols,
         2 + (SELECT COUNT(DISTINCT flag) + COUNT(DISTINCT status) FROM full_rows)
           AS final_features_n""")
def p10(spark, d):
    report = C.cleaning_report(C.clean(dirty(spark, d)))
    lists = ["cols_deleted", "high_cardinality_cols", "low_cardinality_cols"]
    return report.withColumns({c: F.concat_ws(",", c) for c in lists})


@query("p11_features_and_target", """
  SELECT ROUND(AVG(l_tax), 12) AS mean_target, COUNT(*) AS n FROM lineitem""")
def p11(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    features, target = C.separate(li, "l_tax", "regression")
    assert features.columns == ["l_quantity", "l_discount"]
    return li.agg(F.round(F.avg(target), 12).alias("mean_target"), F.count("*").alias("n"))
