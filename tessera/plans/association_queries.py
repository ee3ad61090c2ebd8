"""Queries for the association statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assoc as A
from tessera.operators.clean import clean
from tessera.operators.features import category_map, encode_ordinal
from tessera.plans.catalog import query, table

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATS = ["l_returnflag", "l_linestatus", "l_shipmonth"]


def lineitem(spark, d):
    return table(spark, d, "lineitem").select(
        *NUMS, "l_returnflag", "l_linestatus",
        F.date_format("l_shipdate", "MM").alias("l_shipmonth"))


BASE = """li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
                 strftime(l_shipdate, '%m') AS l_shipmonth FROM lineitem)"""


def _pearson(src, cols):
    parts = [f"SELECT '{a}' AS col_i, '{b}' AS col_j, 'pearson' AS method, "
             f"ROUND(CORR({a}, {b}), 6) AS value FROM {src}"
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " UNION ALL ".join(parts)


def _chi(a, b, src="li"):
    return f"""SELECT '{a}' AS col_i, '{b}' AS col_j,
      CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END / 1.0 AS chi2, tot, r, k FROM (
      SELECT SUM((COALESCE(o.n, 0) - e) * (COALESCE(o.n, 0) - e) / e) AS plain,
             SUM(POWER(ABS(COALESCE(o.n, 0) - e) - LEAST(0.5, ABS(COALESCE(o.n, 0) - e)), 2) / e)
               AS yates,
             MAX(tot) AS tot, COUNT(DISTINCT g.x) AS r, COUNT(DISTINCT g.y) AS k
      FROM (SELECT x, y, rn * cn * 1.0 / tot AS e, tot
            FROM (SELECT {a} AS x, COUNT(*) AS rn FROM {src} GROUP BY 1) rr,
                 (SELECT {b} AS y, COUNT(*) AS cn FROM {src} GROUP BY 1) cc,
                 (SELECT COUNT(*) AS tot FROM {src}) tt) g
      LEFT JOIN (SELECT {a} AS x, {b} AS y, COUNT(*) AS n FROM {src} GROUP BY 1, 2) o
        ON g.x = o.x AND g.y = o.y)"""


def _cramer(cols, src="li"):
    parts = [_chi(a, b, src) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return (f"SELECT col_i, col_j, 'cramers_v' AS method, "
            f"ROUND(SQRT(chi2 / (tot * (LEAST(k, r) - 1 + 1e-9))), 6) AS value "
            f"FROM ({' UNION ALL '.join(parts)})")


def _eta(cats, nums, src="li"):
    parts = [f"""SELECT '{c}' AS cat, '{y}' AS num, ROUND(SQRT(
        (SELECT SUM(n * (m - g) * (m - g)) FROM
           (SELECT COUNT(*) AS n, AVG({y}) AS m FROM {src} GROUP BY {c}) a,
           (SELECT AVG({y}) AS g FROM {src}) b)
        / ((SELECT VAR_POP({y}) * COUNT(*) FROM {src}) + 1e-9)), 6) AS value"""
             for c in cats for y in nums]
    return " UNION ALL ".join(parts)


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


def _full(upper, cols):
    return (f"SELECT * FROM ({upper}) UNION ALL SELECT col_j, col_i, method, value FROM ({upper}) "
            "UNION ALL " + " UNION ALL ".join(
                f"SELECT '{c}', '{c}', 'identity', 1.0" for c in cols))


@query("c1_pearson", f"WITH {BASE} {_pearson('li', NUMS)}")
def c1(spark, d):
    return _rounded(A.pearson(lineitem(spark, d), NUMS))


@query("c1_pearson_with_nulls", """
  SELECT 'a' AS col_i, 'l_quantity' AS col_j, 'pearson' AS method,
         ROUND(CORR(NULLIF(l_discount, 0), l_quantity), 6) AS value FROM lineitem""")
def c1_nulls(spark, d):
    li = table(spark, d, "lineitem").select(
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("a"), "l_quantity")
    return _rounded(A.pearson(li, ["a", "l_quantity"]))


@query("c2_contingency", """
  SELECT l_returnflag AS x, l_linestatus AS y, COUNT(*) AS n FROM lineitem GROUP BY 1, 2""")
def c2(spark, d):
    return A.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("c3_cramers_v", f"WITH {BASE} {_cramer(CATS)}")
def c3(spark, d):
    return _rounded(A.cramers_v(lineitem(spark, d), CATS))


@query("c3_cramers_v_2x2", f"""
  WITH li AS (SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size
              FROM lineitem) {_cramer(['l_linestatus', 'size'])}""")
def c3_two(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", F.when(
        F.col("l_quantity") > 25, "big").otherwise("small").alias("size"))
    return _rounded(A.cramers_v(li, ["l_linestatus", "size"]))


@query("c4_correlation_ratio", f"WITH {BASE} {_eta(CATS, NUMS)}")
def c4(spark, d):
    return _rounded(A.correlation_ratio(lineitem(spark, d), CATS, NUMS))


@query("c5_mixed_matrix", f"WITH {BASE}, up AS ({_pearson('li', NUMS)} UNION ALL {_cramer(CATS)} "
       f"UNION ALL SELECT cat, num, 'correlation_ratio', value FROM ({_eta(CATS, NUMS)})) "
       + _full("SELECT * FROM up", NUMS + CATS))
def c5(spark, d):
    return _rounded(A.mixed_matrix(lineitem(spark, d)))


ENC = """raw AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem),
  f AS (SELECT l_returnflag AS v, DENSE_RANK() OVER (ORDER BY l_returnflag) - 1 AS c
        FROM (SELECT DISTINCT l_returnflag FROM raw)),
  s AS (SELECT l_linestatus AS v, DENSE_RANK() OVER (ORDER BY l_linestatus) - 1 AS c
        FROM (SELECT DISTINCT l_linestatus FROM raw)),
  enc AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
          l_discount, l_tax, f.c AS l_returnflag, s.c AS l_linestatus
          FROM raw JOIN f ON raw.l_returnflag = f.v JOIN s ON raw.l_linestatus = s.v)"""
ENC_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("c5_mixed_matrix_encoded", f"WITH {ENC}, up AS ({_pearson('enc', ENC_COLS)}) "
       + _full("SELECT * FROM up", ENC_COLS))
def c5_encoded(spark, d):
    """The flagship: clean the whole table, encode its categories, associate all columns."""
    cleaned = clean(table(spark, d, "lineitem").drop("l_shipdate"), snapshot=True)
    cats = cleaned.low + cleaned.high
    codes = category_map(cleaned.df, cats, few=cleaned.low)
    return _rounded(A.mixed_matrix(encode_ordinal(cleaned.df, cats, codes), complete=True))


@query("c5_wide_matrix")
def c5_wide(spark, d):
    li = lineitem(spark, d)
    return A.wide_matrix(A.mixed_matrix(li), li.columns)
