"""Association between columns of mixed type, in a fixed number of scans of the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.ordered import unpivot

MATRIX = "col_i string, col_j string, method string, value double"
PAIR_AGGREGATES = 400
"""Pairs per aggregate; more are done in further passes."""

GRAM_PAIRS = 30
"""From this many pairs a table without nulls takes one Gram matrix instead of pair aggregates."""



def _finite(value):
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(
        value)


def safe_corr(a: str, b: str, complete: bool = False) -> Column:
    """Pearson over rows where both are present; null for a constant, where ``corr`` would fail."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    if not complete:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, cols: Sequence[str], complete: bool = False) -> DataFrame:
    """Pearson for every pair i<j over rows where both are present.

    All pairs go into one aggregate. For a wider table known to be without nulls the matrix comes
    from one distributed Gram matrix, whose size depends on the columns only.
    """
    spark = df.sparkSession
    pairs = list(combinations(cols, 2))
    if not pairs:
        return spark.createDataFrame([], MATRIX)
    if complete and len(pairs) > GRAM_PAIRS:
        vec = VectorAssembler(inputCols=list(cols), outputCol="v").transform(df.select(*cols))
        m = Correlation.corr(vec, "v").first()[0].toArray()
        pos = {c: i for i, c in enumerate(cols)}
        rows = [(a, b, "pearson", float(m[pos[a], pos[b]])) for a, b in pairs]
        return spark.createDataFrame(rows, MATRIX).withColumn("value", _finite(F.col("value")))
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    parts = []
    for at in range(0, len(pairs), PAIR_AGGREGATES):
        chunk = pairs[at:at + PAIR_AGGREGATES]
        wide = num.agg(*[safe_corr(a, b, complete).alias(f"p{i}") for i, (a, b) in enumerate(chunk)])
        cells = F.array(*[F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"),
                                   F.lit("pearson").alias("method"),
                                   _finite(F.col(f"p{i}")).alias("value"))
                          for i, (a, b) in enumerate(chunk)])
        parts.append(wide.select(F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Long contingency table ``(x, y, n)`` over rows where both are present."""
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"))
            .agg(F.count("*").alias("n")))


def _v_from_counts(cells: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Cramér's V per pair from ``(pair…, x, y, n)``.

    χ² = N·(Σ n²/(row·col) − 1) needs no empty cells, and every step is a grouped sum. A 2×2 table
    takes the continuity correction, whose difference from expectation is the same in all cells.
    """
    pair = list(pair)
    rows = cells.groupBy(*pair, "x").agg(F.sum("n").alias("rn"))
    cols = cells.groupBy(*pair, "y").agg(F.sum("n").alias("cn"))
    terms = cells.join(rows, [*pair, "x"]).join(cols, [*pair, "y"])
    e = lambda c: F.col(c).cast("double")
    first = terms.groupBy(*pair).agg(
        F.sum("n").cast("double").alias("N"),
        F.sum(e("n") * e("n") / (e("rn") * e("cn"))).alias("s"),
        F.count("*").alias("filled"),
        F.max(F.struct("n", "rn", "cn")).alias("cell"))
    shape = (rows.groupBy(*pair).agg(F.count("*").alias("r"), F.min("rn").alias("r0"),
                                     F.max("rn").alias("r1"))
             .join(cols.groupBy(*pair).agg(F.count("*").alias("k"), F.min("cn").alias("c0"),
                                           F.max("cn").alias("c1")), pair))
    t = first.join(shape, pair)
    expected = e("cell.rn") * e("cell.cn") / F.col("N")
    diff = F.abs(e("cell.n") - expected)
    corrected = diff - F.least(F.lit(0.5), diff)
    # Σ over the four cells of 1/expected = N³ / (r0·r1·c0·c1)
    yates = corrected * corrected * F.pow("N", 3) / (e("r0") * e("r1") * e("c0") * e("c1"))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(
        F.greatest(F.lit(0.0), F.col("N") * (F.col("s") - 1)))
    v = F.sqrt(chi2 / (F.col("N") * (F.least("k", "r") - 1 + F.lit(1e-9))))
    return t.select(*pair, _finite(v).alias("value"))


def cramers_v(df: DataFrame, cols: Sequence[str], preaggregate: bool = True) -> DataFrame:
    """Cramér's V for every pair i<j of categorical columns, from one scan.

    Counting the joint combinations first usually leaves far fewer rows than the table has; the
    pairs are then expanded from that result. Switch it off for columns with mostly unique values.
    """
    spark = df.sparkSession
    pairs = list(combinations(cols, 2))
    if not pairs:
        return spark.createDataFrame([], MATRIX)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    if preaggregate:
        joint = text.groupBy(*cols).agg(F.count("*").alias("n"))
    else:
        joint = text.withColumn("n", F.lit(1).cast("long"))
    cells = F.array(*[F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"),
                               F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    counts = (joint.select("n", F.inline(cells))
              .where(F.col("x").isNotNull() & F.col("y").isNotNull())
              .groupBy("col_i", "col_j", "x", "y").agg(F.sum("n").alias("n")))
    v = _v_from_counts(counts, ["col_i", "col_j"])
    return v.select("col_i", "col_j", F.lit("cramers_v").alias("method"), "value")


def correlation_ratio(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """η for every (category, number) pair as ``(cat, num, value)``; null is a category.

    η² = Σ n_c(ȳ_c − ȳ)² / (Σ(y − ȳ)² + 1e-9). One pass sums per category value for all numbers at
    once, a second small aggregate combines them.
    """
    spark = df.sparkSession
    if not cats or not nums:
        return spark.createDataFrame([], "cat string, num string, value double")
    d = df.select(*[F.col(c).cast("string").alias(c) for c in cats],
                  *[F.col(c).cast("double").alias(c) for c in nums])
    per = (unpivot(d, cats, nums, name="cat", value="level").groupBy("cat", "level")
           .agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"),
                           F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("ss")).alias(c)
                  for c in nums]))
    long = unpivot(per, nums, ["cat"], name="num", value="s").where(F.col("s.n") > 0).select(
        "cat", "num", "s.n", "s.m", "s.ss")
    # Combine group moments around the weighted mean of means.
    mean = long.groupBy("cat", "num").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    both = long.join(mean, ["cat", "num"])
    dev = F.col("m") - F.col("g")
    eta = both.groupBy("cat", "num").agg(
        F.sum(F.col("n") * dev * dev).alias("between"), F.sum("ss").alias("within"))
    return eta.select("cat", "num", _finite(F.sqrt(
        F.col("between") / (F.col("between") + F.col("within") + F.lit(1e-9)))).alias("value"))


def mixed_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                 complete: bool = False, preaggregate: bool = True) -> DataFrame:
    """Full association matrix in long form ``(col_i, col_j, method, value)``.

    Numbers (and booleans) pair by Pearson, categories by Cramér's V, mixed pairs by η; the
    diagonal is 1 and anything undefined is 0. Only i<j is computed, then mirrored.
    """
    cols = list(cols or df.columns)
    spark = df.sparkSession
    is_num = {f.name: isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in df.schema}
    nums = [c for c in cols if is_num[c]]
    cats = [c for c in cols if not is_num[c]]
    base = df.select(*[F.col(c).cast("double").alias(c) if is_num[c] else
                       F.col(c).cast("string").alias(c) for c in cols])
    eta = correlation_ratio(base, cats, nums).select(
        F.col("cat").alias("col_i"), F.col("num").alias("col_j"),
        F.lit("correlation_ratio").alias("method"), "value")
    upper = (pearson(base, nums, complete).unionByName(cramers_v(base, cats, preaggregate))
             .unionByName(eta))
    mirrored = upper.select(F.inline(F.array(
        F.struct("col_i", "col_j", "method", "value"),
        F.struct(F.col("col_j").alias("col_i"), F.col("col_i").alias("col_j"),
                 "method", "value"))))
    diagonal = spark.createDataFrame([(c, c, "identity", 1.0) for c in cols], MATRIX)
    return mirrored.unionByName(diagonal)


def wide_matrix(long: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column in the given order: ``(position, label, values array<double>)``."""
    pos = F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.lit(i) for i in
                                                                  range(len(cols))]))
    cells = long.select(pos[F.col("col_i")].alias("position"), F.col("col_i").alias("label"),
                        pos[F.col("col_j")].alias("j"), "value")
    return cells.groupBy("position", "label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("j", "value"))),
                    lambda s: s["value"]).alias("values"))
