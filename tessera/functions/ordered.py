"""Order statistics that never bring a whole column into one task.

Each helper takes one pass for bounded statistics (counts, approximate cut points), then uses the
cut points to spread the exact work over many tasks. The answer does not depend on how good the
cut points are; only the balance of the tasks does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessera.session import written

SMALL_ROWS = 1_000_000
"""Tables up to this many rows may be ordered in one task."""

PERCENTILE_VALUES = 1_000_000
"""Most distinct values one exact ``percentile`` buffer may hold."""


def unpivot(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), cast: str | None = None,
            name: str = "column", value: str = "value") -> DataFrame:
    """``(by…, column, value)`` rows for the given columns in one scan."""
    def val(c: str) -> Column:
        return F.col(c).cast(cast) if cast else F.col(c)

    cells = F.array(*[F.struct(F.lit(c).alias(name), val(c).alias(value)) for c in cols])
    return df.select(*by, F.inline(cells))


def _cuts(df: DataFrame, order: str, buckets: int) -> tuple[int, list]:
    fractions = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.count(order).alias("n"),
                 F.percentile_approx(order, fractions, 1000).alias("cuts")).first()
    return row["n"], sorted(set(row["cuts"] or []))


def with_prefix_sums(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (),
                     buckets: int = 128) -> DataFrame:
    """Add, for each ``new: value`` of ``sums``, the sum of ``value`` over rows ordered before.

    ``order`` must be unique within ``by`` and not null. A numeric order column is cut into value
    ranges; any other type is range-partitioned and written, so that the ranges stay fixed. Sums
    inside a range use a window per range and the ranges before it add one offset.
    """
    by = list(by)
    if isinstance(df.schema[order].dataType, T.NumericType):
        n, cuts = _cuts(df, order, buckets)
        if n <= SMALL_ROWS:
            cuts = []
        else:
            df = written(df, "ordered")  # read by the windows and by the range totals
        # Binary search as a nested condition: log2(buckets) comparisons a row.
        def locate(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col(order) <= F.lit(cuts[mid]), locate(lo, mid)).otherwise(
                locate(mid + 1, hi))
        ranged = df.withColumn("_range", locate(0, len(cuts)))
        many = bool(cuts)
    else:
        many = df.count() > SMALL_ROWS
        if many:
            ranged = written(df.repartitionByRange(buckets, order)
                             .withColumn("_range", F.spark_partition_id()), "ranged")
        else:
            ranged = df.withColumn("_range", F.lit(0))
    inside = (W.partitionBy(*by, "_range").orderBy(order)
              .rowsBetween(W.unboundedPreceding, -1))
    out = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k)
                               for k, v in sums.items()])
    if not many:
        return out.drop("_range")
    # One row per (by, range): ordering these is bounded by the number of ranges.
    before = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*by, "_range")
               .agg(*[F.sum(v).alias(f"_o_{k}") for k, v in sums.items()])
               .select(*by, "_range", *[F.coalesce(F.sum(f"_o_{k}").over(before), F.lit(0))
                                        .alias(f"_o_{k}") for k in sums]))
    joined = out.join(offsets, [*by, "_range"])
    return joined.select(*df.columns, *[(F.col(k) + F.col(f"_o_{k}")).alias(k) for k in sums])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), limit: int = PERCENTILE_VALUES,
                    rows: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles as ``(by…, column, quantiles array<double>)``.

    ``percentile`` keeps every distinct value of a group in one buffer, so it is used only where
    that count is at most ``limit``. Larger groups are narrowed first: approximate quantiles give a
    bracket around each wanted rank, a counting pass proves that the rank lies in it, and brackets
    are narrowed again until the values inside fit. ``by`` must have few groups; ``rows`` is the
    row count where the caller knows it.
    """
    by, probs = list(by), [float(p) for p in probs]
    keys = [*by, "column"]
    long = unpivot(df, cols, by, cast="double").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    big = []
    if (df.count() if rows is None else rows) > limit:
        sizes = long.groupBy(*keys).agg(F.count("*").alias("n"),
                                        F.approx_count_distinct("value", 0.02).alias("d"))
        big = sizes.where((F.col("n") > limit) & (F.col("d") > 0.9 * limit)).collect()
    direct = long.groupBy(*keys).agg(
        F.percentile("value", F.array(*map(F.lit, probs))).alias("quantiles"))
    if not big:
        return direct
    spark = df.sparkSession
    key_schema = T.StructType([long.schema[k] for k in keys])
    big_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in big], key_schema)
    small_part = long.join(F.broadcast(big_keys), keys, "left_anti").groupBy(*keys).agg(
        F.percentile("value", F.array(*map(F.lit, probs))).alias("quantiles"))
    big_long = long.join(F.broadcast(big_keys), keys, "left_semi")
    found = {tuple(r[k] for k in keys): _narrow(big_long, keys, r, probs, limit) for r in big}
    schema = T.StructType([*key_schema.fields,
                           T.StructField("quantiles", T.ArrayType(T.DoubleType()))])
    big_part = spark.createDataFrame([(*k, v) for k, v in found.items()], schema)
    return small_part.unionByName(big_part)


def _narrow(long: DataFrame, keys: list[str], group, probs: list[float], limit: int) -> list[float]:
    """Quantiles of one large group by repeated bracketing."""
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(group[k])) for k in keys])
    values = long.where(cond).select("value")
    n = group["n"]
    ranks = sorted({r for p in probs for r in (int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1))})
    brackets = {r: (float("-inf"), float("inf"), 0, n) for r in ranks}  # lo, hi, below, inside
    known: dict[int, float] = {}
    eps = 0.0005
    while brackets:
        asks = []
        for r, (lo, hi, below, inside) in brackets.items():
            q = (r - below) / max(1, inside - 1)
            v = F.when(F.col("value").between(lo, hi), F.col("value"))
            if inside <= limit:
                asks.append(F.array(F.percentile(v, q)).alias(f"r{r}"))
            else:
                asks.append(F.percentile_approx(
                    v, [max(0.0, q - eps), min(1.0, q + eps)], 10000).alias(f"r{r}"))
        got = values.agg(*asks).first()
        narrowed = {}
        for r, (lo, hi, below, inside) in brackets.items():
            ans = got[f"r{r}"]
            if inside <= limit or ans[0] == ans[-1]:
                known[r] = ans[0]
            else:
                narrowed[r] = (ans[0], ans[-1])
        # Equal ends are proved by the same count as real brackets.
        checks = {**narrowed, **{r: (known[r], known[r]) for r in brackets
                                 if r in known and brackets[r][3] > limit}}
        if not checks:
            break
        counts = values.agg(*[c for r, (lo, hi) in checks.items() for c in (
            F.count_if(F.col("value") < lo).alias(f"b{r}"),
            F.count_if(F.col("value").between(lo, hi)).alias(f"i{r}"))]).first()
        nxt = {}
        for r, (lo, hi) in checks.items():
            b, i = counts[f"b{r}"], counts[f"i{r}"]
            if b <= r < b + i:
                if lo == hi:
                    known[r] = lo
                else:
                    nxt[r] = (lo, hi, b, i)
            else:  # the approximate bracket missed: keep the old one and widen the next
                known.pop(r, None)
                nxt[r] = brackets[r]
                eps *= 4
        brackets = nxt
    out = []
    for p in probs:
        h = (n - 1) * p
        lo, hi = known[int(h)], known[min(n - 1, int(h) + 1)]
        out.append(lo + (hi - lo) * (h - int(h)))
    return out


def quantile_dict(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """``exact_quantiles`` without groups, on the driver: columns × probs numbers."""
    return {r["column"]: r["quantiles"] for r in exact_quantiles(df, cols, probs).collect()}


def most_frequent(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                  cast: str | None = None) -> DataFrame:
    """Most frequent value per ``(by…, column)``; ties go to the smallest value.

    Counting per value combines before the shuffle, so a hot value costs no more than a rare one.
    """
    by = list(by)
    counts = (unpivot(df, cols, by, cast).where(F.col("value").isNotNull())
              .groupBy(*by, "column", "value").count())
    return counts.groupBy(*by, "column").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"))


def _hashed(df: DataFrame, key: Sequence[str], seed: int, bits: int) -> DataFrame:
    """Add ``_h``, a seeded hash of the key, and ``_p``, its leading bits."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    return df.withColumn("_h", h).withColumn(
        "_p", F.shiftrightunsigned(F.col("_h"), 64 - bits).cast("int"))


def hash_histogram(df: DataFrame, stratum: str, key: Sequence[str], seed: int, bits: int = 12
                   ) -> DataFrame:
    """``(stratum, _p, n)``: rows per stratum and hash prefix, at most 2**bits rows a stratum."""
    return _hashed(df, key, seed, bits).groupBy(stratum, "_p").agg(F.count("*").alias("n"))


def split_by_hash(df: DataFrame, stratum: str, key: Sequence[str], takes: DataFrame, seed: int,
                  histogram: DataFrame, flag: str = "selected", bits: int = 12,
                  few_strata: bool = False) -> DataFrame:
    """Flag exactly ``take`` rows of each stratum, in the order of a seeded hash of ``key``.

    ``takes`` has ``(stratum, take)``. The histogram over hash prefixes finds the prefix where the
    quota ends; only rows with that prefix (about 1 in 2**bits of a stratum) are ordered to find
    the cut, and the flag itself is a map-side comparison. No stratum is ever sorted whole.
    ``few_strata`` is for callers that have checked that one row per stratum may be broadcast.
    """
    small = F.broadcast if few_strata else (lambda d: d)
    k = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key])
    hashed = _hashed(df, key, seed, bits)
    upto = F.sum("n").over(W.partitionBy(stratum).orderBy("_p"))
    edge = (histogram.withColumn("upto", upto).join(small(takes), stratum)
            .where((F.col("upto") - F.col("n") < F.col("take")) & (F.col("upto") >= F.col("take")))
            .select(stratum, F.col("_p").alias("_edge"),
                    (F.col("take") - F.col("upto") + F.col("n")).alias("_left")))
    near = (hashed.withColumn("_k", k).select(stratum, "_p", "_h", "_k")
            .join(small(edge), stratum).where(F.col("_p") == F.col("_edge"))
            .withColumn("_rn", F.row_number().over(
                W.partitionBy(stratum).orderBy("_h", "_k"))))
    cut = near.where(F.col("_rn") == F.col("_left")).select(
        stratum, "_edge", F.col("_h").alias("_hc"), F.col("_k").alias("_kc"))
    joined = hashed.withColumn("_k", k).join(small(cut), stratum, "left")
    chosen = ((F.col("_p") < F.col("_edge"))
              | ((F.col("_p") == F.col("_edge"))
                 & ((F.col("_h") < F.col("_hc"))
                    | ((F.col("_h") == F.col("_hc")) & (F.col("_k") <= F.col("_kc"))))))
    return joined.select(*df.columns, F.coalesce(chosen, F.lit(False)).alias(flag))
