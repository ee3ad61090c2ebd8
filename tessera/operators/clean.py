"""Cleaning: column rules, duplicates, nulls, row keys and the cleaning report."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.config import (HASH_SLOTS, LOW_CARDINALITY_MAX, SVD_COMPONENTS, WIDE_LIMIT,
                            WIDE_LIMIT_CLUSTERING)
from tessera.functions.ordered import unpivot
from tessera.session import written

ROW_KEY = "_rid"
COPIES_PER_TASK = 100_000
BROADCAST_ROWS = 200_000


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "unnamed" in c.lower()])


def _is_id(name: str, match: str) -> bool:
    if match == "substring":
        return "id" in name.lower()
    words = re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name))
    return "id" in [w.lower() for w in words]


def drop_ids(df: DataFrame, match: str = "substring", keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns named like an identifier.

    ``substring`` drops any name containing "id"; ``token`` only names with "id" as a word.
    ``keep`` exempts columns such as the target.
    """
    if match not in ("substring", "token"):
        raise ValueError("match must be 'substring' or 'token'")
    keep = set(keep)
    return df.drop(*[c for c in df.columns if c not in keep and _is_id(c, match)])


def present(df: DataFrame, name: str) -> Column:
    """Not null, and not NaN for floating columns."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns without a single value: one aggregate over all columns."""
    if not df.columns:
        return df
    row = df.agg(*[F.bool_or(present(df, c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if not row[c]])


def drop_null_rows(df: DataFrame) -> DataFrame:
    if not df.columns:
        return df
    return df.where(reduce(lambda a, b: a & b, [present(df, c) for c in df.columns]))


def with_row_key(df: DataFrame, distinct: bool = False, name: str = ROW_KEY) -> DataFrame:
    """Add a key that depends only on the row's values: 128 hash bits and a copy number.

    First the hashes that occur twice are counted, 16 bytes a row. Where their table is small
    enough to broadcast, all other rows get their key where they lie, and only rows with copies are
    shuffled whole; else all are. Copies are counted (which combines before the shuffle) and expanded
    again in chunks spread over tasks, so a row that makes up a large part of the table is never
    numbered in one task. The rows are read four times: pass a table. ``distinct`` says that the
    rows have no copies and saves the counts.
    """
    cells = [F.col(f"`{c}`") for c in df.columns]
    halves = F.xxhash64(F.lit(11), *cells), F.xxhash64(F.lit(29), *cells)
    hashes = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves])
    first = df.withColumn(name, F.concat(hashes, F.lit("-0")))
    if distinct:
        return first
    repeated = written(df.select(halves[0].alias("_a"), halves[1].alias("_b")).groupBy("_a", "_b")
                       .agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated")
    if repeated.count() > BROADCAST_ROWS:
        return _numbered(df, hashes, name)
    held = F.broadcast(repeated)
    same = (halves[0] == F.col("_a")) & (halves[1] == F.col("_b"))
    return first.join(held, same, "left_anti").unionByName(
        _numbered(df.join(held, same, "left_semi"), hashes, name))


def _numbered(df: DataFrame, hashes: Column, name: str) -> DataFrame:
    """Equal rows counted and numbered.

    The chunks are few and small, the rows made of them are not: the number of tasks comes from the
    rows and is given, as Spark would merge tasks by the size of the chunks.
    """
    step = F.lit(COPIES_PER_TASK)
    tasks = 1 + df.count() // (10 * COPIES_PER_TASK)
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_m"))
    chunked = counted.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, step.cast("long"))))
    spread = chunked.repartition(tasks)
    copies = spread.withColumn("_i", F.explode(F.sequence(
        F.col("_chunk"), F.least(F.col("_m"), F.col("_chunk") + step) - 1)))
    return copies.select(*df.columns, F.concat_ws("-", hashes, F.col("_i")).alias(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def split_by_cardinality(df: DataFrame, cols: Sequence[str] | None = None,
                         limit: int = LOW_CARDINALITY_MAX) -> tuple[list[str], list[str]]:
    """``(low, high)``: columns with at most / more than ``limit`` distinct values.

    A sketch settles the columns that are far above the limit; only the rest are counted exactly,
    and those have so few values that the count combines almost fully before the shuffle.
    """
    cols = categorical_columns(df) if cols is None else list(cols)
    if not cols:
        return [], []
    est = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    near = [c for c in cols if est[c] <= 2 * limit]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first() if near else {}
    low = [c for c in near if exact[c] <= limit]
    return low, [c for c in cols if c not in low]


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts as ``(column, n_distinct)``."""
    return (unpivot(df, cols, cast="string").where(F.col("value").isNotNull()).distinct()
            .groupBy("column").agg(F.count("*").alias("n_distinct")))


def separate(df: DataFrame, target: str | None, task: str) -> tuple[DataFrame, Column | None]:
    """Feature columns and the target column; the target is optional only for clustering."""
    if task == "clustering":
        return df, None
    if target is None:
        raise ValueError("target is required")
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column")
    return df.drop(target), F.col(target)


@dataclass
class Cleaned:
    df: DataFrame
    raw: DataFrame
    low: list[str] = field(default_factory=list)
    high: list[str] = field(default_factory=list)

    @property
    def numeric(self) -> list[str]:
        return numeric_columns(self.df)

    @property
    def deleted(self) -> list[str]:
        return sorted(set(self.raw.columns) - set(self.df.columns))


def clean(df: DataFrame, task: str = "classification", drop: Sequence[str] = (),
          target: str | None = None, id_match: str = "substring", snapshot: bool = False) -> Cleaned:
    """Apply the cleaning rules.

    Rows with nulls go before copies are removed: the result is the same, and the filter reaches
    the scan instead of running behind the shuffle. With ``snapshot`` the cleaned table is written
    once and everything later reads that, so the shuffle is not repeated per statistic.
    """
    keep = [target] if target else []
    out = drop_ids(drop_unnamed(df), id_match, keep).drop(*[c for c in drop if c != target])
    out = drop_null_rows(drop_empty(out))
    if task != "clustering":
        out = out.dropDuplicates()
    if snapshot:
        out = written(out, "clean")
    low, high = split_by_cardinality(out)
    return Cleaned(out, df, low, high)


def cleaning_report(cleaned: Cleaned, task: str = "classification") -> DataFrame:
    """One row: what was removed, the cardinality lists and the width of the feature matrix."""
    df, raw = cleaned.df, cleaned.raw
    spark = df.sparkSession
    n_raw = raw.agg(F.count("*").alias("n_raw"))
    n_out = df.agg(F.count("*").alias("n_out"))

    width = len(cleaned.numeric) + (HASH_SLOTS if cleaned.high else 0)
    if cleaned.low:
        cats = (unpivot(df, cleaned.low, cast="string").distinct()
                .agg((F.count("*") + F.lit(width)).alias("w")))
    else:
        cats = spark.range(1).select(F.lit(width).cast("long").alias("w"))
    limit = WIDE_LIMIT_CLUSTERING if task == "clustering" else WIDE_LIMIT
    final = F.when(F.col("w") > limit, F.least(F.lit(SVD_COMPONENTS), F.col("w") - 1,
                                               F.greatest(F.col("n_out") - 1, F.lit(1)))
                   ).otherwise(F.col("w"))
    # Three one-row aggregates brought into one row.
    parts = n_raw.unionByName(n_out, True).unionByName(cats, True)
    joined = parts.agg(*[F.max(c).alias(c) for c in ("n_raw", "n_out", "w")])

    def names(values: list[str]) -> Column:
        return (F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"))

    return joined.select(
        F.lit(len(raw.columns) - len(df.columns)).cast("long").alias("cols_deleted_n"),
        names(cleaned.deleted).alias("cols_deleted"),
        (F.col("n_raw") - F.col("n_out")).alias("rows_deleted_n"),
        names(cleaned.high).alias("high_cardinality_cols"),
        names(cleaned.low).alias("low_cardinality_cols"),
        final.cast("long").alias("final_features_n"))
