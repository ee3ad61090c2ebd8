"""Feature preparation: imputation, scaling, encodings, selection statistics and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessera.config import HASH_SLOTS
from tessera.functions.ordered import (SMALL_ROWS, exact_quantiles, hash_histogram, most_frequent,
                                       quantile_dict, split_by_hash, unpivot, with_prefix_sums)
from tessera.operators.assoc import safe_corr
from tessera.session import written

BROADCAST_ROWS = 200_000
"""Largest encoding map sent to every executor; larger maps are joined by shuffle."""

LITERAL_VALUES = 200
"""Columns of at most this many values are encoded by a map literal, without a join."""

MISSING = "missing"


# ---------------------------------------------------------------- imputation and scaling

def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    medians = quantile_dict(df, cols, [0.5])
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)),
                                         F.lit(medians[c][0])) for c in cols if c in medians})


def impute_most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    modes = {r["column"]: r["value"] for r in most_frequent(df, cols).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in cols if c in modes})


@dataclass
class Scaling:
    """Per-column ``(x − centre) / scale``; columns without statistics pass through."""

    centre: dict[str, float]
    scale: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(self.centre[c])) / F.lit(self.scale[c])
            for c in self.centre if c in df.columns})


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Median and interquartile range, exact; a zero range divides by 1."""
    q = quantile_dict(df, cols, [0.25, 0.5, 0.75])
    return Scaling({c: v[1] for c, v in q.items()},
                   {c: (v[2] - v[0]) or 1.0 for c, v in q.items()})


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Mean and population standard deviation in one pass; zero deviation divides by 1."""
    if not cols:
        return Scaling({}, {})
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return Scaling({c: row[f"m_{c}"] or 0.0 for c in cols},
                   {c: row[f"s_{c}"] or 1.0 for c in cols})


def l2_normalise(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Row of unit length; a zero row stays zero. Works on an array column."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return df.withColumn(out, F.transform(vec, lambda x: x.cast("double") / F.when(
        norm == 0, 1.0).otherwise(norm)))


def choose_metric(width: int, sparse: bool = False) -> str:
    return "cosine" if sparse or width > 50 else "euclidean"


# ---------------------------------------------------------------- categorical encodings

def category_map(df: DataFrame, cols: Sequence[str], missing: str | None = MISSING,
                 few: Sequence[str] = ()) -> DataFrame:
    """``(column, value, code)``: codes 0.. in sorted order of the text, per column.

    Distinct values combine before the shuffle. Columns with many values are ranked in ranges;
    ``few`` names columns already known to have few, whose size is then not looked up.
    """
    text = df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit(missing)) if missing is not None
                        else F.col(c).cast("string")).alias(c) for c in cols])
    values = unpivot(text, cols).where(F.col("value").isNotNull()).distinct()
    unsure = [c for c in cols if c not in set(few)]
    est = text.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in unsure]).first(
        ) if unsure else {}
    sizes = {c: est[c] for c in unsure}
    wide = [c for c in cols if sizes.get(c, 0) > SMALL_ROWS]
    ranked = values.where(~F.col("column").isin(wide)) if wide else values
    w = W.partitionBy("column").orderBy("value")
    out = ranked.withColumn("code", F.row_number().over(w) - 1)
    for c in wide:
        one = values.where(F.col("column") == c).withColumn("_one", F.lit(1).cast("long"))
        out = out.unionByName(with_prefix_sums(one, "value", {"code": "_one"}).select(
            "column", "value", F.col("code").cast("int").alias("code")))
    return out


def category_map_export(codes: DataFrame) -> DataFrame:
    """One row per column with its map; meant for columns of few values."""
    return codes.groupBy("column").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("value", "code")))).alias("mapping"))


def encode_ordinal(df: DataFrame, cols: Sequence[str], codes: DataFrame,
                   keep_text: bool = False) -> DataFrame:
    """Replace text by its code as a double: null reads as "missing", unknown becomes −1.

    Small maps become literals or broadcast tables, so the table is not shuffled at all; a map
    above the size limit is joined by value.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    mine = codes.where(F.col("column").isin(cols)).select("column", "value", "code")
    rows = mine.limit(BROADCAST_ROWS + 1).collect()
    known: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        known[r["column"]].append((r["value"], r["code"]))
    fits = len(rows) <= BROADCAST_ROWS
    out = df
    for c in cols:
        name = f"{c}_code" if keep_text else c
        text = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        if fits and len(known[c]) <= LITERAL_VALUES:
            cells = [F.lit(x) for pair in known[c] for x in pair]
            code = F.create_map(*cells)[text] if cells else F.lit(None)
            out = out.withColumn(name, F.coalesce(code, F.lit(-1)).cast("double"))
            continue
        one = (df.sparkSession.createDataFrame(known[c], "_v string, _c int") if fits else
               mine.where(F.col("column") == c).select(F.col("value").alias("_v"),
                                                       F.col("code").alias("_c")))
        out = (out.withColumn("_v", text).join(F.broadcast(one) if fits else one, "_v", "left")
               .withColumn(name, F.coalesce("_c", F.lit(-1)).cast("double")).drop("_v", "_c"))
    return out.select(*df.columns, *[f"{c}_code" for c in cols if keep_text])


def one_hot(df: DataFrame, cols: Sequence[str], codes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add 0/1 columns ``<column>=<value>``; an unseen value is all zeros.

    ``codes`` must hold columns of few values (at most the low-cardinality limit each).
    """
    known = codes.where(F.col("column").isin(list(cols))).orderBy("column", "code").collect()
    by = {c: [r["value"] for r in known if r["column"] == c] for c in cols}
    names = [(c, v, f"{c}={v}") for c in cols for v in by[c]]
    out = df.select("*", *[F.when(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == v, 1)
                           .otherwise(0).alias(n) for c, v, n in names])
    return out, [n for _, _, n in names]


def hash_slots(df: DataFrame, cols: Sequence[str], out: str = "hashed", slots: int = HASH_SLOTS,
               signed: bool = True) -> DataFrame:
    """Hash the text of ``cols`` into ``slots`` counts. Tokens are values only, so equal values of
    different columns share a slot; with ``signed`` a hash bit gives each token its sign."""
    tokens = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])

    def counted(d: DataFrame, keep: Column, name: str) -> DataFrame:
        return HashingTF(numFeatures=slots, inputCol=f"_t{name}", outputCol=name).transform(
            d.withColumn(f"_t{name}", keep))

    if not signed:
        vec = vector_to_array("_up")
        return counted(df, tokens, "_up").withColumn(out, vec).select(*df.columns, out)
    up = F.filter(tokens, lambda t: F.xxhash64(t) >= 0)
    down = F.filter(tokens, lambda t: F.xxhash64(t) < 0)
    both = counted(counted(df, up, "_up"), down, "_down")
    return both.withColumn(out, F.zip_with(vector_to_array("_up"), vector_to_array("_down"),
                                           lambda a, b: a - b)).select(*df.columns, out)


def target_codes(df: DataFrame, target: str) -> DataFrame:
    """``(value, label)``: labels 0.. in the order of the column's own type."""
    values = df.where(F.col(target).isNotNull()).select(F.col(target).alias("value")).distinct()
    return with_prefix_sums(values.withColumn("_one", F.lit(1).cast("long")), "value",
                            {"label": "_one"}).select("value", F.col("label").cast("int")
                                                      .alias("label"))


def encode_target(df: DataFrame, target: str, codes: DataFrame, out: str = "label") -> DataFrame:
    return df.join(codes.withColumnsRenamed({"value": target, "label": out}), target)


def decode_target(df: DataFrame, codes: DataFrame, prediction: str = "prediction",
                  out: str = "predicted") -> DataFrame:
    return df.join(codes.select(F.col("label").cast("double").alias(prediction),
                                F.col("value").alias(out)), prediction, "left")


def to_number(col: Column | str, fill: float | None = None) -> Column:
    """Text or number to double; what does not parse is null, or ``fill``."""
    col = F.col(col) if isinstance(col, str) else col
    number = F.nanvl(col.cast("string").try_cast("double"), F.lit(None).cast("double"))
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))


# ---------------------------------------------------------------- widths, polynomials, SVD

def polynomial_names(cols: Sequence[str]) -> list[tuple[str, str | None, str]]:
    """``(a, b, name)`` for degrees 1 and 2 without bias: a, then a^2 and a b in column order."""
    terms: list[tuple[str, str | None, str]] = [(c, None, c) for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            terms.append((a, b, f"{a}^2" if a == b else f"{a} {b}"))
    return terms


def polynomial(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    terms = polynomial_names(cols)
    return df.select(*keep, *[(F.col(a).cast("double") if b is None else
                               F.col(a).cast("double") * F.col(b)).alias(n) for a, b, n in terms])


def base_names(features: Sequence[str]) -> list[str]:
    """Column names behind polynomial names, in order of first use."""
    seen: dict[str, None] = {}
    for f in features:
        for part in f.split():
            seen.setdefault(part.split("^")[0])
    return list(seen)


def base_names_table(names: DataFrame, col: str = "name") -> DataFrame:
    """The same for names held in a table."""
    part = F.explode(F.split(col, r"\s+"))
    return names.select(part.alias("p")).select(
        F.split_part("p", F.lit("^"), F.lit(1)).alias("base")).distinct()


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features, in its order; absent columns read as 0."""
    return df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) if c in df.columns
                              else F.lit(0.0).alias(c) for c in features])


@dataclass
class Projection:
    """Linear map of a vector column: ``(x − centre) · matrix`` in Arrow batches."""

    matrix: np.ndarray
    centre: np.ndarray | None = None
    values: list[float] = field(default_factory=list)

    def apply(self, df: DataFrame, vec: str, out: str) -> DataFrame:
        m, c = self.matrix, self.centre

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy()).astype(float)
            return pd.Series(list((x - c if c is not None else x) @ m))

        return df.withColumn(out, project(F.col(vec)))


def gram_matrix(df: DataFrame, vec: str) -> np.ndarray:
    """XᵀX of an array column: each task sums its own rows, then the cells are summed.

    The result has width² numbers, whatever the number of rows.
    """
    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(float)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = (df.select(vec).mapInPandas(partial, "i int, j int, v double")
             .groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas())
    d = int(cells["j"].max()) + 1
    g = np.zeros((d, d))
    g[cells["i"], cells["j"]] = cells["v"]
    g[cells["j"], cells["i"]] = cells["v"]
    return g


def fit_svd(df: DataFrame, vec: str, k: int) -> Projection:
    """Uncentred truncated SVD of an array column from its Gram matrix."""
    lam, v = np.linalg.eigh(gram_matrix(df, vec))
    top = np.argsort(lam)[::-1][:k]
    v = v[:, top]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return Projection(v, values=[float(x) for x in np.sqrt(np.maximum(lam[top], 0.0))])


def compress_if_wide(df: DataFrame, vec: str, task: str, out: str = "features"
                     ) -> tuple[DataFrame, Projection | None]:
    from tessera.config import SVD_COMPONENTS, WIDE_LIMIT, WIDE_LIMIT_CLUSTERING
    row = df.agg(F.max(F.size(vec)).alias("w"), F.count("*").alias("n")).first()
    limit = WIDE_LIMIT_CLUSTERING if task == "clustering" else WIDE_LIMIT
    k = min(SVD_COMPONENTS, row["w"] - 1, row["n"] - 1)
    if row["w"] <= limit or k < 1:
        return df.withColumn(out, F.col(vec)), None
    svd = fit_svd(df, vec, k)
    return svd.apply(df, vec, out), svd


# ---------------------------------------------------------------- selection statistics

def anova_f(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """F of each feature between classes as ``(feature, f_score)``: one grouped pass."""
    per = df.groupBy(label).agg(*[F.struct(
        F.count(c).alias("n"), F.avg(c).alias("m"),
        F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("ss")).alias(c) for c in cols])
    long = unpivot(per, cols, name="feature", value="s").select("feature", "s.*")
    g = long.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    dev = F.col("m") - F.col("g")
    t = long.join(g, "feature").groupBy("feature").agg(
        F.sum(F.col("n") * dev * dev).alias("b"), F.sum("ss").alias("w"),
        F.count("*").alias("k"), F.sum("n").alias("n"))
    return t.select("feature", F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1),
                                            F.try_divide(F.col("w"), F.col("n") - F.col("k"))).alias("f_score"))


def regression_f(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """F of each feature's simple regression: r²/(1−r²)·(n−2)."""
    row = df.agg(F.struct(*[safe_corr(c, target).alias(c)
                            for c in cols]).alias("r"), F.count(target).alias("n"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("r")[c].alias("v")) for c in cols])
    r2 = F.col("v") * F.col("v")
    return row.select("n", F.inline(cells)).select(
        "feature", F.try_divide(r2, 1 - r2) * (F.col("n") - 2))\
        .toDF("feature", "f_score")


def select_features(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Features ranked by F; ``k=None`` keeps all."""
    ranked = scores.withColumn("place", F.row_number().over(
        W.partitionBy(F.lit(0)).orderBy(F.col("f_score").desc_nulls_last(), "feature")))
    return ranked if k is None else ranked.where(F.col("place") <= k)


# ---------------------------------------------------------------- target shape and splits

def corrected_skew(df: DataFrame, col: str) -> DataFrame:
    """Bias-corrected skewness of one column as ``(n, skew)``."""
    n = F.count(col).cast("double")
    return df.agg(F.count(col).alias("n"),
                  F.try_divide(F.skewness(col) * F.sqrt(n * (n - 1)), n - 2).alias("skew"))


def log_target(df: DataFrame, target: str, threshold: float = 1.0, out: str = "y"
               ) -> tuple[DataFrame, str | None]:
    """``out`` = log1p(target) when its skew passes the threshold, else the number itself."""
    num = df.withColumn(out, to_number(target)).where(F.col(out).isNotNull())
    n = F.count(out).cast("double")
    row = num.agg(F.try_divide(F.skewness(out) * F.sqrt(n * (n - 1)), n - 2).alias("skew"),
                  F.min(out).alias("lowest")).first()
    if row["skew"] is not None and abs(row["skew"]) > threshold and row["lowest"] > -1:
        return num.withColumn(out, F.log1p(out)), "log1p"
    return num, None


def quantile_edges(df: DataFrame, col: str, bins: int = 10) -> list[float]:
    edges = exact_quantiles(df, [col], [i / bins for i in range(bins + 1)]).first()["quantiles"]
    return sorted(set(edges))


def quantile_bin(col: str | Column, edges: Sequence[float]) -> Column:
    """Right-closed bin number from 0; the lowest value belongs to bin 0."""
    col = F.col(col) if isinstance(col, str) else col
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else None
    if inner is None:
        return F.lit(0)
    return F.size(F.filter(inner, lambda e: e < col))


STRATA_LIMIT = 10_000


def allocate_test_rows(counts: dict, test_size: float) -> dict:
    """Test rows per stratum, from exact counts: largest remainders of the train share.

    Remainder ties go to the smaller stratum value, so that the result is the same every time.
    """
    n = sum(counts.values())
    n_train = n - math.ceil(n * test_size)
    share = {s: c * n_train / n for s, c in counts.items()}
    train = {s: math.floor(v) for s, v in share.items()}
    short = n_train - sum(train.values())
    for s in sorted(counts, key=lambda s: (-round(share[s] - train[s], 9), s))[:short]:
        train[s] += 1
    return {s: counts[s] - train[s] for s in counts}


def stratified_split(df: DataFrame, stratum: str, key: Sequence[str], test_size: float = 0.25,
                     seed: int = 42, flag: str = "is_test") -> DataFrame:
    """Flag a test part with exact counts per stratum; independent of partitioning."""
    hist = written(hash_histogram(df, stratum, key, seed), "histogram")
    counted = hist.groupBy(stratum).agg(F.sum("n").alias("n")).limit(STRATA_LIMIT + 1).collect()
    if len(counted) > STRATA_LIMIT:
        raise ValueError(f"more than {STRATA_LIMIT} strata: stratify on a coarser column")
    takes = allocate_test_rows({r[stratum]: r["n"] for r in counted}, test_size)
    schema = T.StructType([df.schema[stratum], T.StructField("take", T.LongType())])
    table = df.sparkSession.createDataFrame([(s, t) for s, t in takes.items()], schema)
    return split_by_hash(df, stratum, key, table, seed, hist, flag, few_strata=True)


FOLD_BUCKET_ROWS = 100_000


def stratified_folds(df: DataFrame, strata: Sequence[str], key: str, folds: int, seed: int = 43,
                     out: str = "fold") -> DataFrame:
    """Deal the rows of each stratum over the folds in turn, in the order of a hash of the key.

    Fold sizes of a stratum differ by one row at most, so a rare class is in as many folds as it
    has rows. A stratum is numbered in hash buckets of bounded size: offsets come from the small
    table of bucket counts, rows are only ordered within a bucket.
    """
    buckets = 1 + df.count() // FOLD_BUCKET_ROWS
    h = F.xxhash64(F.lit(seed), key)
    keyed = df.withColumns({"_h": h, "_b": F.pmod(h, F.lit(buckets))})
    by = [*strata, "_b"]
    before = W.partitionBy(*strata).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy(*by).agg(F.count("*").alias("_n")).withColumn(
        "_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(*by).orderBy("_h", key)) - 1 + F.col("_at")
    return keyed.join(offsets, by).withColumn(
        out, F.pmod(place, F.lit(folds)).cast("int")).select(*df.columns, out)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with weight n/(k·n_c)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_classes = W.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n").over(all_classes).cast("double") / (
        F.count("*").over(all_classes) * F.col("n")))


def imbalance(df: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """One row ``(ratio, is_imbalanced)`` from the class counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    ratio = F.min("n").cast("double") / F.max("n")
    return counts.agg(ratio.alias("ratio")).withColumn("is_imbalanced",
                                                       F.col("ratio") < threshold)


def to_vector(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(f"`{c}`").cast("double")
                                                        for c in cols])))


def as_array(col: str) -> Column:
    return vector_to_array(F.col(col))
