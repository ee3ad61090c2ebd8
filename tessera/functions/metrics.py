"""Evaluation metrics over a table of labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.functions.ordered import with_prefix_sums

CLASS_LIMIT = 2_000


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def label_pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    """``(y, p, n)`` for the pairs that occur."""
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """``(label, tp, fp, fn, f1)`` for every label seen as truth or prediction."""
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n"))
                 .otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"),
                 F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("long").alias("fn")))
    per = (label_pairs(df, y, p).select(F.inline(sides)).groupBy("label")
           .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    down = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return per.withColumn("f1", F.when(down == 0, 0.0).otherwise(2 * F.col("tp") / down))


def f1_binary(df: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    return class_scores(df, y, p).agg(F.coalesce(F.max(F.when(
        F.col("label") == positive, F.col("f1"))), F.lit(0.0)).alias("f1_score"))


def f1_macro(df: DataFrame, y: str, p: str) -> DataFrame:
    return class_scores(df, y, p).agg(F.avg("f1").alias("f1_score"))


def _auc_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rank form with average ranks: a tie counts half.

    Rows with one score are one row here, so ordering works on distinct scores, in ranges.
    """
    ordered = with_prefix_sums(counts, "score", {"neg_before": "neg"}, by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pos, neg = F.sum("pos"), F.sum("neg")
    value = F.try_divide(wins, (pos * neg).cast("double")).alias("roc_auc")
    return ordered.groupBy(*by).agg(value) if by else ordered.agg(value)


def auc_binary(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    hit = (F.col(y) == positive).cast("long")
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    return _auc_from_counts(counts, [])


def auc_per_class(df: DataFrame, y: str, probability: str) -> DataFrame:
    """``(label, roc_auc)`` of each class against the rest; ``probability`` is an array."""
    hit = (F.col("y") == F.col("label")).cast("long")
    counts = (df.select(F.col(y).cast("int").alias("y"),
                        F.posexplode(probability).alias("label", "score"))
              .groupBy("label", F.col("score").cast("double").alias("score"))
              .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")))
    return _auc_from_counts(counts, ["label"])


def auc_macro(df: DataFrame, y: str, probability: str) -> DataFrame:
    return auc_per_class(df, y, probability).agg(F.avg("roc_auc").alias("roc_auc"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Every cell of the label grid as ``(y, p, n)``, zeros included."""
    pairs = label_pairs(df, y, p)
    seen = (pairs.select(F.explode(F.array("y", "p")).alias("v")).distinct()
            .limit(CLASS_LIMIT + 1).collect())
    if len(seen) > CLASS_LIMIT:
        raise ValueError(f"more than {CLASS_LIMIT} classes: use label_pairs")
    labels = sorted(r["v"] for r in seen)
    lit = F.array(*map(F.lit, labels))
    grid = (df.sparkSession.range(1).select(F.explode(lit).alias("y"))
            .select("y", F.explode(lit).alias("p")))
    return grid.join(pairs, ["y", "p"], "left").select(
        "y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """One row per true label with its counts in label order; labels are shown as 0..k-1."""
    return cells.groupBy("y").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "n"))),
                                              lambda s: s["n"]).alias("counts"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """``(mse, rmse, mae, r2)`` in one pass."""
    err = F.col(y).cast("double") - F.col(p)
    return df.agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
                  (F.var_pop(F.col(y).cast("double"))).alias("_v")).select(
        "mse", F.sqrt("mse").alias("rmse"), "mae",
        F.when(F.col("_v") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.col("mse") / F.col("_v")).alias("r2"))


def main_metric(task: str, n_classes: int, imbalanced: bool) -> str:
    """Name of the metric models are ranked and tuned by."""
    if task == "regression":
        return "r2"
    if not imbalanced:
        return "accuracy"
    return "f1" if n_classes == 2 else "f1_macro"


def measure(df: DataFrame, metric: str, y: str = "label", p: str = "prediction") -> float:
    if metric == "accuracy":
        out = accuracy(df, y, p)
    elif metric == "f1":
        out = f1_binary(df, y, p)
    elif metric == "f1_macro":
        out = f1_macro(df, y, p)
    elif metric in ("mse", "rmse", "mae", "r2"):
        out = regression_metrics(df, y, p).select(metric)
    else:
        raise ValueError(f"unknown metric {metric}")
    return float(out.first()[0])


def normalise_runs(runs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_norm``: min–max over all runs, 1 where all are equal; null reads as 0."""
    filled = runs.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
                               for c in cols})
    ends = filled.agg(*[F.min(c).alias(f"lo_{c}") for c in cols],
                      *[F.max(c).alias(f"hi_{c}") for c in cols]).first()

    def scaled(c: str):
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if lo is None or hi - lo < 1e-10:
            return F.lit(1.0)
        return (F.col(c) - F.lit(lo)) / F.lit(hi - lo)

    return filled.withColumns({f"{c}_norm": scaled(c) for c in cols})
