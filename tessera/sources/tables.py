"""Table sources and sinks: delimited text, cleaned snapshots, JSON records, text reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Text that means "no value" in an input file.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             **options: str) -> DataFrame:
    """Header CSV with inferred types: whole number, number, true/false or text.

    Values are read as text so that every null token counts; one aggregate over the file then
    tells which type fits each column. Give ``schema`` to skip that pass.
    """
    text = spark.read.options(header=True, escape='"', **options).csv(path)
    text = text.toDF(*[re.sub(r"[\s`.]+", "_", c.strip()) for c in text.columns])
    valued = text.select(*[F.when(~F.trim(c).isin(NULL_TOKENS), F.col(c)).alias(c)
                           for c in text.columns])
    if schema is not None:
        return valued.select(*[F.trim(f.name).try_cast(f.dataType).alias(f.name) if not isinstance(
            f.dataType, T.StringType) else F.col(f.name) for f in schema])
    checks = []
    for c in valued.columns:
        v = F.trim(c)
        checks.append(F.struct(
            F.count(c).alias("n"),
            F.count_if(F.coalesce(v.rlike(r"^[+-]?\d+$") & v.try_cast("long").isNotNull(),
                                  F.lit(False))).alias("whole"),
            F.count_if(v.try_cast("double").isNotNull() & ~v.rlike("[dDfF]$")).alias("number"),
            F.count_if(F.lower(v).isin("true", "false")).alias("bool")).alias(c))
    seen = valued.agg(*checks).first()

    def typed(c: str) -> Column:
        s = seen[c]
        if s["n"] == 0:
            return F.lit(None).cast("double").alias(c)
        if s["whole"] == s["n"]:
            return F.trim(c).cast("long").alias(c)
        if s["number"] == s["n"]:
            return F.trim(c).cast("double").alias(c)
        if s["bool"] == s["n"]:
            return F.trim(c).cast("boolean").alias(c)
        return F.col(c)

    return valued.select(*[typed(c) for c in valued.columns])


def write_snapshot(df: DataFrame, root: str, chat_id: str) -> str:
    path = f"{root}/{chat_id}/data"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, chat_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{chat_id}/data")


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null."""
    return df.withColumns({f.name: F.when(
        F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name))
        for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def to_records(df: DataFrame, out: str = "record") -> DataFrame:
    """One JSON text per row; nulls are written, dates in ISO form."""
    return finite(df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
                             .alias(out))


# Result fields stored as columns of their own.
DIRECT_FIELDS = ["model_name", "metrics", "graphics", "model_metadata", "train_start",
                 "train_finish"]


def split_result(df: DataFrame, place: str | None = None) -> DataFrame:
    """Split result records into direct columns and one JSON column with everything else.

    Fields besides the direct ones, ``hyperparams`` and the place go into ``model_metadata``,
    over the keys already there.
    """
    direct = [c for c in DIRECT_FIELDS if c in df.columns and c != "model_metadata"]
    hyper = [c for c in ("hyperparams", "hyperparameters") if c in df.columns][:1]
    extra = [c for c in df.columns if c not in [*direct, *hyper, "model_metadata", place]]
    as_text = F.create_map(*[x for c in extra for x in (
        F.lit(c), F.col(c).cast("string") if isinstance(df.schema[c].dataType, T.AtomicType)
        else F.to_json(c))]) if extra else F.create_map().cast("map<string,string>")
    if "model_metadata" in df.columns:
        old = F.coalesce(F.col("model_metadata"), F.create_map().cast("map<string,string>"))
        kept = F.map_filter(old, lambda k, _: ~k.isin(extra)) if extra else old
        as_text = F.map_concat(kept, as_text)
    meta = F.when(F.size(as_text) > 0, as_text)
    return df.select(*direct, *[F.col(c).alias("hyperparams") for c in hyper],
                     meta.alias("model_metadata"),
                     *([F.col(place).alias("place_in_training_batch")] if place else []))


def report_lines(runs: DataFrame) -> DataFrame:
    """Ranked report of clustering runs, one text block per run; no value prints as N/A."""
    def four(c: str) -> Column:
        return F.coalesce(F.format_string("%.4f", F.nanvl(F.col(c), F.lit(None))), F.lit("N/A"))

    shown = runs.withColumns({f"_{c}": F.when(F.col(c).isNull() | F.isnan(c), "N/A").otherwise(
        four(c)) for c in ("unified_score", "silhouette", "calinski_harabasz", "gap")})
    return shown.select("place", F.concat_ws(
        "\n", F.concat(F.col("place"), F.lit(". "), F.col("model_name"), F.lit(" - ")),
        F.concat(F.lit("Unified score: "), F.col("_unified_score")),
        F.concat(F.lit("Silhouette: "), F.col("_silhouette")),
        F.concat(F.lit("Calinski-Harabasz: "), F.col("_calinski_harabasz")),
        F.concat(F.lit("Gap: "), F.col("_gap"))).alias("text"))


def write_report(runs: DataFrame, path: str) -> None:
    report_lines(runs).orderBy("place").select("text").write.mode("overwrite").text(path)


# ---------------------------------------------------------------- names and paths

def safe_filename(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore only, at most 100 characters."""
    return F.substring(F.regexp_replace(F.trim(name), r"(?U)[^\w.\-]", "_"), 1, 100)


def folder_of(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def dataset_key(user_id: Column, name: Column) -> Column:
    return F.concat_ws("/", user_id, folder_of(name), name)


def encoder_key(key: Column) -> Column:
    parts = F.split(key, "/")
    return F.when(F.size(parts) >= 2, F.concat_ws(
        "/", parts[0], parts[1], F.lit("feature_encoder.pkl"))).otherwise(
        F.concat(folder_of(key), F.lit("_feature_encoder.pkl")))


def file_name(key: Column, default: Column) -> Column:
    """Last part of a path, else the key itself, else the default."""
    return F.when(key.contains("/"), F.element_at(F.split(key, "/"), -1)).otherwise(
        F.coalesce(F.nullif(key, F.lit("")), default))


def model_path(root: str, chat_id: str, task: str, place: int, name: str = "") -> str:
    return "/".join(p for p in (root, chat_id, task, f"top-{place}", name) if p)
