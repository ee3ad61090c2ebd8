"""The corpus pipeline: toxicity, near copies, benchmark leaks, source mix, token ids.

Each stage takes the documents that the one before kept and returns documents (``doc_id, text,
lang, source, n_chars``); the last returns the token ids' place and checksum for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm import heavylight, leaks, mixing, rans, toxicity
from tessera.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ids(docs: DataFrame) -> DataFrame:
    """Documents under a key that null and repeated ids don't blur: id, text and source."""
    return docs.select(*COLUMNS).withColumn(
        "row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")),
                          F.col("doc_id").isNull(), F.col("source")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Trained on the labelled rows of the input."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs, model, "text", "lang", "source", "n_chars")
    return kept.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays, as one row.

    Texts without words have no copies and stay, each row; so do rows with a null id whose
    component has no other id, but one row of each such text.
    """
    groups = heavylight.join(docs)
    stays = groups.where("component_id <=> doc_id").select("doc_id", "content", "n_shingles").distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))
                        .alias("content"))
    # Null ids join like others; every row of an empty text stays, else one row of each document.
    kept = keyed.join(stays.withColumnsRenamed({"doc_id": "d", "content": "c"}).hint(
        "shuffle_hash"), (F.coalesce("doc_id", F.lit(-1)) == F.coalesce("d", F.lit(-1)))
        & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")))
    wordless = kept.where("n_shingles = 0").select(*COLUMNS)
    return kept.where("n_shingles > 0").dropDuplicates(["doc_id", "content"]).select(
        *COLUMNS).unionByName(wordless)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go. The rest is passed on as it is."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _ids(docs)
    found = leaks.leaks(keyed.select(F.col("row").alias("doc_id"), "text"), items)
    leaking = written(found.select(F.col("doc_id").alias("row")).distinct(), "leaking")
    return keyed.join(leaking, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: whole epochs repeat a row, the cut ends a text.

    A row taken for 2.4 times its words comes three times, the last with the first 0.4 of its
    words (joined by spaces); a row that the mix doesn't reach goes; wordless texts go.
    """
    keyed = _ids(docs)
    sizes = keyed.select(F.col("row").alias("doc_id"), "source", F.coalesce(
        F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size"))
    plan = written(mixing.mix(sizes).where("taken > 0").select(
        F.col("doc_id").alias("row"), "size", "taken"), "mix")
    # Equal rows share a key and their takings: the n-th row of a key gets the n-th share.
    plan = plan.withColumn("n", F.row_number().over(
        W.partitionBy("row").orderBy(F.desc("taken")))).select("row", "size", "taken", "n")
    copies = keyed.withColumn("n", F.row_number().over(W.partitionBy("row").orderBy("n_chars", "lang")))
    taken = copies.join(plan.hint("shuffle_hash"), ["row", "n"])
    parts = taken.withColumn("part", F.explode(F.sequence(
        F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    rest = F.col("taken") - (F.col("part") - 1) * F.col("size")
    words = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})")),
                                     1, rest.cast("int")))
    cut = rest < F.col("size")
    return parts.withColumn("text", F.when(cut, words).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode all rows, write the binary files, read them back: place and checksum of each row."""
    _, rows = rans.encode_documents(docs, rans.default_tokenizer())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("toxicity", drop_toxic), ("near_copies", one_of_near_copies),
          ("decontamination", drop_leaks), ("mixing", mix_sources), ("token_ids", token_ids)]

#: Models, a similarity join and a binary format: tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
