"""Connected components and minimum spanning forests over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.session import written

MAX_ROUNDS = 60


def connected_components(vertices: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """``(key, component)``: the smallest vertex of each vertex's component.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components
    in MapReduce and Beyond", SoCC 2014). A step is a grouped minimum and a join on a unique key,
    so the neighbours of a hub are never gathered. Each step is written once.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .where("u <> v").distinct(), "edges")
    found = _stars(e).select(F.col("u").alias(key), F.col("v").alias("component"))
    return vertices.select(key).join(found, key, "left").select(
        key, F.coalesce("component", key).alias("component"))


def _stars(e: DataFrame) -> DataFrame:
    mark = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e
        mark = now
    raise RuntimeError("components did not settle")


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning forest ``(u, v, w)``; equal weights are ordered by their ends.

    Borůvka rounds: every component takes its lightest outgoing edge (a grouped
    minimum), then components are merged.
    """
    e = written(edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                .agg(F.min("w").alias("w")).where("u <> v"), "weighted")
    label = written(vertices.select(F.col("id"), F.col("id").alias("c")), "labels")
    chosen = None
    for _ in range(MAX_ROUNDS):
        a = label.select(F.col("id").alias("u"), F.col("c").alias("cu"))
        b = label.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        e = written(e.select("u", "v", "w").join(a, "u").join(b, "v").where("cu <> cv"), "open")
        if e.isEmpty():
            break
        out = e.select(F.inline(F.array(
            F.struct(F.col("cu").alias("c"), "w", "u", "v", F.col("cv").alias("o")),
            F.struct(F.col("cv").alias("c"), "w", "u", "v", F.col("cu").alias("o")))))
        best = written(out.groupBy("c").agg(F.min(F.struct("w", "u", "v", "o")).alias("s"))
                       .select("c", "s.*"), "lightest")
        picked = best.select("u", "v", "w").distinct()
        chosen = picked if chosen is None else chosen.unionByName(picked)
        merged = connected_components(
            label.select(F.col("c").alias("id")).distinct(),
            best.select(F.col("c").alias("u"), F.col("o").alias("v")))
        label = written(label.withColumnRenamed("c", "old").join(
            merged.select(F.col("id").alias("old"), F.col("component").alias("c")), "old")
            .select("id", "c"), "labels")
    return chosen if chosen is not None else e.select("u", "v", "w")
