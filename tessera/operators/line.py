"""Points on a line: order replaces pairs, so the work grows with the points, not with their pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessera.session import written

CHUNK_ROWS = 1 << 18
ROWS_AT_ONCE = 1 << 13
LARGEST = 1e150              # beyond, squares of differences leave the range of a double
_AT = (1 << 33) - 1          # low bits of monotonically_increasing_id: place in the partition


def on_line(p: DataFrame) -> bool:
    """Whether every vector is one finite number and every key is there."""
    x = F.col("vec")[0]
    good = (F.size("vec") == 1) & x.isNotNull() & (F.abs(x) < float("inf")) & F.col("id").isNotNull()
    first = p.select("vec").first()
    return (first is not None and first["vec"] is not None and len(first["vec"]) == 1
            and p.where(~F.coalesce(good, F.lit(False))).isEmpty())


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """Add ``i``, the place of each row in the order of ``by`` from 0, without one task for all."""
    parts = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before = np.cumsum([0] + [r["n"] for r in sizes])
    first = df.sparkSession.createDataFrame(
        [(r["_part"], int(b)) for r, b in zip(sizes, before)], "_part long, _before long")
    return (parts.withColumn("_part", part).join(F.broadcast(first), "_part")
            .withColumn("i", F.col("_before") + F.col("_at").bitwiseAND(_AT))
            .drop("_at", "_part", "_before"))


def kth_on_line(p: DataFrame, k: int, chunk: int = CHUNK_ROWS) -> DataFrame:
    """``(id, dist)``: distance to the k-th nearest other point, k below the count.

    The k + 1 points that are nearest to x, itself included, stand in a row in the order of all. Of
    the rows of k + 1 points, ordered by the sum of their ends, only the last one with its middle up
    to x and the first one beyond can have the smallest reach. Both orders are sorts of all points.
    """
    order = written(numbered(p.select("id", F.col("vec")[0].alias("x")), "x", "id"), "line")
    ends = order.select((F.col("i") - k).alias("i"), F.col("x").alias("hi"))
    spans = order.select("i", F.col("x").alias("lo")).join(ends, "i")
    empty = F.lit(None).cast("double")
    both = spans.select((F.col("lo") + F.col("hi")).alias("key"), F.lit(0).alias("asks"), "lo", "hi",
                        F.lit(None).cast(p.schema["id"].dataType).alias("id")).unionByName(
        order.select((F.col("x") * 2).alias("key"), F.lit(1).alias("asks"), F.col("x").alias("lo"),
                     empty.alias("hi"), "id"))
    placed = written(numbered(both, "key", "asks", "lo").withColumn(
        "chunk", F.floor(F.col("i") / chunk)), "spans")
    here, span = F.col("asks") == 0, F.struct("lo", "hi")
    rows = {r["chunk"]: (r["first"], r["last"]) for r in placed.where(here).groupBy("chunk").agg(
        F.min_by(span, "i").alias("first"), F.max_by(span, "i").alias("last")).collect()}
    # What a chunk's points may need beyond its own spans: the span before it and the one after.
    last = placed.agg(F.max("chunk")).first()[0]
    around: dict[int, list] = {c: [None, None] for c in range(last + 1)}
    seen = None
    for c in range(last + 1):
        around[c][0] = seen
        seen = tuple(rows[c][1]) if c in rows else seen
    seen = None
    for c in range(last, -1, -1):
        around[c][1] = seen
        seen = tuple(rows[c][0]) if c in rows else seen

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        asks = pdf["asks"].to_numpy() == 1
        before, after = around[int(pdf["chunk"].iloc[0])]
        inner = pdf.loc[~asks, ["lo", "hi"]].to_numpy(dtype=float)
        spans = np.concatenate([np.array([s], dtype=float).reshape(-1, 2) if s else np.empty((0, 2))
                                for s in (before,)] + [inner] + [
            np.array([s], dtype=float).reshape(-1, 2) if s else np.empty((0, 2)) for s in (after,)])
        x = pdf.loc[asks, "lo"].to_numpy(dtype=float)
        at = np.searchsorted(spans[:, 0] + spans[:, 1], 2 * x, side="right") - 1
        best = np.full(len(x), np.inf)
        for place in (at, at + 1):
            ok = (place >= 0) & (place < len(spans))
            lo, hi = spans[place[ok]].T
            best[ok] = np.minimum(best[ok], np.maximum(x[ok] - lo, hi - x[ok]))
        return pd.DataFrame({"id": pdf.loc[asks, "id"].to_numpy(), "dist": best})

    kind = p.schema["id"].dataType.simpleString()
    return placed.groupBy("chunk").applyInPandas(reach, f"id {kind}, dist double")


def nearest_on_line(p: DataFrame, k: int, chunk: int = CHUNK_ROWS >> 2
                    ) -> tuple[DataFrame, DataFrame | None] | None:
    """``(id, nbr, dist, place)``: the k nearest other points, ties to the lower id; and the points
    (``id, vec``) that this leaves open, if any. None where a key repeats or numbers are too large.

    Of the points at one place only those with the k + 1 smallest ids can be neighbours. In the order
    of these, the answer for a point lies within 3k + 1 places to each side: its own place has k
    others at most, and the place where the k-th of a side stands ends k places farther on. A chunk
    of the order meets that many rows around it. Farther copies have the first k of their place. Where
    rounding makes different places equally far up to the end of the rows seen, the point stays open.
    """
    points = written(p.select("id", (F.col("vec")[0] + 0.0).alias("x")), "line")
    if (not points.groupBy("id").count().where("count > 1").isEmpty()
            or points.agg(F.max(F.abs("x"))).first()[0] > LARGEST):
        return None
    rank = F.row_number().over(W.partitionBy("x").orderBy("id"))
    able = written(points.withColumn("rank", rank).where(F.col("rank") <= k + 1), "able")
    side = 3 * k + 2
    order = numbered(able.drop("rank"), "x", "id").withColumn("own", F.floor(F.col("i") / chunk))
    seen = order.withColumn("chunk", F.explode(F.sequence(
        F.floor((F.col("i") - side) / chunk), F.floor((F.col("i") + side) / chunk))))
    key = p.schema["id"].dataType
    schema = T.StructType([T.StructField("id", key), T.StructField("nbr", key),
                           T.StructField("dist", T.DoubleType()), T.StructField("place", T.IntegerType()),
                           T.StructField("open", T.BooleanType())])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, ids = pdf["x"].to_numpy(dtype=float), pdf["id"].to_numpy()
        mine = np.flatnonzero((pdf["own"] == pdf["chunk"]).to_numpy())
        steps = np.r_[-side:0, 1:side + 1]
        out = []
        for begin in range(0, len(mine), ROWS_AT_ONCE):
            at = mine[begin:begin + ROWS_AT_ONCE]
            near = at[:, None] + steps
            there = (near >= 0) & (near < len(x))
            near = np.where(there, near, 0)
            d = np.where(there, np.sqrt((x[near] - x[at][:, None]) ** 2), np.inf)
            by = np.argsort(ids[near], axis=1, kind="stable")
            by = np.take_along_axis(by, np.argsort(np.take_along_axis(d, by, 1), axis=1,
                                                   kind="stable"), 1)[:, :k]
            best, far = np.take_along_axis(d, by, 1), np.isfinite(d[:, [0, -1]])
            tied = (far & (d[:, [0, -1]] <= best[:, -1:])).any(1)
            i, j = np.nonzero(np.isfinite(best) & ~tied[:, None])
            out.append(pd.DataFrame({"id": ids[at][i], "nbr": ids[near[i, by[i, j]]],
                                     "dist": best[i, j], "place": (j + 1).astype("int32"), "open": False}))
            if tied.any():
                some = ids[at][tied]
                out.append(pd.DataFrame({"id": some, "nbr": some, "dist": 0.0, "place": np.int32(0),
                                         "open": True}))
        return pd.concat(out) if out else pd.DataFrame(columns=schema.names)

    found = written(seen.groupBy("chunk").applyInPandas(meet, schema), "nearest")
    copies = points.join(able.select("id"), "id", "left_anti")
    first = able.where(F.col("rank") <= k).select("x", F.col("id").alias("nbr"), F.col("rank").alias("place"))
    rows = found.where("NOT open").drop("open").unionByName(copies.join(first, "x").select(
        "id", "nbr", F.lit(0.0).alias("dist"), "place"))
    rest = found.where("open").select("id").join(p.select("id", "vec"), "id")
    return rows, None if rest.isEmpty() else rest


def clusters_on_line(p: DataFrame, k: int) -> DataFrame | None:
    """``(id, component)`` of single linkage: the line cut at its k - 1 widest gaps, ties by ends.

    None where that is not the whole answer: fewer gaps than cuts, or a key at several places.
    """
    x = F.col("vec")[0]
    points = written(p.select("id", (x + 0.0).alias("x")), "line")
    distinct = points.groupBy("x").agg(F.min("id").alias("id"))
    if not points.groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b").isEmpty():
        return None
    order = written(numbered(distinct, "x"), "gaps")
    ahead = order.select((F.col("i") - 1).alias("i"), F.col("x").alias("next"), F.col("id").alias("o"))
    gaps = order.join(ahead, "i").select(
        "next", (F.col("next") - F.col("x")).alias("w"), F.least("id", "o").alias("u"),
        F.greatest("id", "o").alias("v"))
    cuts = gaps.orderBy(F.col("w").desc(), F.col("u").desc(), F.col("v").desc()).limit(
        max(0, k - 1)).select("next").collect()
    if len(cuts) < k - 1:
        return None
    starts = np.sort(np.array([r["next"] for r in cuts], dtype=float))

    @F.pandas_udf("int")
    def side(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, values.to_numpy(dtype=float), side="right"))

    cut = written(points.select("id", side("x").alias("c")), "sides")
    return cut.join(F.broadcast(cut.groupBy("c").agg(F.min("id").alias("component"))), "c").select(
        "id", "component")
