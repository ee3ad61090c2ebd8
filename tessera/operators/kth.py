"""Exact distance to the k-th nearest other point for any k, without neighbour rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.operators.blocks import BLOCK_ROWS, block_join, tiles
from tessera.operators.line import kth_on_line, on_line
from tessera.operators.pivots import matrix
from tessera.session import written

BINS = 32
FEW = 192                    # distances in a bracket that are few enough to be handed on
MAX_ROUNDS = 14              # of 32-fold narrowing: more than a double can resolve
SAMPLE = 1 << 20             # numbers in the sample of points that sets the first brackets
SHARE = 16                   # of the points, one in so many at most
STEP = 512                   # points that meet the sample at once
SURE = 5.0                   # deviations of the sample's rank that a first bracket spans


def _gaps(l: pd.DataFrame, r: pd.DataFrame):
    """``(first row, distances)`` of all pairs, in tiles; infinite from a point to itself."""
    at = pd.Index(r["id"].to_numpy()).get_indexer(l["id"].to_numpy())
    own = np.flatnonzero(at >= 0)
    for i, j, sq in tiles(matrix(l), matrix(r)):
        d = np.sqrt(sq, out=sq)
        if len(own):
            mine = own[np.searchsorted(own, i):np.searchsorted(own, i + len(d))]
            mine = mine[(at[mine] >= j) & (at[mine] < j + d.shape[1])]
            d[mine - i, at[mine] - j] = np.inf
        yield i, d


def _sampled(points: DataFrame, n: int, width: int) -> pd.DataFrame | None:
    """Points drawn by the hash of their id, none where there are few."""
    want = min(n // SHARE, SAMPLE // width)
    if want < 64:
        return None
    u = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return points.where(u < want / n).select("id", "vec").toPandas()


def kth_distance(p: DataFrame, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``(id, dist)``: each point's distance to its k-th nearest other point, k below the count.

    Each point keeps a bracket around the distance. The first one comes from its distances to a
    sample, so wide that it hardly ever misses; a point that it misses goes on outside of it. A
    histogram of the distances narrows the bracket ``BINS``-fold a round: a chunk pair hands on one
    row of counts a point, whatever k is. Once a bracket holds few distances, those alone are handed
    on and ranked; points that are as far need no further round. Every pair is computed once a
    round, as many rounds as log n asks for. Ties narrow to a bracket without width. Points on a
    line need no pairs: their order is enough.
    """
    key = p.schema["id"]
    points = written(p.select("id", "vec"), "points")
    if on_line(points):
        return kth_on_line(points, k)
    n, centre = points.select(F.count("*"), Summarizer.mean(array_to_vector("vec"))).first()
    centre = centre.toArray()
    most = points.mapInPandas(lambda batches: (pd.DataFrame({"r": [np.sqrt(
        ((matrix(pdf) - centre) ** 2).sum(1)).max()]}) for pdf in batches if len(pdf)),
        "r double").agg(F.max("r")).first()[0]
    sample = _sampled(points, n, len(centre))
    state = T.StructType([*points.schema.fields, *(T.StructField(c, T.DoubleType())
                                                   for c in ("lo", "hi", "top"))])

    def bracket(batches):
        for batch in batches:
            for start in range(0, len(batch), STEP):
                pdf = batch.iloc[start:start + STEP]
                x = matrix(pdf)
                # Nothing lies farther from a point than the centre and then the farthest point.
                top = (np.sqrt(((x - centre) ** 2).sum(1)) + most) * (1 + 1e-9) + 1e-300
                lo, hi = np.zeros(len(x)), top
                if sample is not None and len(sample):
                    d = np.empty((len(x), len(sample)))
                    for i, j, sq in tiles(x, drawn):
                        d[i:i + len(sq), j:j + sq.shape[1]] = sq
                    share, m = k / (n - 1), len(sample)
                    give = SURE * math.sqrt(m * share * (1 - share)) + 2
                    low, high = math.floor(m * share - give) - 1, math.ceil(m * share + give)
                    d.partition([i for i in (low, high) if 0 <= i < m], axis=1)
                    if low >= 0:
                        lo = np.sqrt(d[:, low]) * (1 - 1e-9)
                    if high < m:
                        hi = np.minimum(np.sqrt(d[:, high]) * (1 + 1e-9) + 1e-300, top)
                yield pdf[["id", "vec"]].assign(lo=lo, hi=hi, top=top)

    drawn = matrix(sample) if sample is not None and len(sample) else None
    rest, settled = written(points.mapInPandas(bracket, state), "brackets"), []
    bins = [f"c{i}" for i in range(BINS)]

    def histogram(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        lo, hi = l["lo"].to_numpy(), l["hi"].to_numpy()
        n, wide = np.zeros((len(l), BINS + 1), np.int64), (hi - lo) / BINS
        for i, d in _gaps(l, r):
            rows = slice(i, i + len(d))
            low = d < lo[rows, None]
            n[rows, 0] += np.count_nonzero(low, axis=1)
            at = np.flatnonzero((d < hi[rows, None]) & ~low)
            row = at // d.shape[1]
            with np.errstate(invalid="ignore", divide="ignore"):
                place = np.floor((d.ravel()[at] - lo[i + row]) / wide[i + row])
            place = np.clip(np.nan_to_num(place), 0, BINS - 1).astype(int)
            n[rows, 1:] += np.bincount(row * BINS + place, minlength=len(d) * BINS).reshape(-1, BINS)
        out = pd.DataFrame(n, columns=["below", *bins])
        out.insert(0, "id", l["id"].to_numpy())
        return out

    def narrowed(batches):
        for pdf in batches:
            if len(pdf):
                n, lo, hi = pdf[bins].to_numpy(), pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
                below, top = pdf["below"].to_numpy(), pdf["top"].to_numpy()
                reached = below[:, None] + n.cumsum(1) >= k
                at = np.where(reached.any(1), reached.argmax(1), BINS - 1)
                wide, inside = (hi - lo) / BINS, n[np.arange(len(n)), at]
                new_lo, new_hi = lo + at * wide, np.where(at == BINS - 1, hi, lo + (at + 1) * wide)
                # A first bracket that missed: on below it, or above.
                under, over = (below >= k) & (lo > 0), ~reached.any(1) & (hi < top)
                new_lo, new_hi = (np.where(under, 0.0, np.where(over, hi, new_lo)),
                                  np.where(under, lo, np.where(over, top, new_hi)))
                yield pdf[["id", "vec"]].assign(lo=new_lo, hi=new_hi, top=top, inside=np.where(
                    under | over, np.iinfo(np.int64).max, inside))

    brackets = T.StructType([*state.fields, T.StructField("inside", T.LongType())])
    counts = T.StructType([key, *(T.StructField(c, T.LongType()) for c in ("below", *bins))])
    wide = ((F.col("inside") > FEW) & (F.col("hi") - F.col("lo") > F.col("hi") * 1e-14)
            & (F.col("hi") > 1e-290))
    for _ in range(MAX_ROUNDS):
        found = block_join(rest, points, histogram, counts, block=block, large=True).groupBy(
            "id").agg(*[F.sum(c).alias(c) for c in ("below", *bins)])
        done = written(rest.select("id", "vec", "lo", "hi", "top").join(found, "id").mapInPandas(
            narrowed, brackets), "brackets")
        settled.append(done.where(~wide))
        rest = done.where(wide)
        if rest.isEmpty():
            break
        rest = written(rest, "rest")
    else:
        settled.append(rest)
    table = written(reduce(DataFrame.unionAll, settled).withColumn("tied", F.col("inside") > FEW),
                    "settled")

    def values(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        lo, hi = l["lo"].to_numpy(), np.where(l["tied"], -np.inf, l["hi"])
        below, owner, value = np.zeros(len(l), np.int64), [], []
        for i, d in _gaps(l, r):
            rows = slice(i, i + len(d))
            low = d < lo[rows, None]
            below[rows] += np.count_nonzero(low, axis=1)
            at = np.flatnonzero((d < hi[rows, None]) & ~low)
            owner.append(i + at // d.shape[1])
            value.append(d.ravel()[at])
        owner, value = np.concatenate(owner), np.concatenate(value)
        order = np.argsort(owner, kind="stable")
        each = np.split(value[order], np.cumsum(np.bincount(owner, minlength=len(l)))[:-1])
        return pd.DataFrame({"id": l["id"].to_numpy(), "below": below, "dists": each})

    rows = block_join(table, points, values, T.StructType(
        [key, T.StructField("below", T.LongType()), T.StructField("dists", T.ArrayType(
            T.DoubleType()))]), block=block, large=True)
    ranked = rows.groupBy("id").agg(F.sum("below").alias("below"), F.array_sort(F.flatten(
        F.collect_list("dists"))).alias("dists")).select(
        "id", F.get("dists", (k - 1 - F.col("below")).cast("int")).alias("dist"))
    return table.join(ranked, "id", "left").select("id", F.coalesce(
        "dist", (F.col("lo") + F.col("hi")) / 2).alias("dist"))
