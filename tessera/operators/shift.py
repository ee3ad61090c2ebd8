"""Mean shift as a range join between seeds and points on a hash grid, seeds being a table."""

from __future__ import annotations

import itertools
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.operators.blocks import smallest_within
from tessera.operators.pivots import matrix
from tessera.session import written

GRID_DIMS = 3                # dimensions that the grid cells are made of
BLOCK_ROWS = 2048
DONE = 1e-3                  # a seed rests once it moves less than this share of the bandwidth

Point = T.ArrayType(T.DoubleType())


def bin_seeds(p: DataFrame, side: float) -> DataFrame:
    """``(id, vec)``: the grid corners next to points, named by their coordinates."""
    corner = F.transform("vec", lambda x: F.round(x / side) + F.lit(0.0))
    return p.select(corner.alias("c")).distinct().select(
        F.concat_ws(" ", F.transform("c", lambda x: x.cast("long").cast("string"))).alias("id"),
        F.transform("c", lambda x: x * F.lit(float(side))).alias("vec"))


def _cell(vec: str, side: float, dims: int) -> Column:
    return F.array(*[F.floor(F.col(vec)[i] / side) for i in range(dims)])


def _dealt(df: DataFrame, hot: DataFrame | None, mine: str, theirs: str) -> DataFrame:
    """Rows of crowded cells hashed into chunks, and repeated for each chunk of the other side."""
    if hot is None:
        return df.withColumns({mine: F.lit(0), theirs: F.lit(0)})
    many = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(1))       # noqa: E731
    return (df.join(F.broadcast(hot), "cell", "left")
            .withColumn(mine, F.pmod(F.xxhash64(F.lit(5), "id"), many(mine)).cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), many(theirs) - 1)))
            .drop("n_a", "n_b"))


class Grid:
    """Points by the grid cell of their first dimensions: whatever lies within ``side`` of a place
    is in one of the 3^dims cells around it."""

    def __init__(self, p: DataFrame, side: float, block: int | None = None):
        first = p.select(F.size("vec").alias("d")).first()
        self.side, self.block = side, block or BLOCK_ROWS
        self.dims = min(GRID_DIMS, first["d"] if first else 1)
        self.points = written(p.select("id", "vec").withColumn("cell", _cell("vec", side, self.dims)),
                              "grid")
        self.counts = written(self.points.groupBy("cell").agg(F.count("*").alias("n")), "cells")
        self.most = self.counts.agg(F.max("n")).first()[0] or 0

    def step(self, seeds: DataFrame, count: int | None = None) -> DataFrame:
        """``(id, n, mean)``: count and mean of the points within ``side`` of each seed, where any.

        A cell with more points or seeds than a block is cut into chunks, so a task holds a block of
        each, and hands on one partial mean a seed. The table of crowded cells, at most two rows a
        block of points or seeds, is broadcast.
        """
        around = F.array(*[F.array(*[F.lit(x) for x in o])
                           for o in itertools.product((-1, 0, 1), repeat=self.dims)])
        near = seeds.select("id", "vec", F.explode(around).alias("o")).select(
            "id", "vec", F.zip_with(_cell("vec", self.side, self.dims), "o",
                                    lambda a, b: a + b).alias("cell"))
        near = near.join(self.counts.select("cell"), "cell", "left_semi")
        hot = self._crowded(near) if max(
            self.most, seeds.count() if count is None else count) > self.block else None
        side = self.side

        def sums(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(l) or not len(r):
                return pd.DataFrame(columns=["id", "n", "mean"])
            x, s = matrix(l), matrix(r)
            d2 = np.stack([((x - c) ** 2).sum(1) for c in s])
            m = (d2 <= side * side).astype(float)
            n = m.sum(1)
            hit = n > 0
            mean = (m[hit] @ x) / n[hit][:, None]
            return pd.DataFrame({"id": r["id"].to_numpy()[hit], "n": n[hit],
                                 "mean": pd.Series(list(mean), dtype=object)})

        found = _dealt(self.points, hot, "a", "b").groupBy("cell", "a", "b").cogroup(
            _dealt(near, hot, "b", "a").groupBy("cell", "a", "b")).applyInPandas(
            sums, T.StructType([seeds.schema["id"], T.StructField("n", T.DoubleType()),
                                T.StructField("mean", Point)]))
        total = Summarizer.mean(F.col("v"), F.col("n"))
        return (found.withColumn("v", array_to_vector("mean")).groupBy("id")
                .agg(F.sum("n").alias("n"), total.alias("m"))
                .select("id", F.col("n").cast("long").alias("n"), vector_to_array("m").alias("mean")))


    def _crowded(self, near: DataFrame) -> DataFrame:
        """``(cell, n_a, n_b)``: chunks of points and of seeds, where either needs more than one."""
        block = self.block
        return written(self.counts.withColumnRenamed("n", "p").join(
            near.groupBy("cell").agg(F.count("*").alias("s")), "cell")
            .where((F.col("p") > block) | (F.col("s") > block))
            .select("cell", F.ceil(F.col("p") / block).cast("int").alias("n_a"),
                    F.ceil(F.col("s") / block).cast("int").alias("n_b")), "crowded")


def find_modes(p: DataFrame, bandwidth: float, max_iter: int) -> tuple[DataFrame, dict[str, Any]]:
    """``(id, vec, n)`` of the modes, most points first among those within a bandwidth.

    All grid corners next to points start, however many. Seeds that meet at one place go on as one.
    Seeds at rest, or after ``max_iter`` rounds where they are (reported as not converged), are
    taken by their number of points (ties by name): one is a mode if no mode lies within a
    bandwidth. That is decided in rounds of a radius join: what comes first in its neighbourhood
    is a mode and rules the neighbourhood out.
    """
    grid = Grid(p, bandwidth)
    live = written(bin_seeds(p, bandwidth), "seeds")
    left, rest, rounds = live.count(), None, 0
    way = F.sqrt(F.aggregate(F.zip_with("vec", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                             lambda a, b: a + b))
    while rounds < max_iter:
        rounds += 1
        moved = grid.step(live, left).join(live.select("id", "vec"), "id").select(
            "id", "n", F.col("mean").alias("vec"), (way <= DONE * bandwidth).alias("rests"))
        moved = written(moved.groupBy("vec").agg(
            F.min(F.struct("id", "n", "rests")).alias("s")).select("vec", "s.*"), "moved")
        still = moved.where("rests").select("id", "vec", "n")
        rest = still if rest is None else rest.unionByName(still)
        live = moved.where("not rests").select("id", "vec", "n")
        left = live.count()
        if not left:
            break
    converged = not left
    rank = F.concat(F.lpad((F.lit(10**18) - F.col("n")).cast("string"), 19, "0"), F.lit(" "), "id")
    open_ = written(rest.unionByName(live.select("id", "vec", "n")).groupBy("vec").agg(
        F.min(F.struct("id", "n")).alias("s")).select("s.id", "vec", "s.n")
        .withColumn("rank", rank), "seeds")
    seeds, modes = open_.count(), None
    while not open_.isEmpty():
        first = smallest_within(open_.select("id", "vec"), open_.select("id", "vec", "rank"),
                                bandwidth, "rank").withColumnRenamed("rank", "first")
        new = written(open_.join(first, "id").where("rank = first").drop("first"), "modes")
        gone = smallest_within(open_.select("id", "vec"), new.select("id", "vec", "rank"), bandwidth,
                               "rank").select("id")
        open_ = written(open_.join(gone, "id", "left_anti"), "seeds")
        modes = new if modes is None else modes.unionByName(new)
    if modes is None:
        modes = open_
    modes = written(modes.select("id", "vec", "n"), "modes")
    return modes, {"converged": converged, "rounds": rounds, "seeds": seeds, "modes": modes.count()}
