"""Single linkage: the exact minimum spanning tree of the points, and its cut into k clusters."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.operators.blocks import BLOCK_ROWS, Index, tasks_for
from tessera.operators.graph import MAX_ROUNDS, connected_components
from tessera.operators.line import clusters_on_line, on_line
from tessera.operators.pivots import clearance, distances, exact, matrix, squared
from tessera.session import written


def _prim(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (w, i, j) of a minimum spanning tree of the rows."""
    left = np.arange(1, len(x))
    near, frm = np.sqrt(((x[1:] - x[0]) ** 2).sum(1)), np.zeros(len(x) - 1, dtype=int)
    out = []
    while len(left):
        at = int(near.argmin())
        i = int(left[at])
        out.append((float(near[at]), int(frm[at]), i))
        keep = np.arange(len(left)) != at
        left, near, frm = left[keep], near[keep], frm[keep]
        d = np.sqrt(((x[left] - x[i]) ** 2).sum(1))
        closer = d < near
        near[closer], frm[closer] = d[closer], i
    return out


def _settled(edges: list[tuple[float, int, int]], slack: np.ndarray
             ) -> tuple[np.ndarray, list[tuple[float, int, int]]]:
    """Root of each row, and the edges that surely belong to the tree of all points.

    Edges come lightest first. One that is shorter than all ways of a component to points elsewhere
    is that component's lightest edge of all.
    """
    root, slack, sure = np.arange(len(slack)), slack.copy(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for w, i, j in sorted(edges):
        a, b = find(i), find(j)
        if w < slack[a] or w < slack[b]:
            low, high = min(a, b), max(a, b)
            root[high] = low
            slack[low] = min(slack[a], slack[b])
            sure.append((w, i, j))
    return np.array([find(i) for i in range(len(root))]), sure


def _lightest(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """Of each component of ``l`` the lightest edge to another component in ``r``, ties by ends."""
    a, b = matrix(l), matrix(r)
    lid, rid = l["id"].to_numpy(), r["id"].to_numpy()
    names, code = np.unique(np.concatenate([l["c"].to_numpy(), r["c"].to_numpy()]),
                            return_inverse=True)
    mine, other = code[:len(l)], code[len(l):]
    sq, tol = squared(a, b)
    sq[mine[:, None] == other[None, :]] = np.inf
    least = np.full(len(names), np.inf)
    np.minimum.at(least, mine, sq.min(1))
    i, j = np.nonzero((sq <= (least[mine] + 4 * tol)[:, None]) & np.isfinite(sq))
    first = lid[i] < rid[j]
    found = pd.DataFrame({"c": names[mine[i]], "w": exact(a, b, i, j),
                          "u": np.where(first, lid[i], rid[j]), "v": np.where(first, rid[j], lid[i]),
                          "o": names[other[j]]})
    return found.sort_values(["c", "w", "u", "v"], kind="stable").drop_duplicates("c")


def _merge(best: DataFrame) -> DataFrame:
    """``(c, root)``: each component follows its lightest edge; of two that chose one edge the
    smaller is the root. Pointers are doubled until none moves."""
    back = best.select(F.col("c").alias("o"), F.col("o").alias("back"))
    at = written(best.join(back, "o").select("c", F.when(
        (F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(
        F.col("o")).alias("root")), "hooks")
    for _ in range(MAX_ROUNDS):
        step = at.select(F.col("c").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(step, "root").select(
            "c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
            "hooks")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at
    raise RuntimeError("components did not settle")


def spanning_tree(p: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(u, v, w)`` of a minimum spanning tree of all points by Euclidean distance.

    Equal points are joined first, by edges of weight 0 to the smallest id, so copies cost no
    distances. Each leaf of a pivot tree then settles what can't involve points elsewhere. What
    remains are Borůvka rounds: a component's lightest edge is sought within its leaves, then only
    in leaves that its points may reach with an edge not heavier than the one known, and never in
    leaves that hold nothing but the component itself. What travels is one edge a component and
    task. Each round at least halves the components.
    """
    points = written(p.select("id", "vec"), "points")
    distinct = written(points.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"),
                       "distinct")
    copies = points.join(distinct.withColumnRenamed("id", "u"), "vec").where("id <> u").select(
        "u", F.col("id").alias("v"), F.lit(0.0).alias("w"))
    n = distinct.count()
    if n < 2:
        return copies
    index = Index.of(distinct, n, block)
    tree, reach, reach_top = index.tree, index.reach, index.reach_top

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        x, ids = matrix(pdf), pdf["id"].to_numpy()
        root, sure = _settled(_prim(x), clearance(tree, x, int(pdf["leaf"][0]), reach, reach_top))
        w, u, v = np.full(len(ids), np.nan), ids.copy(), ids.copy()
        if sure:
            w[:len(sure)], i, j = (np.array(e) for e in zip(*sure))
            u[:len(sure)], v[:len(sure)] = ids[np.minimum(i, j)], ids[np.maximum(i, j)]
        return pdf[["id", "vec", "leaf"]].assign(c=ids[root], w=w, u=u, v=v)

    kind = p.schema["id"].dataType
    schema = T.StructType([*distinct.schema.fields, T.StructField("leaf", T.IntegerType()),
                           T.StructField("c", kind), T.StructField("w", T.DoubleType()),
                           T.StructField("u", kind), T.StructField("v", kind)])
    leaves = int((index.n > 0).sum())
    local = written(index.table.repartition(tasks_for(leaves, block), "leaf").groupBy("leaf").applyInPandas(
        settle, schema), "settled")
    chosen = copies.unionByName(local.where("w is not null and not isnan(w)").select("u", "v", "w"))
    label = local.select("id", "vec", "leaf", "c")
    for _ in range(MAX_ROUNDS):
        best = lightest_edges(index, label, block)
        if best is None:
            return chosen
        chosen = chosen.unionByName(best.select("u", "v", "w").distinct())
        merged = _merge(best)
        label = written(label.join(merged, "c").select("id", "vec", "leaf", F.col("root").alias("c")),
                        "labels")
    raise RuntimeError("components did not settle")


def lightest_edges(index: Index, label: DataFrame, block: int = BLOCK_ROWS) -> DataFrame | None:
    """``(c, w, u, v, o)``: each component's lightest edge, ties by ends, and where it leads to.

    ``label`` has ``id, vec, leaf, c`` of the points in the index. None if there is one component.
    """
    spark, kind = label.sparkSession, label.schema["c"].dataType
    ends = label.schema["id"].dataType
    edge = T.StructType([T.StructField("c", kind), T.StructField("w", T.DoubleType()),
                         T.StructField("u", ends), T.StructField("v", ends), T.StructField("o", kind)])

    def lightest(found: DataFrame) -> DataFrame:
        return found.groupBy("c").agg(F.min(F.struct("w", "u", "v", "o")).alias("s")).select("c", "s.*")

    held = label.groupBy("leaf").agg(F.min("c").alias("a"), F.max("c").alias("b")).collect()
    whole = {r["leaf"]: r["a"] for r in held if r["a"] == r["b"]}       # leaves of one component
    if len(whole) == len(held) and len(set(whole.values())) < 2:
        return None
    now = replace(index, table=label.withColumns({x: F.lit(0) for x in ("r", "top", "r_top")}))
    inside = spark.createDataFrame([], edge)
    if len(whole) < len(held):
        mixed = [(r["leaf"],) for r in held if r["leaf"] not in whole]
        mixed = label.join(F.broadcast(spark.createDataFrame(mixed, "leaf int")), "leaf")
        inside = written(lightest(now.join(mixed, _lightest, edge, block)), "inside")
    # A component that fills its leaves reaches another in any leaf that isn't its own.
    ways = spark.createDataFrame(_ways(index, whole), T.StructType(edge.fields[:2]))
    limit = inside.select("c", "w").unionByName(ways).groupBy("c").agg(F.min("w").alias("bound"))
    ahead = label.join(limit, "c").withColumn("home", F.col("leaf")).withColumns(
        {x: F.lit(0) for x in ("r", "top", "r_top")})

    def worth(pdf: pd.DataFrame, i: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        c, home = pdf["c"].to_numpy()[i], pdf["home"].to_numpy()[i]
        return np.array([h != x and whole.get(x) != y for h, x, y in zip(
            home.tolist(), leaf.tolist(), c.tolist())], dtype=bool)
    reached = now.join(now.copies(ahead, worth).drop("home"), _lightest, edge, block)
    return written(lightest(inside.unionByName(reached)), "lightest")


def _length(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda x, y: x + y))


def diameters(index: Index, label: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """``(c, most)``: largest distance between two points of each component, by branch and bound.

    A real distance is known first: from the point farthest from the mean to the point farthest from
    it. Only pairs of leaves whose pivots and reaches allow more are looked at. Ties cost nothing,
    as the distance alone is wanted.
    """
    spark = label.sparkSession
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    middle = label.groupBy("c").agg(Summarizer.mean(array_to_vector("vec")).alias("m")).select(
        "c", vector_to_array("m").alias("middle"))
    ends = written(label.join(middle, "c").groupBy("c").agg(
        F.max_by("vec", F.struct(_length("vec", "middle"), "id")).alias("end")), "ends")
    known = written(label.join(ends, "c").groupBy("c").agg(
        F.max(_length("vec", "end")).alias("known")), "known")
    pivots = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(index.tree.pivots)],
        "leaf int, pivot array<double>")
    parts = written(label.join(pivots, "leaf").groupBy("c", "leaf").agg(
        F.count("*").alias("n"), F.max(_length("vec", "pivot")).alias("r"),
        F.first("pivot").alias("pivot")), "parts")
    other = parts.select(*[F.col(x).alias(f"{x}_b") for x in ("c", "leaf", "n", "r", "pivot")])
    pairs = written(parts.join(other, (F.col("c") == F.col("c_b")) & (F.col("leaf") <= F.col("leaf_b")))
                    .join(known, "c").where((_length("pivot", "pivot_b") + F.col("r") + F.col("r_b"))
                                            * (1 + 1e-9) > F.col("known"))
                    .select("c", "leaf", "leaf_b", F.ceil(F.col("n") / block).cast("int").alias("n_a"),
                            F.ceil(F.col("n_b") / block).cast("int").alias("n_b")), "leaf_pairs")

    def side(leaf: str, mine: str, theirs: str) -> DataFrame:
        # Fresh column identities: both sides come from the same tables.
        points = label.select(F.col("leaf").alias(leaf), *[F.col(x).alias(x) for x in ("c", "id", "vec")])
        return (points.join(pairs.select(*[F.col(x).alias(x) for x in pairs.columns]), ["c", leaf])
                .withColumn(mine, F.pmod(F.xxhash64(F.lit(3), "id"), F.col(f"n_{mine}")).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"n_{theirs}") - 1)))
                .groupBy("c", "leaf", "leaf_b", "a", "b"))

    def widest(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame(columns=["c", "most"])
        x, y = matrix(l), matrix(r)
        sq, tol = squared(x, y)
        i, j = np.nonzero(sq >= sq.max() - 4 * tol)
        return pd.DataFrame({"c": l["c"].iloc[:1], "most": exact(x, y, i[:4096], j[:4096]).max()})

    found = side("leaf", "a", "b").cogroup(side("leaf_b", "b", "a")).applyInPandas(
        widest, T.StructType([label.schema["c"], T.StructField("most", T.DoubleType())]))
    return known.withColumnRenamed("known", "most").unionByName(found).groupBy("c").agg(
        F.max("most").alias("most"))


def _ways(index: Index, whole: dict) -> list[tuple]:
    """(component, distance): within it some point of the component surely has a stranger."""
    if not whole:
        return []
    pivots, held = index.tree.pivots, np.flatnonzero(index.n > 0)
    names = list(dict.fromkeys(whole.values()))
    number = {c: i for i, c in enumerate(names)}
    owner = np.array([number[whole[x]] if x in whole else -1 for x in held.tolist()])
    out = np.full(len(names), np.inf)
    mine = np.flatnonzero(owner >= 0)
    for at in range(0, len(mine), 256):
        rows = mine[at:at + 256]
        far = distances(pivots[held[rows]], pivots[held]) + index.reach[held][None, :]
        far += index.reach[held[rows]][:, None]
        far[owner[rows][:, None] == owner[None, :]] = np.inf
        np.minimum.at(out, owner[rows], far.min(1))
    return [(c, float(w)) for c, w in zip(names, out) if np.isfinite(w)]


def linkage_clusters(p: DataFrame, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``(id, component)``: the spanning tree without its k - 1 heaviest edges (ties by ends).

    Exactly k clusters, or one a point where there are fewer points. On a line the tree is the gaps
    between neighbours, so the cuts are found in the order of the points.
    """
    p = written(p.select("id", "vec"), "points")
    cut = clusters_on_line(p, k) if on_line(p) else None
    if cut is not None:
        return cut
    tree = written(spanning_tree(p, block), "tree")
    cut = tree.orderBy(F.col("w").desc(), F.col("u").desc(), F.col("v").desc()).limit(max(0, k - 1))
    kept = tree.join(F.broadcast(cut.select("u", "v")), ["u", "v"], "left_anti")
    return connected_components(p.select("id"), kept.select("u", "v"))


def group_extremes(df: DataFrame, group: str, block: int = BLOCK_ROWS) -> DataFrame:
    """``(g, intra, inter)``: largest distance within each group, smallest to any other (or null)."""
    points = df.select("id", "vec", F.col(group).alias("c"))
    index = Index.of(points, points.count(), block)
    label = index.table.select("id", "vec", "leaf", "c")
    most, near = diameters(index, label, block), lightest_edges(index, label, block)
    least = near.select("c", "w") if near is not None else most.select("c", F.lit(None).cast(
        "double").alias("w"))
    return most.join(least, "c", "left").select(F.col("c").alias("g"), F.col("most").alias("intra"),
                                                F.col("w").alias("inter"))
