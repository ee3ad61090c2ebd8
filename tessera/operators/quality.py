"""Quality of a clustering, over points ``(id, vec array<double>, cluster int)``; −1 is noise."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera.functions.ordered import exact_quantiles, most_frequent, unpivot
from tessera.operators.blocks import distance_sums, nearest, radius_links
from tessera.operators.graph import connected_components
from tessera.operators.linkage import group_extremes
from tessera.operators.pivots import distances
from tessera.session import written

CLUSTER_LIMIT = 10_000
"""Cluster statistics are held on the driver; a labelling with more clusters is refused."""


def without_noise(p: DataFrame) -> DataFrame:
    return p.where(F.col("cluster") != -1)


def noise_ratio(p: DataFrame) -> DataFrame:
    return p.agg(F.avg((F.col("cluster") == -1).cast("double")).alias("noise_ratio"))


# ---------------------------------------------------------------- moments

@dataclass
class Moments:
    """Count, mean and sum of squared deviations per cluster and dimension, in label order."""

    labels: list[int]
    n: np.ndarray
    mean: np.ndarray
    ss: np.ndarray

    @property
    def total(self) -> int:
        return int(self.n.sum())

    @property
    def centre(self) -> np.ndarray:
        return (self.n[:, None] * self.mean).sum(0) / self.n.sum()


def moments(p: DataFrame) -> Moments:
    """One grouped pass; sums combine before the shuffle."""
    s = Summarizer.metrics("count", "mean", "variance").summary(F.col("v"))
    rows = (without_noise(p).select("cluster", array_to_vector("vec").alias("v"))
            .groupBy("cluster").agg(s.alias("s")).limit(CLUSTER_LIMIT + 1).collect())
    if len(rows) > CLUSTER_LIMIT:
        raise ValueError(f"more than {CLUSTER_LIMIT} clusters")
    rows.sort(key=lambda r: r["cluster"])
    n = np.array([r["s"]["count"] for r in rows], dtype=float)
    mean = np.array([r["s"]["mean"].toArray() for r in rows])
    var = np.array([r["s"]["variance"].toArray() for r in rows])
    return Moments([r["cluster"] for r in rows], n, mean,
                   var * np.maximum(n - 1, 0)[:, None] if len(rows) else var)


def calinski_harabasz(m: Moments) -> float:
    k, n = len(m.labels), m.total
    between = float((m.n[:, None] * (m.mean - m.centre) ** 2).sum())
    within = float(m.ss.sum())
    if k < 2 or n <= k:
        return 0.0
    return 1.0 if within == 0 else (between / (k - 1)) / (within / (n - k))


def _per_batch(p: DataFrame, m: Moments, schema: str,
               fn: Callable[[np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """Map batches of ``(vec, position of the cluster)`` to small partial results."""
    where = {c: i for i, c in enumerate(m.labels)}

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield fn(np.stack(pdf["vec"].to_numpy()).astype(float),
                         pdf["cluster"].map(where).to_numpy())

    return without_noise(p).select("vec", "cluster").mapInPandas(run, schema)


def davies_bouldin(p: DataFrame, m: Moments) -> float:
    centres = m.mean

    def spread(x: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        d = np.sqrt(((x - centres[c]) ** 2).sum(1))
        k = len(centres)
        return pd.DataFrame({"c": np.arange(k, dtype="int32"),
                             "d": np.bincount(c, weights=d, minlength=k)})

    rows = _per_batch(p, m, "c int, d double", spread).groupBy("c").agg(F.sum("d").alias("d"))
    total = np.zeros(len(m.labels))
    for r in rows.collect():
        total[r["c"]] = r["d"]
    s = total / m.n
    worst = centre_pairs(centres, s).agg(F.avg("ratio").alias("ratio"), F.max("far").alias("far"))
    row = worst.first()
    if np.allclose(s, 0) or np.allclose(row["far"] or 0.0, 0):
        return 0.0
    return float(row["ratio"])


CENTRES_AT_ONCE = 256


def centre_pairs(centres: np.ndarray, spread: np.ndarray | None = None) -> DataFrame:
    """``(c, ratio, total, far)`` for each centre: largest (spread + other's spread) / distance over
    the others, and the sum and the largest of the distances to them.

    Centres are few enough to travel with the tasks; each task holds its own against all in one
    matrix of distances and hands on one row a centre.
    """
    spark, k = SparkSession.getActiveSession(), len(centres)
    s = np.zeros(k) if spread is None else spread

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), CENTRES_AT_ONCE):
                i = pdf["id"].to_numpy()[at:at + CENTRES_AT_ONCE]
                d = distances(centres[i], centres)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(d > 0, (s[i][:, None] + s[None, :]) / d, 0.0)
                ratio[np.arange(len(i)), i] = 0.0
                yield pd.DataFrame({"c": i, "ratio": ratio.max(1), "total": d.sum(1), "far": d.max(1)})

    return spark.range(0, k, 1, max(1, -(-k // CENTRES_AT_ONCE))).mapInPandas(
        run, "c long, ratio double, total double, far double")


def _mean_apart(m: Moments) -> float:
    """Mean distance between two centres."""
    k = len(m.labels)
    return float(centre_pairs(m.mean).agg(F.sum("total")).first()[0]) / (k * (k - 1))


# ---------------------------------------------------------------- silhouette

def silhouette(p: DataFrame, method: str = "euclidean", m: Moments | None = None) -> DataFrame:
    """One row ``(silhouette, method)`` over the points that are not noise.

    ``euclidean`` averages true distances, which costs every pair (computed in blocks that hand on
    one sum per point and cluster). ``squared`` averages squared distances, which cluster moments
    give exactly in one pass; it is another number. The caller chooses, whatever the size, and the
    row says which was used.
    """
    good = without_noise(p)
    if method == "squared":
        return _squared_silhouette(p, m or moments(p))
    sizes = good.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = distance_sums(good, "cluster").join(
        sizes.select(F.col("cluster").alias("other"), "n"), "other")
    own = F.col("cluster") == F.col("other")
    per = sums.groupBy("id").agg(
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.when((F.col("n") == 1) | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0
               ).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette")).withColumn(
        "method", F.lit("euclidean"))


def penalised_silhouette(p: DataFrame, method: str = "euclidean") -> DataFrame:
    """One row ``(silhouette, method)``: the silhouette times the share of rows that aren't noise."""
    share = 1.0 - float(noise_ratio(p).first()[0])
    return silhouette(p, method).withColumn("silhouette", F.col("silhouette") * share)


def _squared_silhouette(p: DataFrame, m: Moments) -> DataFrame:
    centres, n, v = m.mean, m.n, m.ss.sum(1) / m.n

    def part(x: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        d = ((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T)
        mean = np.maximum(d, 0.0) + v[None, :]
        at = np.arange(len(x))
        a = mean[at, c] * n[c] / np.maximum(n[c] - 1, 1)
        mean[at, c] = np.inf
        b = mean.min(1)
        top = np.maximum(a, b)
        s = np.where((n[c] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top))
        return pd.DataFrame({"s": [float(s.sum())], "n": [len(x)]})

    rows = _per_batch(p, m, "s double, n long", part)
    return rows.agg((F.sum("s") / F.sum("n")).alias("silhouette")).withColumn(
        "method", F.lit("squared"))


# ---------------------------------------------------------------- neighbourhood measures

PURITY_NEIGHBOURS = 7


def neighbour_table(p: DataFrame) -> DataFrame:
    """Neighbours of every point, written once, to be shared by many labellings of one view."""
    bare = p.select("id", "vec")
    return written(nearest(bare, bare, PURITY_NEIGHBOURS, skip_self=True), "neighbours")


def _neighbours_of(p: DataFrame, table: DataFrame | None, k: int) -> DataFrame:
    """``(own_cluster, cluster, dist, place)`` of each neighbour pair."""
    if table is None:
        good = without_noise(p)
        return nearest(good, good, k, skip_self=True, carry="cluster", keep="cluster")
    lab = p.select("id", "cluster")
    return (table.where(F.col("place") <= k)
            .join(lab.withColumnRenamed("cluster", "own_cluster"), "id")
            .join(lab.select(F.col("id").alias("nbr"), "cluster"), "nbr"))


def purity(p: DataFrame, table: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """One row ``(purity)``: share of the nearest neighbours in the point's own cluster."""
    n = without_noise(p).count() if n is None else n
    k = min(PURITY_NEIGHBOURS + 1, n - 1) - 1
    if k < 1:
        return p.sparkSession.createDataFrame([(1.0,)], "purity double")
    return _neighbours_of(p, table, k).agg(F.avg(
        (F.col("cluster") == F.col("own_cluster")).cast("double")).alias("purity"))


def link_radius(near: DataFrame, rows: int | None = None) -> float:
    """Three times the median distance to the nearest neighbour."""
    row = exact_quantiles(near.where(F.col("place") == 1), ["dist"], [0.5], rows=rows).first()
    median = row["quantiles"][0] if row else 0.0
    return 3.0 * (median if median > 1e-8 else 1e-4)


def connectivity(p: DataFrame, radius: float | None = None) -> DataFrame:
    """One row ``(connectivity)``: mean over clusters of .85^(major components − 1).

    Points closer than three median neighbour distances are linked within their cluster; a
    component is major from 3 points and 5 % of the cluster.
    """
    good = without_noise(p)
    if radius is None:
        bare = good.select("id", "vec")
        radius = link_radius(nearest(bare, bare, 1, skip_self=True), bare.count())
    comp = connected_components(good.select("id"), radius_links(good, radius, by="cluster"))
    sizes = (good.select("id", "cluster").join(comp, "id").groupBy("cluster", "component")
             .agg(F.count("*").alias("n")))
    total = sizes.groupBy("cluster").agg(F.sum("n").alias("size"))
    per = sizes.join(total, "cluster").groupBy("cluster").agg(F.count_if(
        (F.col("n") >= 3) & (F.col("n") >= F.ceil(F.col("size") * 0.05))).alias("major"),
        F.max("size").alias("size"))
    value = F.when((F.col("size") < 3) | (F.col("major") <= 1), 1.0).otherwise(
        F.pow(F.lit(0.85), F.col("major") - 1))
    return per.agg(F.coalesce(F.avg(value), F.lit(1.0)).alias("connectivity"))


def view_range(p: DataFrame) -> float:
    """Length of the vector of 5–95 % ranges over all points, noise included."""
    d = p.select(F.size("vec").alias("d")).first()["d"]
    wide = p.select(*[F.col("vec")[i].alias(f"v{i}") for i in range(d)])
    rows = exact_quantiles(wide, wide.columns, [0.05, 0.95]).collect()
    return float(np.sqrt(sum((r["quantiles"][1] - r["quantiles"][0]) ** 2 for r in rows)))


def separation(m: Moments, length: float) -> float:
    if len(m.labels) < 2 or length == 0:
        return 0.0
    return float(np.clip(2.0 * _mean_apart(m) / length, 0.0, 1.0))


# ---------------------------------------------------------------- agreement of labellings

def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _ari(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adjusted Rand index per ``by`` from ``(by…, a, b, n)``.

    Cells, row totals and column totals are summed side by side in one grouped pass.
    """
    by = list(by)
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    sides = F.array(F.struct(F.lit("ab").alias("side"), a.alias("p"), b.alias("q"), "n"),
                    F.struct(F.lit("a").alias("side"), a.alias("p"), F.lit("").alias("q"), "n"),
                    F.struct(F.lit("b").alias("side"), F.lit("").alias("p"), b.alias("q"), "n"))
    sums = cells.select(*by, F.inline(sides)).groupBy(*by, "side", "p", "q").agg(
        F.sum("n").alias("n"))

    def total(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, _pairs(F.col("n"))).otherwise(0.0))

    t = sums.groupBy(*by).agg(total("ab").alias("sab"), total("a").alias("sa"),
                              total("b").alias("sb"), F.sum(F.when(
                                  F.col("side") == "ab", F.col("n"))).alias("common"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), _pairs(F.col("common")))
    top = (F.col("sa") + F.col("sb")) / 2
    return t.select(*by, "common", F.coalesce(F.try_divide(
        F.col("sab") - expected, top - expected), F.lit(1.0)).alias("ari"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    return _ari(cells, []).select("ari")


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from a hash of the key: the same for any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(2 ** 53))


MIN_COMMON = 10


def stability(p: DataFrame, fit_predict: Callable[[DataFrame], DataFrame], runs: int = 8,
              frac: float = 0.8, seed: int = 42) -> float:
    """Mean ARI over pairs of runs, each refitted on its own hash sample of the rows.

    All labellings meet in one grouped table; all pairs are compared in one pass over it.
    """
    parts = None
    for r in range(runs):
        sample = p.where(uniform(seed + r, F.col("id")) < frac)
        lab = fit_predict(sample).select("id", F.lit(r).alias("run"), "cluster")
        parts = lab if parts is None else parts.unionByName(lab)
    wide = parts.groupBy("id").agg(*[F.max(F.when(F.col("run") == r, F.col("cluster")))
                                     .alias(f"r{r}") for r in range(runs)])
    cells = F.array(*[F.struct(F.lit(f"{i}-{j}").alias("pair"), F.col(f"r{i}").alias("a"),
                               F.col(f"r{j}").alias("b"))
                      for i, j in combinations(range(runs), 2)])
    counts = (wide.select(F.inline(cells)).where("a IS NOT NULL AND b IS NOT NULL")
              .groupBy("pair", "a", "b").agg(F.count("*").alias("n")))
    row = _ari(counts, ["pair"]).where(F.col("common") >= MIN_COMMON).agg(F.avg("ari")).first()
    return float(row[0] or 0.0)


SAMPLE_ROWS = 1_000          # rows of each set that starting centres are drawn from
GAP_WIDTH = 50               # columns above which the gap is taken in the space of components


def _spread_starts(x: np.ndarray, k: int, starts: int, rng: np.random.Generator) -> np.ndarray:
    """Centres drawn far apart: each in proportion to the squared distance to those before."""
    out = np.empty((starts, k, x.shape[1]))
    for s in range(starts):
        out[s, 0] = x[rng.integers(len(x))]
        near = ((x - out[s, 0]) ** 2).sum(1)
        for j in range(1, k):
            total = near.sum()
            at = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
            out[s, j] = x[at]
            near = np.minimum(near, ((x - out[s, j]) ** 2).sum(1))
    return out


def inertias(sets: DataFrame, centres: np.ndarray, max_iter: int = 100, tol: float = 1e-4
             ) -> np.ndarray:
    """Inertia that k-means reaches on each set from each of its starts.

    ``sets`` has ``part`` (the set's number) and ``vec``; ``centres`` is sets × starts × k × width.
    A round scores all starts of all sets in one pass over the rows; a task hands on counts, sums and
    costs. Starts whose centres have come to rest are no longer computed.
    """
    parts, starts, k, width = centres.shape
    centres, cost = centres.copy(), np.full((parts, starts), np.inf)
    live = np.ones((parts, starts), dtype=bool)

    def run(batches, centres, live):
        n, sums = np.zeros((parts, starts, k)), np.zeros((parts, starts, k, width))
        cost = np.zeros((parts, starts))
        for pdf in batches:
            if not len(pdf):
                continue
            x, part = np.stack(pdf["vec"].to_numpy()).astype(float), pdf["part"].to_numpy()
            for r in np.unique(part):
                mine = x[part == r]
                for s in np.flatnonzero(live[r]):
                    d = distances(mine, centres[r, s])
                    c = d.argmin(1)
                    n[r, s] += np.bincount(c, minlength=k)
                    one = np.zeros((len(mine), k))
                    one[np.arange(len(mine)), c] = 1.0
                    sums[r, s] += one.T @ mine
                    cost[r, s] += float((d[np.arange(len(mine)), c] ** 2).sum())
        flat = np.concatenate([cost.ravel(), n.ravel(), sums.ravel()])
        hit = np.flatnonzero(flat)
        yield pd.DataFrame({"i": hit, "v": flat[hit]})

    for _ in range(max_iter + 1):
        flat = np.zeros(parts * starts * (1 + k + k * width))
        for row in sets.select("part", "vec").mapInPandas(
                lambda b, c=centres, v=live: run(b, c, v), "i long, v double").groupBy("i").agg(
                F.sum("v").alias("v")).collect():
            flat[row["i"]] = row["v"]
        got, n, sums = np.split(flat, [parts * starts, parts * starts * (1 + k)])
        n, sums = n.reshape(parts, starts, k), sums.reshape(parts, starts, k, width)
        cost = np.where(live, got.reshape(parts, starts), cost)
        new = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], centres)
        moved = np.sqrt(((new - centres) ** 2).sum(-1)).max(-1)
        centres = np.where(live[..., None, None], new, centres)
        live = live & (moved > tol)
        if not live.any():
            break
    return cost


def gap_statistic(p: DataFrame, k: int, refs: int = 5, seed: int = 42, inits: int = 10) -> float:
    """Mean log inertia of uniform reference sets minus the log inertia of the points.

    Above ``GAP_WIDTH`` columns both are taken in the space of that many principal components.
    References fill the box of the points in that space. Each set's inertia is the best of ``inits``
    starts; the points and all references are clustered together, a pass a round.
    """
    if k <= 1:
        return 0.0
    space = p.select("id", "vec")
    if p.select(F.size("vec").alias("d")).first()["d"] > GAP_WIDTH:
        rows = space.select("id", array_to_vector("vec").alias("features"))
        space = PCA(k=GAP_WIDTH, inputCol="features", outputCol="pc").fit(rows).transform(rows).select(
            "id", vector_to_array("pc").alias("vec"))
    space = written(space, "space")
    d = space.select(F.size("vec").alias("d")).first()["d"]
    ends = space.agg(*[F.min(F.col("vec")[i]).alias(f"a{i}") for i in range(d)],
                     *[F.max(F.col("vec")[i]).alias(f"b{i}") for i in range(d)]).first()
    low = F.array(*[F.lit(ends[f"a{i}"]) for i in range(d)])
    wide = F.array(*[F.lit(max(ends[f"b{i}"] - ends[f"a{i}"], 1e-9)) for i in range(d)])
    drawn = space.select("id", F.explode(F.sequence(F.lit(1), F.lit(refs))).alias("part")).select(
        "part", "id", F.zip_with(F.zip_with(F.sequence(F.lit(0), F.lit(d - 1)), wide, lambda i, w: w * (
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "part", i), 11) / F.lit(float(2 ** 53)))),
            low, lambda x, a: x + a).alias("vec"))
    sets = written(space.select(F.lit(0).alias("part"), "id", "vec").unionByName(drawn), "gap_sets")
    order = W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    some = sets.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= SAMPLE_ROWS).orderBy("part", "place").select("part", "vec").collect()
    rng = np.random.default_rng(seed)
    begin = np.stack([_spread_starts(np.array([r["vec"] for r in some if r["part"] == part], dtype=float),
                                     k, inits, rng) for part in range(refs + 1)])
    logs = np.log(np.maximum(inertias(sets, begin).min(1), 1e-300))
    return float(logs[1:].mean() - logs[0])


# ---------------------------------------------------------------- unified score

# Weights of the unified score; gap joins only when known.
UNIFIED_WEIGHTS = {"silhouette": 0.25, "davies_bouldin": 0.15, "overlap_score": 0.15,
                   "calinski_harabasz": 0.15, "centroid_sep": 0.15, "stability": 0.10}
GAP_WEIGHT = 0.05

# Weights of the post-hoc score.
POSTHOC_WEIGHTS = {"silhouette": 0.15, "calinski_harabasz": 0.10, "stability": 0.50,
                   "gap_score": 0.05, "overlap_score": 0.15, "centroid_sep": 0.05}


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def unified_columns(runs: DataFrame, strong_overlap: bool = True) -> DataFrame:
    """Add the parts and the unified score to rows of raw measures.

    Rows need ``silhouette, dbi, ch, purity, separation, connectivity, stability, gap,
    n_clusters, noise_ratio, max_ratio, min_ratio``; a whole leaderboard is scored at once.
    """
    c = F.col
    sil = F.when(_known(c("silhouette")), c("silhouette")).otherwise(0.0)
    dbi = F.when(_known(c("dbi")) & (c("dbi") >= 0), 1 / (1 + c("dbi"))).otherwise(0.0)
    ch = F.when(_known(c("ch")) & (c("ch") >= 0), F.log1p("ch") / (F.log1p("ch") + 2)).otherwise(
        0.0)
    has_gap = _known(c("gap"))
    gap = F.when(has_gap, _clip(F.tanh(c("gap") / 3), 0.0, 1.0)).otherwise(0.0)
    stab = F.when(_known(c("stability")), _clip(c("stability"), 0.0, 1.0)).otherwise(0.0)
    parts = {"f_silhouette": sil, "f_davies_bouldin": dbi, "f_calinski_harabasz": ch,
             "f_stability": stab, "f_gap_score": gap, "f_overlap_score": c("purity"),
             "f_centroid_sep": c("separation")}
    k = c("n_clusters")
    penalties = {
        "m_noise_penalty": _clip(1 - c("noise_ratio"), 0.0, 1.0),
        "m_separation_penalty": F.when(sil > 0.1, 1.0).otherwise(
            F.greatest(F.lit(0.01), sil) / 0.1),
        "m_k_penalty": F.when(k == 2, 0.95).when(k.between(3, 7), 1.0).otherwise(
            F.exp(-0.02 * F.greatest(F.lit(0), k - 7))),
        "m_merge_multiplier": c("purity") if strong_overlap else F.sqrt("purity"),
        "m_balance_penalty": F.when(c("max_ratio") <= 0.90, 1.0).otherwise(
            _clip(1 - 1.5 * (c("max_ratio") - 0.90), 0.5, 1.0)),
        "m_micro_penalty": F.when(c("min_ratio") >= 0.01, 1.0).otherwise(
            _clip(c("min_ratio") / 0.01, 0.75, 1.0)),
        "m_connectivity_penalty": c("connectivity")}
    out = runs.withColumns({**parts, **penalties})
    base = sum((F.lit(w) * (F.greatest(F.lit(0.0), c("f_silhouette")) if n == "silhouette"
                            else c(f"f_{n}")) for n, w in UNIFIED_WEIGHTS.items()), F.lit(0.0))
    weight = F.lit(sum(UNIFIED_WEIGHTS.values())) + F.when(has_gap, GAP_WEIGHT).otherwise(0.0)
    base = (base + F.when(has_gap, GAP_WEIGHT * c("f_gap_score")).otherwise(0.0)) / weight
    product = F.lit(1.0)
    for name in penalties:
        product = product * c(name)
    score = F.when((c("noise_ratio") > 0.5) | (k < 2), 0.0).otherwise(
        _clip(_clip(base * 1.2, 0.0, 1.0) * product, 0.0, 1.0))
    return out.withColumn("unified_score", score)


@dataclass
class View:
    """What many labellings of the same points share: range and neighbours."""

    points: DataFrame
    length: float
    neighbours: DataFrame
    radius: float

    @staticmethod
    def of(points: DataFrame) -> "View":
        points = points.select("id", "vec")
        near = neighbour_table(points)
        return View(points, view_range(points), near, link_radius(near))


def measures(p: DataFrame, view: View | None = None, stability_value: float = 0.0,
             gap: float | None = None, method: str = "euclidean") -> dict:
    """Raw measures of one labelling; zeros where a labelling cannot be scored."""
    counts = {r["cluster"]: r["n"] for r in p.groupBy("cluster").agg(
        F.count("*").alias("n")).limit(CLUSTER_LIMIT + 2).collect()}
    if len(counts) > CLUSTER_LIMIT + 1:
        raise ValueError(f"more than {CLUSTER_LIMIT} clusters")
    total = sum(counts.values())
    noise = counts.pop(-1, 0)
    good = total - noise
    out = {"n_clusters": len(counts), "noise_ratio": noise / total if total else 0.0,
           "max_ratio": max(counts.values()) / good if good else 0.0,
           "min_ratio": min(counts.values()) / good if good else 0.0,
           "silhouette": 0.0, "silhouette_method": "none", "dbi": 0.0, "ch": 0.0, "purity": 1.0,
           "separation": 0.0, "connectivity": 1.0, "stability": float(stability_value),
           "gap": None if gap is None else float(gap)}
    if len(counts) < 2 or out["noise_ratio"] > 0.5:
        return out
    m = moments(p)
    shared = view if noise == 0 else None  # neighbours change when noise is left out
    sil = silhouette(p, method, m).first()
    out.update(
        silhouette=float(sil["silhouette"]), silhouette_method=sil["method"],
        dbi=davies_bouldin(p, m), ch=calinski_harabasz(m),
        purity=float(purity(p, shared and shared.neighbours, good).first()[0]),
        separation=separation(m, view.length if view else view_range(p)),
        connectivity=float(connectivity(p, shared and shared.radius).first()[0]))
    return out


MEASURE_SCHEMA = ("n_clusters int, noise_ratio double, max_ratio double, min_ratio double, "
                  "silhouette double, silhouette_method string, dbi double, ch double, "
                  "purity double, separation double, connectivity double, stability double, "
                  "gap double")


def unified_score(p: DataFrame, view: View | None = None, stability_value: float = 0.0,
                  gap: float | None = None, strong_overlap: bool = True,
                  method: str = "euclidean") -> DataFrame:
    """One row with raw measures, parts, penalties and ``unified_score``."""
    row = measures(p, view, stability_value, gap, method)
    names = [f.split()[0] for f in MEASURE_SCHEMA.split(", ")]
    one = p.sparkSession.createDataFrame([tuple(row[n] for n in names)], MEASURE_SCHEMA)
    return unified_columns(one, strong_overlap)


def posthoc_score(p: DataFrame, stability_value: float = 0.0, gap: float | None = None,
                  strong_overlap: bool = False) -> dict[str, float]:
    """The alternative score: misassignment to centroids and intra/inter ratio as overlap."""
    good = without_noise(p)
    m = moments(p)
    k = len(m.labels)
    if k < 2:
        return {"score": -1.0}
    noise = float(noise_ratio(p).first()[0])
    sil = float(silhouette(p, "euclidean").first()[0])
    centres = m.mean

    def missed(x: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        d = distances(x, centres)
        return pd.DataFrame({"bad": [int((d.argmin(1) != c).sum())], "n": [len(x)]})

    bad = _per_batch(p, m, "bad long, n long", missed).agg(
        (F.sum("bad") / F.sum("n")).alias("r")).first()["r"]
    per = group_extremes(good, "cluster")
    merge = per.where("inter > 1e-6").agg(F.avg(F.least(
        F.lit(1.0), F.col("intra") / F.col("inter")))).first()[0] or 0.0
    overlap = float(np.clip(1 - (0.5 * bad + 0.5 * merge), 0.0, 1.0))
    log_ch = np.log1p(calinski_harabasz(m))
    parts = {"silhouette": sil, "calinski_harabasz": log_ch / (log_ch + 5.0),
             "stability": float(np.clip(stability_value, 0.0, 10.0)) * 100,
             "gap_score": float(np.tanh(gap / 3)) if gap is not None else 0.0,
             "overlap_score": overlap,
             "centroid_sep": float(np.tanh(_mean_apart(m)))}
    factors = {"noise_penalty": 1 - 0.25 * noise,
               "separation_penalty": 1.0 if sil > 0.2 else sil / 0.2,
               "k_penalty": 1.0 if k <= 10 else 10 / k,
               "merge_multiplier": overlap ** 3 if strong_overlap else overlap}
    score = sum(POSTHOC_WEIGHTS[n] * v for n, v in parts.items()) * float(
        np.prod(list(factors.values())))
    return {n: float(v) for n, v in {"score": score, **parts, **factors}.items()}


# ---------------------------------------------------------------- statistics and plot tables

def cluster_statistics(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """``(cluster, column, mean, median, mode, min, max, std, var, count)``, sample std and var."""
    long = unpivot(df, cols, [cluster], cast="double").where(F.col("value").isNotNull())
    base = long.groupBy(cluster, "column").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev("value").alias("std"), F.variance("value").alias("var"),
        F.count("value").alias("count"))
    mode = most_frequent(df, cols, [cluster], cast="double").withColumnRenamed("value", "mode")
    median = exact_quantiles(df, cols, [0.5], [cluster]).select(
        cluster, "column", F.col("quantiles")[0].alias("median"))
    return base.join(mode, [cluster, "column"]).join(median, [cluster, "column"])


def plot_table(p: DataFrame) -> DataFrame:
    """Long plot table ``(cluster_name, x, y)`` over the 2-D view."""
    return p.select(F.concat(F.lit("cluster_"), "cluster").alias("cluster_name"),
                    F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def centroids(p: DataFrame) -> DataFrame:
    """``(cluster_name, centroid array<double>)``, noise included under its own name."""
    s = Summarizer.mean(F.col("v"))
    return (p.select("cluster", array_to_vector("vec").alias("v")).groupBy("cluster")
            .agg(s.alias("m")).select(F.concat(F.lit("cluster_"), "cluster")
                                      .alias("cluster_name"),
                                      vector_to_array("m").alias("centroid")))
