"""A two-level tree of pivots whose leaves keep a bounded size, and what may lie near a leaf.

The first level has at most ``TOPS`` pivots. A cell with more points than a block gets pivots of
its own, in proportion to its points, so a leaf holds about a block of them however many points
there are and however they are spread. Counts and pivots come from partial aggregates and from a
hash sample of bounded size; the tree itself never exceeds ``TREE_BYTES`` (beyond that leaves grow,
and the chunks of a join keep its tasks bounded).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

TOPS = 512
LEAVES_A_TOP = 2048
TREE_BYTES = 64 << 20
SLACK = 1e-9

#: Columns that ``place`` adds: leaf and distance to its pivot, the same for the first level.
PLACE = [T.StructField("leaf", T.IntegerType()), T.StructField("r", T.DoubleType()),
         T.StructField("top", T.IntegerType()), T.StructField("r_top", T.DoubleType())]


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vec"].to_numpy()).astype(float)


def squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by inner products and a bound on their rounding error."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    sq = na[:, None] + nb[None, :]
    sq -= (2.0 * a) @ b.T
    return np.maximum(sq, 0.0, out=sq), 1e-11 * float((na.max() if len(na) else 0.0)
                                                      + (nb.max() if len(nb) else 0.0)) + 1e-300


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 100_000):
        part = slice(at, at + 100_000)
        out[part] = np.sqrt(((a[i[part]] - b[j[part]]) ** 2).sum(1))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs of a block; pairs too close for the fast form are recomputed."""
    sq, tol = squared(a, b)
    near = np.flatnonzero(sq < 1e5 * tol)
    out = np.sqrt(sq, out=sq)
    if len(near):
        i, j = np.divmod(near, out.shape[1])
        out[i, j] = exact(a, b, i, j)
    return out


def _plane(d: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Least distance from each row to the points nearest to each pivot, by bisecting planes.

    ``d`` has the rows' distances to the pivots. A point that is nearest to pivot p lies on p's side
    of the plane between p and the row's own nearest pivot.
    """
    between = distances(pivots, pivots)
    np.fill_diagonal(between, np.inf)
    between[between == 0] = np.inf
    home = d.argmin(1)
    own = d[np.arange(len(d)), home]
    return (d * d - (own * own)[:, None]) / (2.0 * between[home])


@dataclass
class Tree:
    tops: np.ndarray
    leaves: list[np.ndarray]

    def __post_init__(self) -> None:
        sizes = [len(x) for x in self.leaves]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.top_of = np.repeat(np.arange(len(sizes)), sizes)
        self.pivots = np.concatenate(self.leaves)

    def __len__(self) -> int:
        return len(self.pivots)

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = distances(x, self.tops)
        top = d.argmin(1)
        leaf, r = np.empty(len(x), dtype="int32"), np.empty(len(x))
        for c in np.unique(top):
            rows = np.flatnonzero(top == c)
            inner = distances(x[rows], self.leaves[c])
            best = inner.argmin(1)
            leaf[rows], r[rows] = self.first[c] + best, inner[np.arange(len(rows)), best]
        return leaf, r, top.astype("int32"), d[np.arange(len(x)), top]

    def place(self, df: DataFrame) -> DataFrame:
        """Add ``leaf, r, top, r_top``."""
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    leaf, r, top, r_top = self.locate(matrix(pdf))
                    yield pdf.assign(leaf=leaf, r=r, top=top, r_top=r_top)

        return df.mapInPandas(run, T.StructType([*df.schema.fields, *PLACE]))

    def replicas(self, df: DataFrame, reach: np.ndarray, reach_top: np.ndarray, keep=None
                 ) -> DataFrame:
        """One copy of each row per leaf that may hold a point within the row's ``bound``.

        ``reach`` and ``reach_top`` are the largest distances of the leaves' (and first-level
        cells') points to their pivots, negative where there are none. ``keep(pdf, rows, leaves)``
        may rule out further copies. A row meets first the ``TOPS`` cells, then only the leaves of
        cells that pass. The columns of ``place`` go, ``leaf`` is the leaf to look into.
        """
        schema = T.StructType([f for f in df.schema.fields if f.name not in (
            "leaf", "r", "top", "r_top", "bound")] + PLACE[:1])
        names = [f.name for f in schema]

        def run(batches):
            for pdf in batches:
                for i, leaf in self._open(pdf, reach, reach_top):
                    if keep is not None and len(i):
                        good = keep(pdf, i, leaf)
                        i, leaf = i[good], leaf[good]
                    if len(i):
                        yield pdf.iloc[i].assign(leaf=leaf.astype("int32"))[names]

        return df.mapInPandas(run, schema)

    def looks(self, df: DataFrame, reach: np.ndarray, reach_top: np.ndarray) -> int:
        """How many rows ``replicas`` would give without ``keep``."""
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"n": [sum(len(i) for i, _ in self._open(pdf, reach, reach_top))]})

        return df.select("vec", "bound").mapInPandas(run, "n long").agg(
            F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _open(self, pdf: pd.DataFrame, reach: np.ndarray, reach_top: np.ndarray):
        """Rows and the leaves that they must look into, by cell of the first level."""
        if not len(pdf):
            return
        x = matrix(pdf)
        limit = pdf["bound"].to_numpy()[:, None] * (1 + SLACK) + SLACK
        d = distances(x, self.tops)
        least = np.maximum(d - reach_top[None, :], _plane(d, self.tops))
        open_ = (least <= limit) & (reach_top >= 0)[None, :]
        for c in np.flatnonzero(open_.any(0)):
            rows = np.flatnonzero(open_[:, c])
            part = slice(self.first[c], self.first[c + 1])
            inner = distances(x[rows], self.leaves[c])
            least_in = np.maximum(inner - reach[part][None, :], _plane(inner, self.leaves[c]))
            i, leaf = np.nonzero((least_in <= limit[rows]) & (reach[part] >= 0)[None, :])
            yield rows[i], leaf + self.first[c]


def build(df: DataFrame, n: int, block: int) -> Tree:
    """A tree for the ``n`` points of ``df`` (read three times: pass a written table)."""
    rows = df.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(min(TOPS, -(-n // block))).select(
        "vec").collect()
    tops = np.unique(np.array([r["vec"] for r in rows], dtype=float), axis=0)

    def counts(batches):
        total = np.zeros(len(tops), dtype="int64")
        for pdf in batches:
            if len(pdf):
                total += np.bincount(distances(matrix(pdf), tops).argmin(1), minlength=len(tops))
        yield pd.DataFrame({"top": np.arange(len(tops), dtype="int32"), "n": total})

    held = np.zeros(len(tops), dtype="int64")
    for r in df.select("vec").mapInPandas(counts, "top int, n long").groupBy("top").agg(
            F.sum("n").alias("n")).collect():
        held[r["top"]] = r["n"]
    size = max(block, -(-n * 8 * tops.shape[1] // TREE_BYTES))
    want = np.where(held > 2 * size, np.minimum(-(-held // size), LEAVES_A_TOP), 0)
    if not want.any():
        return Tree(tops, [t[None] for t in tops])
    share = want / np.maximum(held, 1)

    def sample(batches):
        for pdf in batches:
            if len(pdf):
                top = distances(matrix(pdf), tops).argmin(1)
                hit = pdf["u"].to_numpy() < share[top]
                yield pd.DataFrame({"top": top[hit].astype("int32"), "vec": pdf["vec"][hit]})

    u = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked: dict[int, list] = {}
    for r in df.select("vec", u.alias("u")).mapInPandas(sample, T.StructType([
            T.StructField("top", T.IntegerType()), df.schema["vec"]])).collect():
        picked.setdefault(r["top"], []).append(r["vec"])
    return Tree(tops, [np.unique(np.array(picked[c], dtype=float), axis=0) if c in picked
                       else tops[c:c + 1] for c in range(len(tops))])


def clearance(tree: Tree, x: np.ndarray, leaf: int, reach: np.ndarray, reach_top: np.ndarray
              ) -> np.ndarray:
    """A lower bound on each point's distance to all points outside its ``leaf``."""
    top = tree.top_of[leaf]
    d = distances(x, tree.tops)
    least = np.maximum(d - reach_top[None, :], _plane(d, tree.tops))
    least[:, (reach_top < 0) | (np.arange(len(tree.tops)) == top)] = np.inf
    part = slice(tree.first[top], tree.first[top + 1])
    inner = distances(x, tree.leaves[top])
    least_in = np.maximum(inner - reach[part][None, :], _plane(inner, tree.leaves[top]))
    least_in[:, (reach[part] < 0) | (np.arange(least_in.shape[1]) == leaf - part.start)] = np.inf
    out = np.minimum(least.min(1), least_in.min(1))
    return np.maximum(out * (1 - SLACK) - SLACK, 0.0)
