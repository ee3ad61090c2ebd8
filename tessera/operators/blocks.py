"""Distance joins in bounded blocks.

Reference points are assigned to the leaves of a pivot tree. A query point is sent to a leaf only if
the triangle inequality or the bisecting plane between two pivots lets one of its points lie within
the query's own bound: the radius asked for, or the k-th distance found in the query's home leaf. So
the answer is exact, each reference point stays in one place and a query point goes to the few
leaves around it. Both sides of a leaf are hashed into chunks of bounded size; one task sees one
chunk of each side, however large the leaf, and hands on a result that is bounded per point, never
the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessera.operators.line import nearest_on_line, on_line
from tessera.operators.pivots import (Tree, build, distances as _distances, exact as _exact,
                                      matrix as _matrix, squared as _squared)
from tessera.session import written

BLOCK_ROWS = 2048
SIDES = 12                   # chunks of a side where every pair is looked at
TILES = 32                   # blocks that such a chunk may hold
TASKS = 2_000                # tasks of a join, at most
PAIRS_A_TASK = 1 << 21       # distances for which a task is worth its while

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def points(df: DataFrame, key: str, vec: str, extra: Sequence[str] = ()) -> DataFrame:
    """The shape every distance operator takes: ``(id, vec array<double>, extra…)``."""
    return df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"), *extra)


@dataclass
class Index:
    """Reference points in the leaves of a tree, with each leaf's size and reach."""

    tree: Tree
    table: DataFrame
    n: np.ndarray
    reach: np.ndarray
    reach_top: np.ndarray

    @staticmethod
    def of(refs: DataFrame, n: int, block: int) -> Index:
        tree = build(refs := written(refs, "points"), n, block)
        table = written(tree.place(refs), "placed")
        held = np.zeros(len(tree), dtype="int64")
        reach, reach_top = np.full(len(tree), -1.0), np.full(len(tree.tops), -1.0)
        for row in table.groupBy("leaf").agg(F.count("*").alias("n"), F.max("r").alias("r"),
                                             F.max("r_top").alias("t")).collect():
            held[row["leaf"]], reach[row["leaf"]] = row["n"], row["r"]
            top = tree.top_of[row["leaf"]]
            reach_top[top] = max(reach_top[top], row["t"])
        return Index(tree, table, held, reach, reach_top)

    def copies(self, queries: DataFrame, keep=None) -> DataFrame:
        """The rows of ``queries`` (with ``bound``) for each leaf that they must look into."""
        return written(self.tree.replicas(queries, self.reach, self.reach_top, keep), "copies")

    def promised(self, want: int) -> np.ndarray:
        """A distance from each leaf's pivot within which there are ``want`` points, by whole leaves.

        For leaves with fewer points than that; others get infinity, their own points say more.
        """
        out = np.full(len(self.tree), np.inf)
        some = np.flatnonzero(self.n > 0)
        few = np.flatnonzero(self.n < want)
        for at in range(0, len(few) if self.n.sum() >= want else 0, 256):
            mine = few[at:at + 256]
            far = _distances(self.tree.pivots[mine], self.tree.pivots[some]) + self.reach[some]
            order = far.argsort(axis=1)
            enough = (self.n[some][order].cumsum(axis=1) >= want).argmax(axis=1)
            rows = np.arange(len(mine))
            out[mine] = far[rows, order[rows, enough]]
        return out

    def join(self, queries: DataFrame, kernel: Kernel, schema: str | T.StructType, block: int
             ) -> DataFrame:
        """Run the kernel over the chunk pairs of each leaf; ``queries`` has ``leaf``."""
        counts = [(r["leaf"], -(-r["n"] // block), -(-int(self.n[r["leaf"]]) // block))
                  for r in queries.groupBy("leaf").agg(F.count("*").alias("n")).collect()
                  if self.n[r["leaf"]]]
        chunks = queries.sparkSession.createDataFrame(counts, "leaf int, n_a int, n_b int")
        return _meet(queries, self.table.drop("r", "top", "r_top"), chunks, kernel, schema,
                     tasks_for(sum(a * b for _, a, b in counts), block))


def tasks_for(groups: int, block: int) -> int:
    """Tasks for so many groups of about ``block`` squared distances each. Much work on few rows: by
    the size of what they read, Spark would merge them into few tasks. Groups of usual size get two
    tasks each, so that few of them share one."""
    return min(1 + groups * block * block // PAIRS_A_TASK, TASKS)


def _meet(queries: DataFrame, refs: DataFrame, chunks: DataFrame, kernel: Kernel,
          schema: str | T.StructType, tasks: int) -> DataFrame:
    names = [f.name for f in schema] if isinstance(schema, T.StructType) else None

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame(columns=names or [c.split()[0] for c in schema.split(",")])
        return kernel(l, r)

    # Fresh column identities: both sides may come from one table.
    refs = refs.select(*[F.col(c).alias(c) for c in refs.columns])
    by = ("leaf", "a", "b")
    left = _chunked(queries, chunks, "a", "b").repartition(tasks, *by).groupBy(*by)
    return left.cogroup(_chunked(refs, chunks, "b", "a").repartition(tasks, *by).groupBy(*by)
                        ).applyInPandas(run, schema)


def _chunked(df: DataFrame, chunks: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Hash rows of a leaf into its chunks and repeat them for each chunk of the other side.

    ``chunks`` has ``leaf`` and the numbers of chunks ``n_<side>``: at most one row a leaf.
    """
    return (df.join(F.broadcast(chunks), "leaf")
            .withColumn(mine, F.pmod(F.xxhash64(F.lit(3), "id"), F.col(f"n_{mine}")).cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"n_{theirs}") - 1)))
            .drop(f"n_{mine}", f"n_{theirs}"))


def _wide(n: int, block: int) -> int:
    """Rows of a chunk where all chunks meet: a fixed number of chunks, so what travels grows with
    the rows, until a chunk holds ``TILES`` blocks."""
    return min(max(block, -(-n // SIDES)), TILES * block)


def _tiled(kernel: Kernel, combine: Callable[[pd.DataFrame], pd.DataFrame], block: int) -> Kernel:
    """The kernel over the blocks of two chunks; ``combine`` folds what the rows of a block got."""
    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(l) <= block and len(r) <= block:
            return kernel(l, r)
        parts = [r.iloc[b:b + block] for b in range(0, len(r), block)]
        return pd.concat([combine(pd.concat([kernel(l.iloc[a:a + block], x) for x in parts],
                                            ignore_index=True))
                          for a in range(0, len(l), block)], ignore_index=True)
    return run


def _whole(queries: DataFrame, refs: DataFrame, kernel: Kernel, schema: str | T.StructType,
           block: int, n_s: int, combine=None, large: bool = False) -> DataFrame:
    """Every chunk of one side with every chunk of the other; ``large`` chunks for a kernel that goes
    through them in ``tiles`` itself."""
    n_q = n_s if queries is refs else queries.count()
    rows_q, rows_s = ((_wide(n_q, block), _wide(n_s, block)) if combine or large else (block, block))
    n_a, n_b = max(1, -(-n_q // rows_q)), max(1, -(-n_s // rows_s))
    chunks = refs.sparkSession.createDataFrame([(0, n_a, n_b)], "leaf int, n_a int, n_b int")
    return _meet(queries.withColumn("leaf", F.lit(0)), refs.withColumn("leaf", F.lit(0)), chunks,
                 _tiled(kernel, combine, block) if combine else kernel, schema,
                 # Tasks without a group cost their start: three for each leave few groups together.
                 min(tasks_for(n_a * n_b, max(rows_q, rows_s)), 3 * n_a * n_b))


def summed(*by: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Adds up the other columns of rows with equal ``by``."""
    return lambda pdf: pdf.groupby(list(by), as_index=False, sort=False, dropna=False).sum()


def block_join(queries: DataFrame, refs: DataFrame, kernel: Kernel, schema: str | T.StructType,
               radius: float | None = None, block: int = BLOCK_ROWS, combine=None,
               large: bool = False) -> DataFrame:
    """Run ``kernel(query chunk, reference chunk)`` over all chunk pairs that can matter.

    Pass ``radius`` to leave out pairs that are provably farther apart; without it every pair is
    seen. A query point may meet several chunks: the caller combines its results. With ``combine``,
    which folds the rows that a kernel gave in the same way, all pairs are seen in larger chunks; so
    they are with ``large``, where the kernel gives one row a point whatever the chunk's size.
    """
    n_s = refs.count()
    if n_s <= block or radius is None:
        return _whole(queries, refs, kernel, schema, block, n_s, combine, large)
    index = Index.of(refs, n_s, block)
    q = index.table if queries is refs else queries
    return index.join(index.copies(q.withColumn("bound", F.lit(float(radius)))), kernel, schema,
                      block)


def _key_field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema["id"].dataType)


def nearest(queries: DataFrame, refs: DataFrame, k: int, skip_self: bool = False,
            carry: str | None = None, keep: str | None = None, block: int = BLOCK_ROWS
            ) -> DataFrame:
    """Exact k nearest reference points as ``(id, nbr, dist, place)``; ties go to the lower id.

    ``skip_self`` leaves out the pair of a point with itself; ``carry`` adds a column of the
    reference point, ``keep`` one of the query point.
    """
    fields = [_key_field(queries, "id"), T.StructField("nbr", refs.schema["id"].dataType),
              T.StructField("dist", T.DoubleType())]
    if carry:
        fields.append(T.StructField(carry, refs.schema[carry].dataType))
    if keep:
        fields.append(T.StructField(f"own_{keep}", queries.schema[keep].dataType))

    def kernel(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("id", kind="stable")
        a, b = _matrix(l), _matrix(r)
        rid, lid = r["id"].to_numpy(), l["id"].to_numpy()
        sq, tol = _squared(a, b)
        if skip_self:
            at = pd.Index(rid).get_indexer(lid)
            sq[np.nonzero(at >= 0)[0], at[at >= 0]] = np.inf
        want = min(k, sq.shape[1])
        edge = np.partition(sq, want - 1, axis=1)[:, want - 1]
        i, j = np.nonzero((sq <= (edge + 4 * tol)[:, None]) & np.isfinite(sq))
        d = _exact(a, b, i, j)
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, d = i[place < k], j[place < k], d[place < k]
        out = {"id": lid[i], "nbr": rid[j], "dist": d}
        if carry:
            out[carry] = r[carry].to_numpy()[j]
        if keep:
            out[f"own_{keep}"] = l[keep].to_numpy()[i]
        return pd.DataFrame(out)

    def within(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """What ``kernel`` gives for chunks of any size, but for points beyond the ``bound``."""
        r = r.sort_values("id", kind="stable")
        rid, lid = r["id"].to_numpy(), l["id"].to_numpy()
        own = pd.Index(rid).get_indexer(lid) if skip_self else np.full(len(l), -1)
        i, j, d = closest(_matrix(l), _matrix(r), k, l["bound"].to_numpy(), own)
        out = {"id": lid[i], "nbr": rid[j], "dist": d}
        if carry:
            out[carry] = r[carry].to_numpy()[j]
        if keep:
            out[f"own_{keep}"] = l[keep].to_numpy()[i]
        return pd.DataFrame(out)

    schema = T.StructType(fields)
    best = W.partitionBy("id").orderBy("dist", "nbr")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

    n_s = refs.count()
    if n_s <= block:
        return ranked(_whole(queries, refs, kernel, schema, block, n_s))
    if queries is refs and skip_self and not carry and not keep:
        line = nearest_on_line(refs, k) if on_line(refs) else None
        if line is not None:
            rows, rest = line
            return rows if rest is None else rows.unionByName(nearest(rest, refs, k, True, block=block))
    # First the home leaf; its k-th distance bounds how far a point has to look elsewhere.
    index = Index.of(refs, n_s, block)
    q = index.table if queries is refs else written(index.tree.place(queries), "queries")
    near = written(ranked(index.join(q.drop("r", "top", "r_top"), kernel, schema, block)), "near")
    own = near.where(F.col("place") == k).select("id", F.col("dist").alias("own"))
    promised = index.promised(k + 1)
    short = q.sparkSession.createDataFrame(
        [(int(i), float(promised[i])) for i in np.flatnonzero(index.n < k + 1)],
        "leaf int, promised double")
    far = q.join(own, "id", "left").join(F.broadcast(short), "leaf", "left").withColumn(
        "bound", F.coalesce("own", F.col("r") + F.col("promised"), F.lit(float("inf")))).drop(
        "own", "promised").withColumn("home", F.col("leaf"))
    # In many dimensions little is ruled out: then all pairs in large chunks move fewer rows.
    sides = -(-n_s // _wide(n_s, block))
    far = written(far, "bounds")
    if index.tree.looks(far, index.reach, index.reach_top) > (2 * sides + 1) * far.count():
        mine = far.drop("leaf", "r", "top", "r_top", "home")
        return ranked(_whole(mine, refs, within, schema, block, n_s, large=True))
    copies = index.copies(far, lambda pdf, i, leaf: pdf["home"].to_numpy()[i] != leaf).drop("home")
    return ranked(near.drop("place").unionByName(index.join(copies, kernel, schema, block)))


def closest(a: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray, own: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, distance)``: of the points b not farther than a row's ``bound``, and other than
    its ``own``, the k nearest to each row of a, in order; of equal distances the first.

    The limit of a row sinks with the k-th distance met so far, so few pairs leave a tile.
    """
    tol = 1e-11 * (float((a * a).sum(1).max()) + float((b * b).sum(1).max())) + 1e-300
    limit = bound * bound * (1 + 1e-9) + 4 * tol
    mine = np.flatnonzero(own >= 0)
    found, pool = [], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    settled = 0

    def kept(pool):
        i, j, d = pool
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        full = place == k - 1
        limit[i[full]] = np.minimum(limit[i[full]], d[full] ** 2 * (1 + 1e-9) + 4 * tol)
        return i[place < k], j[place < k], d[place < k]

    for i, j, sq in tiles(a, b):
        if j == 0:
            found.append(kept(pool))
            pool, settled = tuple(x[:0] for x in pool), 0
        rows = slice(i, i + len(sq))
        self_ = mine[np.searchsorted(mine, i):np.searchsorted(mine, i + len(sq))]
        self_ = self_[(own[self_] >= j) & (own[self_] < j + sq.shape[1])]
        sq[self_ - i, own[self_] - j] = np.inf
        hit = (sq <= limit[rows, None]) & (sq < np.inf)
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * k)
        if len(many) and k < sq.shape[1]:
            some = sq[many]
            edge = np.partition(some, k - 1, axis=1)[:, k - 1]
            limit[i + many] = np.minimum(limit[i + many], edge + 4 * tol)
            hit[many] &= some <= limit[i + many, None]
        u, v = np.divmod(np.flatnonzero(hit), sq.shape[1])
        if len(u):
            pool = tuple(np.concatenate(x) for x in zip(pool, (
                i + u, j + v, _exact(a, b, i + u, j + v))))
        if len(pool[0]) > 2 * settled + k * len(sq):
            pool = kept(pool)
            settled = len(pool[0])
    found.append(kept(pool))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    return i, j, d


def neighbour_counts(df: DataFrame, radius: float, block: int = BLOCK_ROWS) -> DataFrame:
    """``(id, n)``: points within ``radius``, the point itself included."""
    def kernel(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        n = _within(_matrix(l), _matrix(r), radius).sum(1)
        return pd.DataFrame({"id": l["id"].to_numpy(), "n": n.astype("int64")})

    schema = T.StructType([_key_field(df, "id"), T.StructField("n", T.LongType())])
    part = block_join(df, df, kernel, schema, radius=radius, block=block)
    return part.groupBy("id").agg(F.sum("n").alias("n"))


def _within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Mask of pairs at most ``radius`` apart; pairs on the edge are decided exactly."""
    sq, tol = _squared(a, b)
    r2 = radius * radius
    mask = sq <= r2
    edge = np.argwhere(np.abs(sq - r2) <= 4 * tol)
    if len(edge):
        mask[edge[:, 0], edge[:, 1]] = _exact(a, b, edge[:, 0], edge[:, 1]) <= radius
    return mask


def radius_links(df: DataFrame, radius: float, by: str | None = None, block: int = BLOCK_ROWS
                 ) -> DataFrame:
    """Edges ``(u, v)`` with the same connected components as the radius graph.

    A chunk pair hands on one star per component it sees, so at most one edge per point, however
    dense the data. With ``by``, only points with equal ``by`` are linked.
    """
    def kernel(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        mask = _within(_matrix(l), _matrix(r), radius)
        if by is not None:
            mask &= l[by].to_numpy()[:, None] == r[by].to_numpy()[None, :]
        lid, rid = l["id"].to_numpy(), r["id"].to_numpy()
        todo = mask.any(1)
        us, vs = [], []
        for start in range(len(lid)):
            if not todo[start]:
                continue
            todo[start] = False
            rows, cols = [start], np.zeros(mask.shape[1], dtype=bool)
            front = np.array([start])
            while len(front):
                new = mask[front].any(0) & ~cols
                cols |= new
                front = np.nonzero(mask[:, new].any(1) & todo)[0] if new.any() else front[:0]
                todo[front] = False
                rows.extend(front.tolist())
            ids = np.concatenate([lid[rows], rid[cols]])
            us.append(ids)
            vs.append(np.full(len(ids), min(ids), dtype=ids.dtype))
        if not us:
            return pd.DataFrame({"u": lid[:0], "v": lid[:0]})
        out = pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})
        return out[out["u"] != out["v"]].drop_duplicates()

    schema = T.StructType([_key_field(df, "u"), _key_field(df, "v")])
    links = block_join(df, df, kernel, schema, radius=radius, block=block)
    return links


def smallest_within(queries: DataFrame, refs: DataFrame, radius: float, value: str,
                    block: int = BLOCK_ROWS) -> DataFrame:
    """``(id, value)``: smallest ``value`` of the reference points within ``radius``."""
    def kernel(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values(value, kind="stable")
        mask = _within(_matrix(l), _matrix(r), radius)
        hit = mask.any(1)
        return pd.DataFrame({"id": l["id"].to_numpy()[hit],
                             value: r[value].to_numpy()[mask[hit].argmax(1)]})

    schema = T.StructType([_key_field(queries, "id"),
                           T.StructField(value, refs.schema[value].dataType)])
    part = block_join(queries, refs, kernel, schema, radius=radius, block=block)
    return part.groupBy("id").agg(F.min(value).alias(value))


SUM_TILE = 64, 1024          # rows of a tile whose distances stay in a core's cache


def tiles(x: np.ndarray, y: np.ndarray):
    """``(first row, first column, squared distances)`` of all pairs, tile by tile in one buffer.

    Distances too small for the fast form are computed again.
    """
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    a = np.column_stack([-2.0 * x, nx, np.ones(len(x))])
    b = np.column_stack([y, np.ones(len(y)), ny]).T
    near = 1e-6 * float(nx.max() + ny.max()) + 1e-300
    room = np.empty(SUM_TILE)
    for i in range(0, len(x), SUM_TILE[0]):
        rows = a[i:i + SUM_TILE[0]]
        for j in range(0, len(y), SUM_TILE[1]):
            cols = b[:, j:j + SUM_TILE[1]]
            d = room.ravel()[:len(rows) * cols.shape[1]].reshape(len(rows), -1)
            np.matmul(rows, cols, out=d)
            if d.min() < near:
                u, v = np.divmod(np.flatnonzero(d < near), d.shape[1])
                d[u, v] = ((x[i + u] - y[j + v]) ** 2).sum(1)
            yield i, j, d


def distance_sums(df: DataFrame, group: str, block: int = BLOCK_ROWS) -> DataFrame:
    """``(id, <group>, other, total)``: sum of distances from each point to each group.

    Every pair is computed once, in a task that sees two chunks and adds its distances to both
    points' sums; what leaves it is one number per point and group.
    """
    schema = T.StructType([_key_field(df, "id"), df.schema[group],
                           T.StructField("other", df.schema[group].dataType),
                           T.StructField("total", T.DoubleType())])

    def rows(pdf: pd.DataFrame, names: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        n = len(names)
        return pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), n),
                             group: np.repeat(pdf[group].to_numpy(), n),
                             "other": np.tile(names, len(pdf)), "total": total.ravel()})

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame(columns=schema.names)
        same = int(l["a"].iloc[0]) == int(l["b"].iloc[0])
        l, r = (s.sort_values(group, kind="stable") for s in (l, r))
        mine, x_code = np.unique(l[group].to_numpy(), return_inverse=True)
        others, y_code = np.unique(r[group].to_numpy(), return_inverse=True)
        to, back = _sums(_matrix(l), x_code, len(mine), _matrix(r), y_code, len(others), not same)
        found = rows(l, others, to)
        return found if same else pd.concat([found, rows(r, mine, back.T)], ignore_index=True)

    n = df.count()
    sides = max(1, -(-n // _wide(n, block)))
    at = df.select("id", "vec", group, F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(sides)).cast("int").alias("at"))
    low = at.withColumn("b", F.explode(F.sequence("at", F.lit(sides - 1)))).withColumnRenamed("at", "a")
    # Fresh column identities: both sides come from one table.
    high = at.select(*[F.col(c).alias(c) for c in at.columns]).withColumn(
        "a", F.explode(F.sequence(F.lit(0), "at"))).withColumnRenamed("at", "b")
    # Few rows make much work: Spark would merge tasks by the size of what they read.
    tasks = sides * (sides + 1)
    part = low.repartition(tasks, "a", "b").groupBy("a", "b").cogroup(
        high.repartition(tasks, "a", "b").groupBy("a", "b")).applyInPandas(run, schema)
    return part.groupBy("id", group, "other").agg(F.sum("total").alias("total"))


def _sums(x: np.ndarray, x_code: np.ndarray, x_n: int, y: np.ndarray, y_code: np.ndarray, y_n: int,
          both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances from each x to the groups of y, and (groups first) back from each y.

    Rows come in the order of their group's code, so a tile holds few groups. All tiles share one
    buffer; distances too small for the fast form are computed again.
    """
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    a = np.column_stack([-2.0 * x, nx, np.ones(len(x))])
    b = np.column_stack([y, np.ones(len(y)), ny]).T
    near = 1e-6 * float(nx.max() + ny.max()) + 1e-300
    to, back = np.zeros((len(x), y_n)), np.zeros((x_n if both else 0, len(y)))
    room, ones = np.empty(SUM_TILE), [_ones(y_code[j:j + SUM_TILE[1]]) for j in range(0, len(y), SUM_TILE[1])]
    for i in range(0, len(x), SUM_TILE[0]):
        rows = slice(i, min(i + SUM_TILE[0], len(x)))
        held, one = _ones(x_code[rows])
        for j, (met, theirs) in zip(range(0, len(y), SUM_TILE[1]), ones):
            cols = slice(j, min(j + SUM_TILE[1], len(y)))
            d = room[:rows.stop - i, :cols.stop - j]
            np.matmul(a[rows], b[:, cols], out=d)
            if d.min() < near:
                u, v = np.divmod(np.flatnonzero(d < near), d.shape[1])
                d[u, v] = ((x[i + u] - y[j + v]) ** 2).sum(1)
            np.sqrt(d, out=d)
            to[rows, met] += d @ theirs.T
            if both:
                back[held, cols] += one @ d
    return to, back


def _ones(code: np.ndarray) -> tuple[slice, np.ndarray]:
    """The groups of a tile (ascending codes), and a row for each with ones at its members."""
    held = np.arange(code[0], code[-1] + 1)
    return slice(held[0], held[-1] + 1), (code == held[:, None]).astype(float)
