"""Vector codes: product quantisation by integer k-means with norm-of-sum bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import longs, offsets
from tessera.session import new_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
GROUPS = 4                   # lower bounds kept a part: one for each run of entries
LIMIT = 1 << 28              # integer components beyond this could overflow a squared distance
BROADCAST_ROWS = 200_000     # distinct labels; beyond this their sums come by a shuffle join
SLICE_ROWS = 4096


class Bounds:
    """All codebooks so far, and what they say about bounds of an earlier round.

    A bound is stored with the round that it was computed in. Its entry has since moved from the
    codebook of that round to today's: the norm of the sum of its moves, which is never more than
    the sum of their norms that a running bound would have given away.
    """

    def __init__(self, history: list[np.ndarray], groups: int = GROUPS):
        self.history = history
        self.book = history[-1]
        self.now = len(history) - 1
        self.parts, self.entries, _ = self.book.shape
        self.group = np.arange(self.entries) * groups // self.entries     # of each entry
        self.groups = groups
        # moved[t, part, entry]: net way of an entry from round t to now, rounded up.
        net = np.stack([self.book - h for h in history]).astype(np.float64)
        self.moved = np.sqrt((net * net).sum(axis=3)) * (1 + 1e-9)
        self.most = np.zeros((len(history), self.parts, groups))
        for g in range(groups):
            mine = self.moved[:, :, self.group == g]
            if mine.shape[2]:
                self.most[:, :, g] = mine.max(axis=2)

    def squared(self, x: np.ndarray, part: int, entries) -> np.ndarray:
        """Exact squared distances of parts (rows) to entries, or row by row to one entry each."""
        d = x[:, None, :] - self.book[part][None, entries] if isinstance(entries, slice) else (
            x - self.book[part][entries])
        return (d * d).sum(axis=-1)

    def assign(self, x: np.ndarray, part: int, code: np.ndarray, upper: np.ndarray,
               upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray) -> int:
        """Nearest entry (ties: lowest index) of the vectors' parts; the state is updated in place.

        ``upper`` bounds the distance to the entry in ``code`` from above, ``lower[:, g]`` the
        distance to any other entry of group g from below. Only groups that the bounds, carried to
        this round, cannot rule out are scanned again, in exact integers. Returns the number of
        distances computed.
        """
        bound = upper + self.moved[upper_at, part, code]
        floor = lower - self.most[lower_at, part, np.arange(self.groups)]
        rows = np.flatnonzero((bound[:, None] >= floor).any(axis=1))
        if not len(rows):
            return 0
        done = len(rows)
        own = self.squared(x[rows], part, code[rows])          # the true distance instead of its bound
        bound = np.sqrt(own.astype(np.float64)) * (1 + 1e-9)
        upper[rows], upper_at[rows] = bound, self.now
        open_ = bound[:, None] >= floor[rows]
        old, best, at = code[rows].copy(), own.copy(), code[rows].copy()
        seen = {}
        for g in range(self.groups):
            lo, hi = np.searchsorted(self.group, [g, g + 1])
            i = np.flatnonzero(open_[:, g])
            if lo == hi or not len(i):
                continue
            d = self.squared(x[rows[i]], part, slice(lo, hi))
            done += d.size
            seen[g] = i, lo, d
            k = d.argmin(axis=1)
            near = d[np.arange(len(i)), k]
            better = (near < best[i]) | (near == best[i]) & (lo + k < at[i])
            best[i[better]], at[i[better]] = near[better], (lo + k)[better]
        for g, (i, lo, d) in seen.items():
            d = d.astype(np.float64)
            mine = (at[i] >= lo) & (at[i] < lo + d.shape[1])
            d[np.flatnonzero(mine), at[i][mine] - lo] = np.inf
            lower[rows[i], g] = np.sqrt(d.min(axis=1)) * (1 - 1e-9)
            lower_at[rows[i], g] = self.now
        # An entry left behind counts among the others of its group from now on.
        left = np.flatnonzero((at != old) & ~open_[np.arange(len(rows)), self.group[old]])
        if len(left):
            r, g = rows[left], self.group[old[left]]
            before = np.minimum(floor[r, g], np.sqrt(own[left].astype(np.float64)) * (1 - 1e-9))
            lower[r, g], lower_at[r, g] = before, self.now
        code[rows] = at
        upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + 1e-9)
        return done


_STATE = ("vec_id long, vec binary, code binary, upper binary, upper_at binary, lower binary, "
          "lower_at binary, scanned long")


def _whole(col: pa.Array, kind, width: int) -> np.ndarray:
    at = offsets(col)
    n = len(col)
    if not n or not width:
        return np.zeros((n, width), kind)
    return np.frombuffer(col.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0])).view(
        kind).reshape(n, width)


def _cells(values: np.ndarray) -> pa.Array:
    """A binary column of equal rows."""
    values = np.ascontiguousarray(values)
    n, size = len(values), values[:1].nbytes if len(values) else 0
    at = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(values)])


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, vec`` of the usable rows: vec the integers floor(scale * x) as bytes.

    Rows whose vector is null, or has a null or non-finite component, are left out. All others must
    have the commonest width of these (ties: the larger), a multiple of ``parts``; rows of another
    width can't be compared with them and are left out like null vectors. A component whose integer
    passes 2^28 is refused: squared distances would no longer fit.
    """
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("label"), F.col("embedding").cast("array<double>").alias("e"))
    fine = table.where(F.col("e").isNotNull() & ~F.exists(
        "e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    widths = fine.groupBy(F.size("e").alias("w")).count().where(f"w > 0 and w % {parts} = 0")
    top = widths.orderBy(F.desc("count"), F.desc("w")).first()
    width = top["w"] if top else parts

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(s, SLICE_ROWS)
                x = b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                x = np.floor(x * scale)
                if (np.abs(x) > LIMIT).any():
                    raise ValueError("a component is too large for exact integer distances")
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("label"), _cells(x.astype("<i4"))],
                    ["vec_id", "label", "vec"])
    kind = dict(table.dtypes)["label"]
    return fine.where(F.size("e") == width).mapInArrow(
        run, f"vec_id long, label {kind}, vec binary")


def updated(book: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries become the floored means of their parts; unused ones stay."""
    out = book.copy()
    for r in sums.collect():                                   # at most parts x entries rows
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["total"]]
    return out


def _removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[np.ndarray, DataFrame]:
    """Codebooks (part, entry, position) and ``vec_id, label, code, error`` of every usable row.

    ``vectors`` has ``vec_id, embedding, label``; further columns are not read. Each part position
    starts from that part of the rows with the smallest vec_ids (null ids last, equal ids by their
    integers; fewer rows give fewer entries), then ``rounds`` times parts go to their nearest entry
    and entries to the floored mean of their parts; a last assignment gives code and error (sum of
    squared distances). Equal rows get equal codes each; an empty table gives no rows and codebooks
    without entries. All distances that decide are exact integers, ties go to the lower index.

    The state (code, one upper and ``GROUPS`` lower bounds a part, each stamped with its round) is
    written with the integers once a round, and the table before is removed as soon as the next is
    complete: two generations exist at most, and a lost executor's rows are computed again from the
    last. Only codebooks and at most parts x entries sums pass through the driver; sums are
    combined in each task, so a code or label that most rows share costs nothing more.
    """
    if entries > 256 or rounds > 254:
        raise ValueError("at most 256 entries and 254 rounds")
    spark = vectors.sparkSession
    paths = [new_path(spark, "vectors")]
    integers(vectors, scale, parts).write.option("compression", "zstd").parquet(paths[0])
    table = spark.read.schema(integers_schema(vectors)).parquet(paths[0])
    start = table.select("vec_id", "vec").orderBy(
        F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    first = np.array([np.frombuffer(r["vec"], "<i4") for r in start], np.int64)
    width = first.shape[1] // parts if len(start) else 0
    history = [first.reshape(len(start), parts, width).transpose(1, 0, 2).copy()]
    kind = dict(table.dtypes)["label"]
    schema = _STATE.replace("vec binary", f"label {kind}, vec binary")
    state = table
    for _ in range(rounds if len(start) else 0):
        paths.append(new_path(spark, "codes"))
        state.mapInArrow(_round(history, parts, width), schema).write.option("compression", "zstd").parquet(paths[-1])
        _removed(spark, paths[-2])
        state = spark.read.schema(schema).parquet(paths[-1])
        sums = (state.select("vec", "code").mapInArrow(_sums(parts, len(start), width),
                                                       "cell int, n long, total array<long>")
                .select("cell", "n", F.posexplode("total").alias("at", "x"))
                .groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
                .groupBy("cell").agg(F.first("n").alias("n"), F.transform(F.sort_array(
                    F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"))
                .select(F.expr(f"cell div {len(start)}").alias("part"),
                        F.expr(f"cell % {len(start)}").alias("entry"), "n", "total"))
        history.append(updated(history[-1], sums))
    return history[-1], state.mapInArrow(_round(history, parts, width, final=True),
                                         f"vec_id long, label {kind}, code binary, error long")


def integers_schema(vectors: DataFrame) -> str:
    return f"vec_id long, label {dict(vectors.dtypes)['label']}, vec binary"


def _round(history: list[np.ndarray], parts: int, width: int, final: bool = False):
    """Assign a batch's parts; in the first round every bound says nothing, so all is scanned."""
    def run(batches):
        bounds = Bounds(history)
        g = bounds.groups
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(s, SLICE_ROWS)
                n = b.num_rows
                x = _whole(b.column("vec"), "<i4", parts * width).astype(np.int64).reshape(
                    n, parts, width)
                if "code" in b.schema.names:
                    code = _whole(b.column("code"), np.uint8, parts).astype(np.int64)
                    upper = _whole(b.column("upper"), "<f4", parts).astype(np.float64)
                    upper_at = _whole(b.column("upper_at"), np.uint8, parts).astype(np.int64)
                    lower = _whole(b.column("lower"), "<f4", parts * g).astype(np.float64)
                    lower_at = _whole(b.column("lower_at"), np.uint8, parts * g).astype(np.int64)
                else:
                    code, upper_at = np.zeros((2, n, parts), np.int64)
                    upper = np.full((n, parts), np.inf)
                    lower, lower_at = np.zeros((n, parts * g)), np.zeros((n, parts * g), np.int64)
                lower, lower_at = lower.reshape(n, parts, g), lower_at.reshape(n, parts, g)
                done = 0
                for p in range(parts):
                    done += bounds.assign(x[:, p], p, code[:, p], upper[:, p], upper_at[:, p],
                                          lower[:, p], lower_at[:, p])
                if final:
                    error = sum(bounds.squared(x[:, p], p, code[:, p]) for p in range(parts))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("vec_id"), b.column("label"), _cells(code.astype(np.uint8)),
                         longs(error)], ["vec_id", "label", "code", "error"])
                    continue
                # Stored in four bytes: upper bounds rounded up, lower ones down.
                up = np.nextafter(upper.astype("<f4"), np.float32(np.inf))
                low = np.nextafter(lower.astype("<f4"), np.float32(-np.inf))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("label"), b.column("vec"),
                     _cells(code.astype(np.uint8)), _cells(up), _cells(upper_at.astype(np.uint8)),
                     _cells(low.reshape(n, -1)), _cells(lower_at.reshape(n, -1).astype(np.uint8)),
                     longs([done] + [0] * (n - 1))],
                    ["vec_id", "label", "vec", "code", "upper", "upper_at", "lower", "lower_at",
                     "scanned"])
    return run


def _sums(parts: int, entries: int, width: int):
    """Count and componentwise sum of the parts at each entry, one row a cell and task."""
    def run(batches):
        count = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, width), np.int64)
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(s, SLICE_ROWS)
                x = _whole(b.column("vec"), "<i4", parts * width).astype(np.int64).reshape(
                    -1, parts, width)
                code = _whole(b.column("code"), np.uint8, parts).astype(np.int64)
                for p in range(parts):
                    cell = p * entries + code[:, p]
                    count += np.bincount(cell, minlength=len(count))
                    order = np.argsort(cell, kind="stable")
                    begin = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
                    total[cell[order][begin]] += np.add.reduceat(x[order, p], begin, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), longs(count[used]),
             pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cell", "n", "total"])
    return run


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def _op11_sql() -> str:
    """The whole of op11 in SQL: one block of common tables a round, all arithmetic in integers."""
    steps = ["""
v as materialized (select row_number() over (order by vec_id, embedding) as id, vec_id, label,
         embedding as e from embeddings
       where embedding is not null and len(embedding) > 0 and len(list_filter(embedding,
           lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select id, (pos - 1) // 8 as p, (pos - 1) % 8 as i,
         floor(4096 * e[pos]::double)::bigint as x
       from v, (select unnest(range(1, 65)) as pos)),
b0 as materialized (select p, i, id - 1 as k, x as c from x where id <= 16)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} as (select x.id, x.p, b.k, sum((x.x - b.c) * (x.x - b.c))::bigint as d
       from x join b{r} b on b.p = x.p and b.i = x.i group by all),
a{r} as materialized (select id, p, min(d * 16 + k) % 16 as k, min(d) as d from d{r} group by id, p)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} as (select x.p, x.i, a.k, sum(x.x)::bigint as s, count(*) as n
       from x join a{r} a on a.id = x.id and a.p = x.p group by all),
b{r + 1} as materialized (select b.p, b.i, b.k, case when m.n is null then b.c
         else (m.s - (m.s % m.n + m.n) % m.n) // m.n end as c
       from b{r} b left join m{r} m on m.p = b.p and m.i = b.i and m.k = b.k)""")
    last = ROUNDS
    return "with" + ",".join(steps) + f""",
t as (select id, string_agg(printf('%02x', k), '' order by p) as code, sum(d)::bigint as error
      from a{last} group by id),
h as (select sha256(string_agg(c::varchar, ',' order by p, k, i)) as h from b{last})
select v.vec_id, t.code, t.error,
       (sum(t.error) over (partition by v.label))::bigint as label_error, h.h as codebooks_sha256
from v join t using (id), h
"""


OP11_SQL = _op11_sql()


def op11_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all embeddings, with the errors summed by label."""
    from tessera.llm.common import saved
    book, rows = compress(spark.read.parquet(f"{folder}/embeddings.parquet"))
    rows = saved(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "coded")
    sums = saved(rows.groupBy(F.col("label").alias("l")).agg(
        F.sum("error").alias("label_error")), "label_errors")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
