"""What the corpus operators share: words, byte views of Arrow batches, packing, labelling of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import written

# A word is a run of anything but these bytes. ``bytes.split()`` splits at just them.
WORD = r"[^\x20\x09-\x0D]+"

NO_ID = 2**63 - 1


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def bare(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and whole text as bytes (null text: empty); other columns only by name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep,
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20,
           column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``size`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        at = offsets(b.column(column))
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(at, at[start] + size, side="right")) - 1
            end = min(b.num_rows, max(end, start + 1))
            yield b.slice(start, end - start)
            start = end


def offsets(col: pa.Array) -> np.ndarray:
    """Start of each value in the value buffer, and the end of the last."""
    kind = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(
        col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind, len(col) + 1,
                         col.offset * np.dtype(kind).itemsize).astype(np.int64)


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end (no copy), and the row offsets in them."""
    at = offsets(col)
    data = col.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)],
                                         dtype=np.uint64) for b in (_BASE, inverse))
    return _POWERS[size]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words before each row (and in all).

    ``data`` and ``at`` are rows' bytes end to end and the rows' offsets, as from ``joined``.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """A 64-bit number for the bytes of each word, A-Z as a-z if ``lower``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    values = _BYTE[_LOWER[data]] if lower else _BYTE[data]
    values *= up[:len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def rolled(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` neighbours: log n polynomial doublings, then mixing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = np.uint64((0x9E3779B97F4A7C15 + 2 * seed) | 1)
    power, width, span = base, 1, mixed(h + np.uint64(seed))
    done, total = 0, None
    while True:
        if n & width:
            if total is None:
                total, done = span, width
            else:
                keep = len(h) - done - width + 1
                total = total[:keep] * power + span[done:done + keep]
                done += width
        if done == n:
            return mixed(total)
        span = span[:len(span) - width] * power + span[width:]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2


def hexes(rows: list[bytes]) -> pa.Array:
    import hashlib
    return pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string())


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of undirected ``links`` (a, b): smallest node reachable.

    Large-star and small-star rounds on written tables: each round groups by the pre-aggregated
    smallest neighbour, so a node with very many links only ever carries rows (v, smallest), never
    a list. Ends when a round changes nothing; the number of rounds is logarithmic in the
    longest path. Raises if ``rounds`` don't suffice, rather than giving half-joined groups.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"),
                                                               F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        edges = written(small.distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")),
                        F.sum(F.col("v").cast("decimal(38,0)")),
                        F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Like ``written``, in a denser codec: for large intermediate tables of binary columns."""
    from tessera.session import new_path
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a per-item array between each two neighbouring offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out
