"""Candidate search for repeated windows: anchors that every window picks from its own content.

The anchor of a window is its leftmost smallest gram hash, so equal windows have equal anchors at
the same distance. A window can only repeat if its anchor's hash does, which a few rows per
hundred positions can tell. Documents of equal text are one content with one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import NO_ID, bare, longs, mixed, rolled

_LOW = np.uint64((1 << 24) - 1)
_STEP = 1 << 23


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` (null: after all others), content key and text as bytes."""
    return bare(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
                             F.xxhash64("text").alias("content"), "text")


def contents(rows: DataFrame) -> DataFrame:
    """Per document its content, the content's first document, and whether others share it."""
    names = rows.select("doc_id", "content").distinct()
    first = names.groupBy("content").agg(F.min("doc_id").alias("first"),
                                         (F.count("*") > 1).alias("shared"))
    return names.join(first, "content")


def picks(h: np.ndarray, at: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window within a row, and the place of its anchor.

    ``h`` are hashes of the units (words, bytes), ``at`` the rows' offsets among them.
    """
    g = rolled(h, gram)
    last = len(h) - window
    if last < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span, found = window - gram + 1, []
    for begin in range(0, last + 1, _STEP):
        part = g[begin:min(begin + _STEP, last + 1) + span - 1]
        low = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:len(low) - width], low[width:])
            width *= 2
        rest = span - width
        if rest:
            low = np.minimum(low[:len(low) - rest], low[rest:])
        found.append((low & _LOW).astype(np.int64) + begin)
    place = np.concatenate(found)
    sizes = np.diff(at)
    starts = np.repeat(at[:-1], np.maximum(sizes - window + 1, 0))
    counts = np.maximum(sizes - window + 1, 0)
    starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts, place[starts]


def deal(h: np.ndarray, content: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for ``meet``: each hash of this slice once, dealt out by hash.

    A hash that is here twice is known to repeat: its contents pass through, dealt out by content,
    and one mark goes to the hash's part. So a hash of any frequency costs one entry per slice.
    """
    order = np.lexsort((content, h))
    h, content = h[order], content[order]
    same = np.r_[False, h[1:] == h[:-1]]
    group = np.cumsum(~same) - 1
    many = (np.bincount(group, minlength=1) > 1)[group]
    first = ~same
    new = np.r_[True, (h[1:] != h[:-1]) | (content[1:] != content[:-1])]
    rows = []
    for kind, keep, by in ((0, ~many, h), (1, many & new, mixed(content.view(np.uint64))),
                           (2, many & first, h)):
        hs, cs = h[keep], content[keep]
        part = (by[keep] % np.uint64(parts)).astype(np.int64)
        o = np.argsort(part, kind="stable")
        hs, cs, part = hs[o], cs[o], part[o]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(cut, [*cut[1:], len(part)]):
            rows.append((int(part[a]), kind, hs[a:b].tobytes(), cs[a:b].tobytes()))
    p, k, hs, cs = zip(*rows) if rows else ((), (), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(p, pa.int32()), pa.array(k, pa.int8()), pa.array(hs, pa.binary()),
         pa.array(cs, pa.binary())], ["part", "kind", "h", "content"])


DEALT = "part int, kind byte, h binary, content binary"


def meet(table: pa.Table) -> pa.Table:
    """(content, h) for each hash that occurs in two places of the corpus."""
    out_c, out_h = [], []
    sides = {}
    for kind in range(3):
        rows = table.filter(pa.compute.equal(table.column("kind"), kind))
        sides[kind] = [np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
                       for c, t in (("h", np.uint64), ("content", np.int64))]
    del rows
    out_h.append(sides[1][0])
    out_c.append(sides[1][1])
    h, c = sides.pop(0)          # let go of once it is sorted
    if len(h):
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        h, c = h[new], c[new]
        again = np.r_[False, h[1:] == h[:-1]]
        again[:-1] |= again[1:].copy()
        again |= np.isin(h, sides[2][0])
        out_h.append(h[again])
        out_c.append(c[again])
    return pa.table({"content": longs(np.concatenate(out_c)),
                     "h": longs(np.concatenate(out_h).view(np.int64))})


def repeated(rows: DataFrame, hashes: Callable, parts: int) -> DataFrame:
    """``content, hs``: the anchor hashes of each content that also occur elsewhere."""
    def run(batches):
        for h, content in hashes(batches):
            yield from deal(h, content, parts)

    pairs = rows.select("content", "text").mapInArrow(run, DEALT).groupBy("part").applyInArrow(
        meet, "content long, h long")
    return pairs.groupBy("content").agg(F.collect_set("h").alias("hs"))


def lists(col: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of longs."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values = col.flatten().to_numpy(zero_copy_only=False)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy()
    return values, np.r_[0, np.cumsum(sizes)]


BUCKETS = 1 << 20


def _buckets(wanted: DataFrame) -> DataFrame:
    """Hash buckets that hold a wanted content: at most ``BUCKETS`` rows whatever the input."""
    return F.broadcast(wanted.select(F.pmod("content", F.lit(BUCKETS)).alias("_b")).distinct())


def sieve(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that may have a wanted content. Saves shuffling the others' texts before a join; where
    all buckets are taken, all rows pass and the join decides alone."""
    return rows.join(_buckets(wanted), F.pmod("content", F.lit(BUCKETS)) == F.col("_b"), "left_semi")


def attach(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Left join of a written ``info`` on document and content; other rows' texts stay in place."""
    same = F.pmod("content", F.lit(BUCKETS)) == F.col("_b")
    extra = [f for f in info.schema if f.name not in ("doc_id", "content")]
    aside = rows.join(_buckets(info), same, "left_anti").select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    return sieve(rows, info).join(info.hint("shuffle_hash"), ["doc_id", "content"], "left") \
        .unionByName(aside)
