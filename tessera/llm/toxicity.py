"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import bare, documents, joined, remainder, slices

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 8
SCALE = 32.0
PRIOR = 300
"""Empty pieces in every average: a text of a few words can't stray far from the bias."""
SAMPLE_DOCS = 3000
THRESHOLD = 0.7
SLICE = 1 << 18
"""Bytes of text whose pieces a task holds at once, or one text."""

#: Letters, digits and bytes of other scripts stay, A-Z as a-z; anything else ends a word.
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each 3- to 5-byte piece of a word, word edges counting as a byte."""
    rows = len(at) - 1
    row_of = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))
    text = np.zeros(len(data) + rows + 1, np.uint32)
    place = np.arange(len(data)) + row_of + 1
    text[place] = _FOLD[data]
    owner = np.zeros(len(text), np.int32)
    owner[at[:-1] + np.arange(rows)] = 1
    owner = np.cumsum(owner, dtype=np.int32) - 1
    full = text != 0
    found_row, found = [], []
    for n in SIZES:
        last = len(text) - n + 1
        if last <= 0:
            continue
        ok = full[1:last + 1].copy()
        for k in range(2, n - 1):
            ok &= full[k:k + last]
        where = np.flatnonzero(ok)
        h = np.full(len(where), n, np.uint32)
        for k in range(n):
            h = (h ^ text[where + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        found.append(h & np.uint32(BUCKETS - 1))
        found_row.append(owner[where])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    return np.concatenate(found_row), np.concatenate(found)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 8,
        rate: float = 0.25, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train embeddings and softmax together; returns each bucket's pull on the logit, and the bias.

    ``bags`` are (buckets, counts). As the model is linear after the average, an embedding only
    enters a score through its product with the difference of the two softmax rows, so scoring
    needs one number a bucket. Classes weigh by the square root of their rarity. Without both
    classes every score is the class's own (0.5 with no labels).
    """
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), {0: -6.0, 1: 6.0}.get(next(iter(labels), -1), 0.0)
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    soft = (rng.standard_normal((2, WIDTH)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ge, gs, gb = np.full(BUCKETS, 1e-6, np.float32), np.full_like(soft, 1e-3), np.full(2, 1e-3)
    y = np.array(labels)
    pull = np.sqrt(len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1)))[y].astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 128):
            ids = order[k:k + 128]
            n = np.array([len(bags[i][0]) for i in ids])
            idx = np.concatenate([bags[i][0] for i in ids]).astype(np.int64)
            c = np.concatenate([bags[i][1] / (PRIOR + bags[i][1].sum()) for i in ids])
            c = (c * SCALE).astype(np.float32)
            doc = np.repeat(np.arange(len(ids)), n)
            used, inverse = np.unique(idx, return_inverse=True)
            rows = e[used]
            mean = np.stack([np.bincount(doc, rows[inverse, d] * c, len(ids))
                             for d in range(WIDTH)], 1).astype(np.float32)
            logit = mean @ soft.T + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            delta = p * pull[ids, None] / len(ids)
            back = delta @ soft
            grad = np.stack([np.bincount(inverse, back[doc, d] * c, len(used))
                             for d in range(WIDTH)], 1).astype(np.float32)
            ge[used] += (grad**2).mean(1)
            e[used] = rows - rate * grad / np.sqrt(ge[used])[:, None]
            step = delta.T @ mean
            gs += step**2
            soft -= rate * step / np.sqrt(gs)
            step = delta.sum(0)
            gb += step**2
            bias -= (rate * step / np.sqrt(gb)).astype(np.float32)
    toxic = soft[1] - soft[0]
    seen = np.zeros(BUCKETS, bool)
    for b, _ in bags:
        seen[b] = True
    return np.where(seen, e @ toxic, 0).astype(np.float32) * SCALE, float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS):
    """Fit on at most ``sample`` labelled documents per class, by a hash of the id (a parameter).

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Null labels are left out; of several
    labels for one document the highest counts.
    """
    marks = (labels.where("toxic in (0, 1)").where(remainder(F.col("doc_id"), 3) != 1)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("y")))
    some = None
    for y in (0, 1):
        one = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = one if some is None else some.unionByName(one)

    def run(batches):
        for b in slices(batches, SLICE):
            row, bucket = grams(*joined(b.column("text")))
            pair, n = np.unique(row.astype(np.int64) << 32 | bucket, return_counts=True)
            at = np.searchsorted(pair >> 32, np.arange(b.num_rows + 1))
            bucket = (pair & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("y"),
                pa.array([bucket[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                pa.array([n[i:j].astype(np.uint32).tobytes() for i, j in zip(at, at[1:])],
                         pa.binary())], ["doc_id", "y", "b", "n"])

    rows = (bare(docs).join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")
            .mapInArrow(run, "doc_id long, y int, b binary, n binary").toArrow())
    order = pa.compute.sort_indices(
        rows, [(c, "ascending") for c in ("doc_id", "y", "b")]).to_pylist()
    # Views of the table's memory: the sample is held once.
    bags = [tuple(np.frombuffer(rows.column(c)[i].as_buffer(), kind)
                  for c, kind in (("b", np.int32), ("n", np.uint32))) for i in order]
    return fit(bags, rows.column("y").take(pa.array(order, pa.int64())).to_pylist())


def score(docs: DataFrame, model, *keep: str) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every whole text, from its text alone, in one pass.

    Text without word pieces (null, empty) has the score of the bias. ``keep`` names columns to pass
    on; ``text`` among them is the column that is scored, so texts travel once.
    """
    pulls, bias = model
    whole = "text" in keep
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep) if whole else bare(
        docs, *keep)
    out = [c for c in rows.columns if whole or c != "text"]

    def run(batches):
        for b in slices(batches, SLICE):
            row, bucket = grams(*joined(b.column("text")))
            total = np.bincount(row, pulls[bucket], b.num_rows)
            n = PRIOR + np.bincount(row, minlength=b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total / n + bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(p)],
                                             [*out, "score"])

    kinds = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out],
                       "score double"])
    return rows.mapInArrow(run, kinds)


def op6_toxicity(spark, folder: str) -> DataFrame:
    """Score all documents with a model of the labelled rows outside the held-out third."""
    docs = documents(spark, folder)
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
