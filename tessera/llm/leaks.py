"""Benchmark decontamination: lossless seeds by pieces, q-gram counts, exact edit distance."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import _BYTE, bare, documents, longs, rolled, slices

SHARE = 0.08
"""A passage matches an item within so many edits per byte of the item."""
GRAM = 9
WIDTHS = (11, 9, 6)
"""Lengths of seeds: an item's are the longest that fit its pieces, of which each has six bytes."""
FILTER_BITS = 22
ITEMS_AT_ONCE = 2000
PAIRS_AT_ONCE = 4_000_000
SLICE = 2 << 20


def plain(text: bytes) -> bytes:
    """A-Z as a-z, words one space apart."""
    return b" ".join(text.lower().split())


UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff"
                      "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
"""Letters of scripts that write words without a space between."""


def stands(item: bytes, before: bytes, behind: bytes) -> bool:
    """Whether the item isn't a part of a longer word, by the bytes on either side of it."""
    def inner(*chars: str) -> bool:
        return all(c and unicodedata.category(c)[0] in "LMN" and not UNSPACED.match(c)
                   for c in chars)
    left, word, right = (x.decode(errors="ignore") for x in (before, item, behind))
    return not inner(left[-1:], word[:1]) and not inner(word[-1:], right[:1])


def edits(size: int, share: float = SHARE) -> int:
    return int(size * share)


def distances(item: bytes, text: bytes) -> list[int]:
    """For each place of ``text``: least edit distance between the item and a passage from there.

    Bit-parallel columns (Myers 1999) from the end: one big-integer step for each byte of text.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(reversed(item)):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << n) - 1, 1 << n - 1
    up, down, score, out = full, 0, n, []
    for c in reversed(text):
        eq = masks.get(c, 0)
        x = eq | down
        zero = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(zero | up)), up & zero
        score += bool(plus & high) - bool(minus & high)
        out.append(score)
        plus, minus = plus << 1, minus << 1
        up, down = (minus | (full & ~(zero | plus))) & full, plus & zero & full
    return out[::-1]


def distance(item: bytes, text: bytes, most: int) -> int | None:
    """Least edit distance between the item and a beginning of ``text``, if at most ``most``."""
    if text.startswith(item):
        return 0
    best = min(distances(item, text[:len(item) + most])[:1], default=len(item))
    return best if best <= most else None


class Items:
    """A block of benchmark items and their seeds.

    An item with e edits allowed is cut into e + 1 pieces. Edits can't touch all of them, so any
    match holds a piece unchanged, at most e bytes from its place: no match is lost, whatever the
    item's length and wherever the match starts.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        self.short = [(i, t) for i, t in items if 0 < len(t) < GRAM]
        self.items = [(i, t) for i, t in items if len(t) >= GRAM]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.edits = np.array([edits(len(t)) for _, t in self.items], np.int64)
        self.grams: dict[int, np.ndarray] = {}
        pieces: dict[int, list[tuple[int, int]]] = {}
        for k, (n, e) in enumerate(zip(self.size.tolist(), self.edits.tolist())):
            width = next(w for w in WIDTHS if w <= n // (e + 1))
            pieces.setdefault(width, []).extend((k, j * n // (e + 1)) for j in range(e + 1))
        self.seeds = []
        for width, some in pieces.items():
            h = np.concatenate([rolled(_BYTE[np.frombuffer(
                self.items[k][1][at:at + width], np.uint8)], width) for k, at in some])
            item, off = np.array(some, np.int64).T
            order = np.argsort(h, kind="stable")
            filter_ = np.zeros(1 << FILTER_BITS, bool)
            filter_[self.slots(h)] = True
            self.seeds.append((width, filter_, h[order], item[order], off[order]))

    @staticmethod
    def slots(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def places(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(row, item, first, last): where a match can start, by seeds that it may hold."""
        out = [np.zeros((4, 0), np.int64)]
        for width, filter_, known, item, off in self.seeds:
            h = rolled(_BYTE[data], width)
            at = np.flatnonzero(filter_[self.slots(h)])
            low = np.searchsorted(known, h[at])
            n = np.searchsorted(known, h[at], side="right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            total = np.cumsum(n)
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(
                    total, total[begin] - n[begin] + PAIRS_AT_ONCE, side="right")))
                m = n[begin:end]
                k = np.repeat(low[begin:end] - np.cumsum(m) + m, m) + np.arange(m.sum())
                start = np.repeat(at[begin:end], m) - off[k]
                row = np.searchsorted(rows, start + off[k], side="right") - 1
                out.append(self.merged(np.stack([row, item[k], start - self.edits[item[k]],
                                                 start + self.edits[item[k]]])))
                begin = end
        return self.merged(np.concatenate(out, 1))

    @staticmethod
    def merged(x: np.ndarray) -> np.ndarray:
        """Ranges of one row and item that overlap, as one."""
        if not x.shape[1]:
            return x
        x = x[:, np.lexsort((x[2], x[1], x[0]))]
        pair = np.cumsum(np.r_[False, (np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)])
        # Ends so far within a row and item: pairs lie apart, so one running maximum serves all.
        apart = np.int64(x[3].max() - min(0, x[2].min()) + 1)
        reach = np.maximum.accumulate(x[3] + pair * apart) - pair * apart
        new = np.r_[True, (np.diff(pair) != 0) | (x[2, 1:] > reach[:-1])]
        first = np.flatnonzero(new)
        return np.stack([x[0, first], x[1, first], x[2, first],
                         reach[np.r_[first[1:], len(new)] - 1]])

    def enough(self, item: int, text: bytes) -> bool:
        """False only if the text holds too few of the item's grams for a match (q-gram lemma)."""
        need = int(self.size[item] - GRAM + 1 - GRAM * self.edits[item])
        if need <= 1:
            return True
        if item not in self.grams:
            self.grams[item] = np.unique(rolled(_BYTE[np.frombuffer(
                self.items[item][1], np.uint8)], GRAM))
        known, h = self.grams[item], rolled(_BYTE[np.frombuffer(text, np.uint8)], GRAM)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return int((known[at] == h).sum()) >= need

    def find(self, text: bytes, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, start) over rows' plain bytes end to end, best per row and item.

        ``rows`` are offsets; rows are parted by a zero byte. Of equally near passages one that
        starts at a word goes first, then the first one.
        """
        found: dict[tuple[int, int], tuple[int, bool, int]] = {}

        def add(row: int, item: int, d: int, at: int) -> None:
            inside = at > rows[row] and text[at - 1] != 32
            value = (d, inside, at - int(rows[row]))
            found[row, item] = min(found.get((row, item), value), value)

        for i, t in self.short:
            p = text.find(t)
            while p >= 0:
                row = int(np.searchsorted(rows, p, side="right")) - 1
                begin, end = int(rows[row]), int(rows[row + 1]) - 1
                if p + len(t) <= end and stands(t, text[max(begin, p - 4):p],
                                                text[p + len(t):min(end, p + len(t) + 4)]):
                    add(row, i, 0, p)
                p = text.find(t, p + 1)
        for row, item, first, last in self.places(np.frombuffer(text, np.uint8), rows).T.tolist():
            i, t = self.items[item]
            most = int(self.edits[item])
            begin = max(first, int(rows[row]))
            part = text[begin:min(last + len(t) + most, int(rows[row + 1]) - 1)]
            if not self.enough(item, part):
                continue
            p = part.find(t)
            if p >= 0:
                while p >= 0:
                    add(row, i, 0, begin + p)
                    p = part.find(t, p + 1)
                continue
            near = distances(t, part)
            best = min(near, default=most + 1)
            if best <= most:
                for p, d in enumerate(near):
                    if d == best:
                        add(row, i, d, begin + p)
        return [(r, i, d, at) for (r, i), (d, _, at) in sorted(found.items())]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance, start``: items of which a document holds a near copy.

    Text and items are compared in plain form (``plain``); ``start`` counts bytes of the plain
    text. Every passage within ``SHARE`` edits per byte is found, at whatever byte it starts, and
    the least distance is given. Items go in blocks of a fixed number against all documents, one
    pass over the documents each, without a shuffle. Items without words match nothing, items
    under nine bytes only themselves and not inside a word (``stands``). Null texts hold nothing;
    repeated rows repeat; null ids stay.
    """
    spark = docs.sparkSession
    rows = items.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"),
        F.col("text").cast("binary").alias("text")).distinct()
    number = rows.count()
    out = None
    for k in range(max(1, -(-number // ITEMS_AT_ONCE))):
        blocks = max(1, -(-number // ITEMS_AT_ONCE))
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        # Copies of an item under several ids are looked for once.
        block = sorted({(r["item_id"], plain(bytes(r["text"]))) for r in part})
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            index = Items(held.value)
            for b in slices(batches, SLICE):
                texts = [plain(t) for t in b.column("text").to_pylist()]
                at = np.cumsum([0] + [len(t) + 1 for t in texts])
                hits = index.find(b"\0".join(texts) + b"\0", at)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                    longs([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.int32()),
                    longs([h[3] for h in hits])], ["doc_id", "item_id", "distance", "start"])
        one = bare(docs).mapInArrow(run, "doc_id long, item_id long, distance int, start long")
        out = one if out is None else out.unionByName(one)
    return out


def op7_leaks(spark, folder: str) -> DataFrame:
    return leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
