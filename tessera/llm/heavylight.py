"""N-gram Jaccard join: subsets for light sets, inverted lists for heavy ones, boundary by cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tessera.llm.anchors import DEALT, deal, meet, sieve
from tessera.llm.common import (
    NO_ID, bare, components, documents, joined, longs, mixed, rolled, saved, slices, word_hashes,
    word_spans)

WORDS = 5
PERCENT = 75
SLICE = 2 << 20
LIGHT_AT_MOST = 64
"""Sizes for which costs are compared; above, a set has more subsets than elements."""
LEADERS = 8
"""Members of a list that its other members meet before all remaining pairs do."""
MAP_SHARE, MAP_SLOTS = 8, 1 << 12
"""Slots an element, about, and in all, at most, of the bitmaps that travel with list entries."""
PAIRS, MAP_WORDS, MEETING = 1 << 18, 1 << 19, 1 << 14
"""Pairs that a task forms, words of bitmaps that it compares, and list entries that it holds at once, about."""
CHUNK_ITEMS, CHUNK_SETS = 1 << 20, 2048
"""Shingles and sets in a chunk of a component, about."""
SLOTS, BLOCKS = 1 << 22, 1 << 10
"""Hash slots in which all shingles are counted, and parts of that table; they only decide an order."""


def shingle_sets(b: pa.RecordBatch, words: int = WORDS):
    """Distinct shingle hashes by row, sorted within it, and the rows' offsets."""
    data, at = joined(b.column("text"))
    starts, ends, first = word_spans(data, at)
    h = word_hashes(data, starts, ends, lower=True)
    n = np.diff(first)
    g = rolled(h, words)
    row = np.repeat(np.arange(b.num_rows), n)[:len(g)]
    whole = np.zeros(len(g), bool)
    if len(g):
        whole = row == np.repeat(np.arange(b.num_rows), n)[words - 1:]
    g, row = g[whole], row[whole]
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        one = [mixed(np.bitwise_xor.reduce(mixed(
            h[first[i]:first[i + 1]] + np.arange(1, n[i] + 1, dtype=np.uint64)
            * np.uint64(0x9E3779B97F4A7C15)))[None] + np.uint64(n[i]))[0] for i in few]
        g, row = np.r_[g, np.array(one, np.uint64)], np.r_[row, few]
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(b.num_rows + 1))


def set_keys(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set; its lowest bit is left free."""
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(mixed(g ^ np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
    return mixed((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(np.uint64)) & ~np.uint64(1)


def least_shared(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Elements that a set of this size shares with any set it links with, at least."""
    return -(-percent * n // 100)


def bitmap(items: np.ndarray, share: int = 2, most: int | None = None) -> bytes:
    """A bit for each element's slot, about ``share`` slots an element, a power of two in all."""
    slots = 1 << max(6, int(share * len(items) - 1).bit_length()) if len(items) else 64
    slots = min(slots, most or slots)
    bits = np.zeros(slots, np.uint8)
    bits[(items & np.uint64(slots - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_link(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False only if the sets surely don't link: a bit set in one map alone is an element missing
    in the other set. The larger map is folded to the smaller one's slots."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[:len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] | b[len(b) // 2:]
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= PERCENT * (n + m - most)


class Maps:
    """Bitmaps of many sets, to test many pairs at once as ``may_link`` does.

    The maps lie in one matrix for each width; a set is also in the matrix of half its width,
    since sizes that may link differ by a third at most, so widths by one step at most.
    """

    def __init__(self, maps: list[bytes], n: np.ndarray):
        self.n = n
        self.words = np.array([len(m) // 8 for m in maps], np.int64)
        self.place, self.table = {}, {}
        for w in np.unique(self.words).tolist():
            own, twice = np.flatnonzero(self.words == w), np.flatnonzero(self.words == 2 * w)
            wide = [np.frombuffer(b"".join(maps[i] for i in ids.tolist()), np.uint64).reshape(
                len(ids), size) for ids, size in ((own, w), (twice, 2 * w))]
            self.table[w] = np.concatenate([wide[0], wide[1][:, :w] | wide[1][:, w:]])
            self.place[w] = np.zeros(len(maps), np.int64)
            self.place[w][np.r_[own, twice]] = np.arange(len(own) + len(twice))

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For sets x[i] and y[i]: False only if they surely don't link."""
        out = np.ones(len(x), bool)
        low, high = np.minimum(self.words[x], self.words[y]), np.maximum(self.words[x], self.words[y])
        for w, table in self.table.items():
            some = np.flatnonzero((low == w) & (high <= 2 * w))
            step = max(1, MAP_WORDS // w)
            for at in range(0, len(some), step):
                k = some[at:at + step]
                a, b = table[self.place[w][x[k]]], table[self.place[w][y[k]]]
                n, m = self.n[x[k]], self.n[y[k]]
                most = np.minimum(n - np.bitwise_count(a & ~b).sum(1, dtype=np.int64),
                                  m - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
                out[k] = 100 * most >= PERCENT * (n + m - most)
        return out


def _survey(b: pa.RecordBatch) -> pa.RecordBatch:
    """Per row its set's key, size and bitmaps, the second of bounded width."""
    g, at = shingle_sets(b)
    return pa.RecordBatch.from_arrays(
        [b.column("doc_id"), b.column("content"), longs(set_keys(g, at).view(np.int64)),
         longs(np.diff(at)), *(pa.array([bitmap(g[i:j], *how) for i, j in zip(at, at[1:])],
                                        pa.binary()) for how in ((), (MAP_SHARE, MAP_SLOTS)))],
        ["doc_id", "content", "key", "n", "bits", "map"])


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A commonness for each of ``SLOTS`` hash slots, and list lengths by set size.

    Every shingle of the corpus counts in its slot, once for each set of a slice; a task hands on
    one table of counts, whatever it reads, and tables are added block by block. The slot's count, in eighths of a power of two, orders
    prefixes: any order that depends on the shingle alone gives the same links, this one keeps
    passages that many documents share out of the lists.
    """
    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        cost = np.zeros(LIGHT_AT_MOST + 1, np.int64)
        for b in slices(batches, SLICE):
            g, at = shingle_sets(b)
            _, first = np.unique(set_keys(g, at), return_index=True)
            one = np.zeros(b.num_rows, bool)
            one[first] = True
            n = np.diff(at)
            keep = np.repeat(one, n)
            g, size = g[keep], np.repeat(n, n)[keep]
            total += np.bincount(slot(g), minlength=SLOTS)
            values, back, count = np.unique(g, return_inverse=True, return_counts=True)
            light = size <= LIGHT_AT_MOST
            cost += np.bincount(size[light], count[back][light], LIGHT_AT_MOST + 1).astype(np.int64)
        for block, part in enumerate(np.split(total, BLOCKS)):
            if part.any():
                yield _counts(block, part)
        yield _counts(BLOCKS, cost)

    def add(batches):
        sums = {}
        for b in batches:
            for block, low, at, n in zip(*(b.column(c) for c in ("block", "low", "at", "n"))):
                total = sums.setdefault(block.as_py(), np.zeros(width, np.int64))
                low = np.frombuffer(low.as_buffer(), np.uint8)
                total[:len(low)] += low
                total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(
                    n.as_buffer(), np.int64)
        for block, total in sums.items():
            out = total if block == BLOCKS else np.minimum(
                8 * np.log2(total + 1), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())],
                ["block", "out"])

    width = SLOTS // BLOCKS
    found = rows.select("text").mapInArrow(
        run, "block int, low binary, at binary, n binary").repartition("block").mapInArrow(
        add, "block int, out binary").collect()
    rank, lengths = np.zeros(SLOTS, np.uint8), np.zeros(LIGHT_AT_MOST + 1, np.int64)
    for block, out in found:
        if block == BLOCKS:
            lengths = np.frombuffer(bytes(out), np.int64)[:LIGHT_AT_MOST + 1]
        else:
            rank[block * width:(block + 1) * width] = np.frombuffer(bytes(out), np.uint8)
    return rank, lengths


def slot(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _counts(block: int, part: np.ndarray) -> pa.RecordBatch:
    """Counts of a block: low bytes and what goes beyond them, or only the few that are not zero."""
    at, low = np.flatnonzero(part), np.zeros(0, np.uint8)
    if 10 * len(at) > len(part):
        low, part = part.astype(np.uint8), part & ~np.int64(255)
        at = np.flatnonzero(part)
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (
            low, at.astype(np.uint16), part[at]))], ["block", "low", "at", "n"])


def boundary(sizes: dict[int, int], lengths: np.ndarray) -> int:
    """Largest light size: least cost of enumerating pairs of light prefixes and scanning lists.

    A light set of size n costs its 2-subsets of the (n - c + 2)-prefix, c = least shared; a heavy
    one the entries of its lists, of which the (n - c + 1)-prefix is this share.
    """
    best, cost, least = 1, 0.0, 0.0
    for n in range(2, LIGHT_AT_MOST + 1):
        spare = n - int(least_shared(np.array(n)))
        subsets = (spare + 2) * (spare + 1) / 2 if n > 2 else 1
        cost += sizes.get(n, 0) * subsets - lengths[n] * (spare + 1) / n
        if cost < least:
            best, least = n, cost
    return best


def entries(rows: DataFrame, common: np.ndarray, light: int, parts: int) -> DataFrame:
    """``key, h``: list entries and subset entries that at least two sets share.

    Elements are ordered from rare to common. Sets that link share at least c elements, so their
    (n - c + 1)-prefixes share one and their (n - c + 2)-prefixes share two. The lowest bit of a
    key marks a light set, that of ``h`` a subset entry.
    """
    def hashes(batches):
        for b in slices(batches, SLICE):
            g, at = shingle_sets(b)
            key, n = set_keys(g, at), np.diff(at)
            _, first = np.unique(key, return_index=True)
            one = np.zeros(b.num_rows, bool)
            one[first] = True
            one &= n > 0
            keep = np.repeat(one, n)
            row = np.repeat(np.arange(b.num_rows), n)[keep]
            h = g[keep]
            order = np.lexsort((h, common[slot(h)], row))
            h, row = h[order], row[order]
            n = n[one]
            begin = np.cumsum(n) - n
            place = np.arange(len(h)) - np.repeat(begin, n)
            spare = np.repeat(n - least_shared(n), n)
            small = np.repeat(n <= light, n)
            label = key | (np.diff(at) <= light).astype(np.uint64)
            out_h, out_k = [h[place <= spare] & ~np.uint64(1)], [label[row[place <= spare]]]
            # Pairs of light prefixes: element at place p with each of the next ones.
            size = np.repeat(n, n)
            for step in range(1, int(np.max(np.where(small, spare, 0), initial=0)) + 2):
                left = np.flatnonzero(small[:-step] & (place[:-step] + step <= spare[:-step] + 1)
                                      & (place[:-step] + step < size[:-step])) \
                    if len(h) > step else np.zeros(0, np.int64)
                a, z = h[left], h[left + step]
                out_h.append(mixed(mixed(np.minimum(a, z)) + np.maximum(a, z)) | np.uint64(1))
                out_k.append(label[row[left]])
            yield np.concatenate(out_h), np.concatenate(out_k).view(np.int64)

    def run(batches):
        for h, key in hashes(batches):
            yield from deal(h, key, parts)

    return rows.select("text").mapInArrow(run, DEALT).groupBy("part").applyInArrow(
        meet, "content long, h long").select(F.col("content").alias("key"), "h")


def linked(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the pairs (a, b) of set keys those whose Jaccard similarity is high enough; and the
    shingles of the sets compared (``key, items``).

    Bitmaps of the sets rule most pairs out. Only texts of the others' sets are fetched, one text
    a set, and their shingles are compared.
    """
    def promising(batches):
        for b in batches:
            ok = [may_link(*v) for v in zip(*(b.column(c).to_pylist() for c in (
                "x", "an", "y", "bn")))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = classes.select(F.col("key"), F.col("n"), "bits")
    pairs = saved(
        pairs.join(side.toDF("a", "an", "x"), "a").join(side.toDF("b", "bn", "y"), "b").mapInArrow(
            promising, "a long, b long"), "promising")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(
        pairs.select(F.col("b").alias("key"))).distinct()
    wanted = saved(classes.join(wanted, "key").select("key", "first.*"), "wanted")
    texts = sieve(rows, wanted).join(wanted.hint("shuffle_hash"), ["doc_id", "content"]) \
        .select("key", "text")

    def shingled(batches):
        for b in slices(batches, SLICE // 4):
            g, at = shingle_sets(b)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([g[i:j].tobytes() for i, j in zip(at, at[1:])],
                                           pa.binary())], ["key", "items"])
    sets = saved(texts.mapInArrow(shingled, "key long, items binary").dropDuplicates(["key"]), "sets")

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(
                    y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return saved(pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")
                 .join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
                 .mapInArrow(check, "a long, b long").distinct(), "links"), sets


def linking(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets of ``x`` and ``y`` that link.

    Elements of ``y`` are one inverted index: a set of ``x`` costs the elements that it shares.
    """
    n = np.array([len(s) for s in y])
    items = np.concatenate(y)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), n)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, s in enumerate(x):
        low = np.searchsorted(items, s)
        m = np.searchsorted(items, s, side="right") - low
        at = np.repeat(low - np.cumsum(m) + m, m) + np.arange(m.sum())
        both = np.bincount(owner[at], minlength=len(y))
        j = np.flatnonzero(100 * both >= PERCENT * (len(s) + n - both))
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def within(sets: DataFrame, label: DataFrame, emit: bool) -> DataFrame:
    """All links inside components: ``key, n`` per set, or the pairs ``a < b`` if ``emit``.

    A link lies within one component, so its sets are dealt into chunks of bounded size and each
    two chunks meet in one task, which hands on a count per set. Every pair meets once.
    """
    # The smallest set of a component has no row in ``label``, nor has a set without links.
    named = saved(sets.join(label.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "items", F.coalesce("component", "key").alias("component"),
        (F.length("items") / 8).cast("long").alias("n")), "members")
    sums = named.groupBy("component").agg(
        F.sum("n").alias("total"), F.count("*").alias("number")).where("number > 1")
    chunks = F.greatest(F.ceil(F.col("total") / CHUNK_ITEMS),
                        F.ceil(F.col("number") / CHUNK_SETS)).cast("int")
    dealt = named.join(sums.select("component", chunks.alias("chunks")), "component").withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit(3), "key"), F.col("chunks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 + total // CHUNK_ITEMS
    # Small components share a group; a pair of chunks of a large one is a group.
    meets = meets.select(
        "key", "items", "component", "chunk", low.alias("i"), high.alias("j"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(parts)))
        .otherwise(F.xxhash64("component", low, high)).alias("part"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("component", "i", "j", "key")])
        where = np.stack([table.column(c).to_numpy() for c in ("component", "i", "j")])
        chunk, key = table.column("chunk").to_numpy(), table.column("key").to_numpy()
        items = [np.frombuffer(v, np.uint64) for v in table.column("items").to_pylist()]
        cut = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(0), True])
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end in zip(cut, cut[1:]):
            rows = np.arange(begin, end)
            x, y = rows[chunk[rows] == where[1, begin]], rows[chunk[rows] == where[2, begin]]
            if not len(x) or not len(y):
                continue
            i, j = linking([items[r] for r in x], [items[r] for r in y])
            a, b = key[x[i]], key[y[j]]
            if where[1, begin] == where[2, begin]:
                a, b = a[a < b], b[a < b]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if emit:
            return pa.table({"a": longs(a), "b": longs(b)})
        key, n = np.unique(np.r_[a, b], return_counts=True)
        return pa.table({"key": longs(key), "n": longs(n)})

    found = meets.groupBy("part").applyInArrow(compare, "a long, b long" if emit else "key long, n long")
    return found if emit else found.groupBy("key").agg(F.sum("n").alias("n_links"))


def led(lists: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of each set of a list with ``LEADERS`` of its members, drawn by hash, that are
    of other components and may link by size and bitmaps. Of a large group of near copies this
    joins all but a few sets, for a cost linear in the entries, before ``across`` meets the rest
    pairwise. ``lists`` as for ``across``."""
    member = F.struct("key", "n", "light", "component", "map")
    drawn = lists.groupBy("h").agg(F.array(*[
        F.min_by(member, F.xxhash64(F.lit(r), "key")) for r in range(LEADERS)]).alias("leads"))
    met = F.filter("leads", lambda x: (x["component"] != F.col("component")) & (
        (F.col("h").bitwiseAND(F.lit(1)) == 1) | ~(F.col("light") & x["light"])) & (
        100 * F.least("n", x["n"]) >= PERCENT * F.greatest("n", x["n"])))

    def test(batches):
        for b in batches:
            leads = b.column("leads")
            lead = leads.flatten()
            key = np.r_[b.column("key").to_numpy(), lead.field("key").to_numpy()]
            n = np.r_[b.column("n").to_numpy(), lead.field("n").to_numpy()]
            sets, one, who = np.unique(key, return_index=True, return_inverse=True)
            maps = Maps(pa.chunked_array([b.column("map"), lead.field("map")]).take(
                pa.array(one)).to_pylist(), n[one])
            row = pa.compute.list_parent_indices(leads).to_numpy()
            x, y = _once(who[row], who[b.num_rows:])
            ok = maps.may_link(x, y)
            yield pa.RecordBatch.from_arrays(
                [longs(sets[x[ok]]), longs(sets[y[ok]])], ["a", "b"])

    return lists.join(drawn, "h").select("key", "n", "map", F.array_distinct(met).alias(
        "leads")).where(F.size("leads") > 0).mapInArrow(test, "a long, b long")


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, smaller key first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def across(lists: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of sets of different components that share a list and may link by size and
    bitmaps.

    ``lists``: ``h, key, n, light, component, map`` and the list's length ``number``. Pairs are
    formed and tested inside a task, which hands on only those that may link, each once; long lists
    are dealt into chunks, of which each two meet in one task.
    """
    chunks = F.ceil(F.col("number") / CHUNK_SETS).cast("int")
    dealt = lists.withColumn("chunks", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit(5), "key"), F.col("chunks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    parts = 1 + lists.count() // MEETING
    meets = meets.select(
        "h", "key", "n", "light", "component", "map", "chunk", low.alias("i"), high.alias("j"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("h"), F.lit(parts)))
        .otherwise(F.xxhash64("h", low, high)).alias("part"))

    def compare(table: pa.Table) -> pa.Table:
        h, key, n, component, light, chunk, i, j = (table.column(c).to_numpy() for c in (
            "h", "key", "n", "component", "light", "chunk", "i", "j"))
        sets, one, who = np.unique(key, return_index=True, return_inverse=True)
        maps = Maps(table.column("map").take(pa.array(one)).to_pylist(), n[one])
        order = np.lexsort((n, j, i, h))
        h, who, n, component, light, chunk, i, j = (
            v[order] for v in (h, who, n, component, light, chunk, i, j))
        cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        end = np.repeat(np.r_[cut[1:], len(h)], np.diff(np.r_[cut, len(h)]))
        # Sizes ascend in a group: each member meets those behind it up to the last size allowed.
        stop, most = np.empty(len(h), np.int64), n * 100 // PERCENT
        for a, b in zip(cut, [*cut[1:], len(h)]):
            stop[a:b] = a + np.searchsorted(n[a:b], most[a:b], side="right")
        stop = np.minimum(stop, end)
        count = stop - np.arange(len(h)) - 1
        out, begin = [(np.zeros(0, np.int64),) * 2], 0
        total = np.cumsum(count)
        while begin < len(h):
            done = total[begin - 1] if begin else 0
            last = max(begin + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
            m = count[begin:last]
            x = np.repeat(np.arange(begin, last), m)
            y = x + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            ok = (component[x] != component[y]) & ((i[x] == j[x]) | (chunk[x] != chunk[y]))
            ok &= ((h[x] & 1) == 1) | ~(light[x] & light[y])
            a, b = _once(who[x[ok]], who[y[ok]])
            ok = maps.may_link(a, b)
            out.append((a[ok], b[ok]))
            begin = last
        a, b = _once(*(np.concatenate(v) for v in zip(*out)))
        return pa.table({"a": longs(sets[a]), "b": longs(sets[b])})

    return meets.groupBy("part").applyInArrow(compare, "a long, b long")


def merged(label: DataFrame, more: DataFrame) -> DataFrame:
    """Components (``node, component``) of ``label`` joined by further links between them."""
    root = label.toDF("node", "root")
    ends = more
    for c in ("a", "b"):
        ends = ends.join(root.withColumnRenamed("node", c), c, "left").withColumn(
            c, F.coalesce("root", c)).drop("root")
    joint = components(ends)
    moved = label.join(joint.toDF("component", "whole"), "component", "left").select(
        "node", F.coalesce("whole", "component").alias("component"))
    # A root has no row in ``label``: those that moved come from the joined roots.
    return moved.unionByName(joint)


def open_lists(known: DataFrame) -> DataFrame:
    """``h, number``: lists that hold several components, one of those with the same members.

    A passage of some words that the same sets share gives a list for each of its shingles. Such
    lists give the same pairs, so only one travels with its sets' bitmaps. Members are told apart
    by their number and two sums of 64-bit hashes, in halves; subset entries have their own lists.
    """
    halves = [half for seed in (13, 17) for h in [F.xxhash64(F.lit(seed), "key")] for half in (
        h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    sums = [f"s{i}" for i in range(len(halves))]
    lists = known.groupBy("h").agg(
        (F.min("component") != F.max("component")).alias("open"), F.count("*").alias("number"),
        *[F.sum(v).alias(c) for v, c in zip(halves, sums)]).where("open")
    return lists.groupBy(F.col("h").bitwiseAND(F.lit(1)).alias("subset"), "number", *sums).agg(
        F.min("h").alias("h")).select("h", "number")


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their sets' keys, classes, components (``node, component``), linked sets' shingles.

    Documents of one shingle set are one class, represented by one text. Candidates come from
    lists (an entry common to two sets, not both light) and from subset entries (both light).
    First each list links its members with the one of smallest key; where one list still holds
    several components, members meet a few others (``led``), then all pairs across the components
    that remain are compared (``across``). So copies never meet pairwise, and
    no link between components is lost.
    """
    rows = bare(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
                             F.xxhash64("text").alias("content"), "text")

    def survey(batches):
        for b in slices(batches, SLICE // 4):
            yield _survey(b)

    found = saved(rows.mapInArrow(survey, "doc_id long, content long, key long, n long, bits binary, map binary"), "sets_of")
    classes = saved(found.where("n > 0").groupBy("key", "n").agg(
        F.min(F.struct("doc_id", "content")).alias("first"), F.first("bits").alias("bits"),
        F.first("map").alias("map")), "classes")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= LIGHT_AT_MOST)
             .groupBy("n").count().collect()}
    common, lengths = counted(rows)
    light = boundary(sizes, lengths)
    shared = saved(entries(rows, common, light, 1 + total // (2 << 20)), "entries")
    plain = F.col("key").bitwiseAND(F.lit(-2))
    member = shared.select(plain.alias("key"), "h", (F.col("key") != plain).alias("light")).join(
        classes.select("key", "n"), "key")

    def sized(pairs: DataFrame) -> DataFrame:
        return pairs.where(100 * F.least("an", "bn") >= PERCENT * F.greatest("an", "bn"))

    lead = member.groupBy("h").agg(F.min(F.struct("key", "n", "light")).alias("lead"))
    star = member.join(lead, "h").where(F.col("key") != F.col("lead.key"))
    star = star.where((F.col("h").bitwiseAND(F.lit(1)) == 1) | ~(F.col("light") & F.col("lead.light")))
    first = saved(sized(star.select(
        F.col("lead.key").alias("a"), F.col("key").alias("b"), F.col("lead.n").alias("an"),
        F.col("n").alias("bn"))).select("a", "b").distinct(), "pairs")
    links, sets = linked(first, rows, classes)
    label = components(links)
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for candidates in (led, across):
        known = member.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn(
            "component", F.coalesce("component", "key"))
        lists = saved(known.join(open_lists(known), "h"), "open").join(
            classes.select("key", "map"), "key")
        pairs = candidates(lists)
        pairs = saved(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        more, others = linked(pairs, rows, classes)
        sets = sets.unionByName(others.join(sets, "key", "left_anti"))
        label, tried = merged(label, more), tried.unionByName(pairs)
    return found, classes, label, sets


def links_of(docs: DataFrame) -> DataFrame:
    """``a, b``: the smallest ids of each two classes that link, smaller key first, each pair once.

    As many rows as there are links: quadratic in a group of similar texts by its nature. A null id
    stays null.
    """
    _, classes, label, sets = classed(docs)
    ids = classes.select("key", F.nullif("first.doc_id", F.lit(NO_ID)).alias("id"))
    return within(sets, label, True).join(ids.toDF("a", "x"), "a").join(
        ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, n_links, component_id`` for every row.

    ``n_links`` is the number of other shingle sets that the document's set links with, all pairs
    of a component compared (``within``); ``links_of`` gives the pairs themselves.

    Null or wordless text has the empty set: no links, a component of its own (its own id, also
    null). Rows equal in id and text count as one. A null id is larger than all others: it is a
    component's id only where no other id is in it.
    """
    found, classes, label, sets = classed(docs)
    degree = within(sets, label, False)
    label = label.withColumnRenamed("node", "key")
    named = classes.drop("bits", "map").join(label, "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    ids = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    named = named.join(ids, "component").join(degree, "key", "left").select(
        "key", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    real = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.drop("bits", "map").join(named, "key", "left").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.nullif(real, F.lit(NO_ID)).alias("component_id"), "content")


def op3_heavy_light(spark, folder: str) -> DataFrame:
    return join(documents(spark, folder)).drop("content")
