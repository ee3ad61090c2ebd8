"""Brown class-based bigrams: exchange clustering of words, smoothed log probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import (
    bare, documents, joined, longs, mixed, per_row, remainder, saved, slices, word_hashes,
    word_spans)

CLASSES = 48
FREQUENT = 1 / 2000
"""A word with at least this share of the training tokens is a unit of the first exchange: at most
2,000."""
SHAPES = 512
"""Other words start in the class of their form (last letters, length), one of so many units; those
that occur in training then move to a class of their own choice, unknown ones stay."""
SWEEPS = 12
SLICE = 4 << 20
PER_PART = 1 << 21
AT_ONCE = 4096


# ---------------------------------------------------------------- exchange clustering

def _g(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; the last unit is the end of text and keeps the last class to itself.

    Exchange algorithm: units, most frequent first, start in turn in the classes; then each moves
    to the class with the best likelihood of the class bigrams until a sweep moves none. The gain
    of every class comes from the unit's own row and column, so a move costs classes squared.
    """
    n = bigrams.astype(np.float64)
    units, end = len(n), classes
    weight = n.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    where = np.full(units, end)
    where[order] = np.arange(units - 1) % classes
    one = np.zeros((units, classes + 1))
    one[np.arange(units), where] = 1
    right, left = n @ one, n.T @ one
    table = one.T @ right
    size = one.T @ weight
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = where[u], n[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= own
            l[a] -= own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            size[a] -= weight[u]
            rows = _g(table + r) - _g(table)
            cols = _g(table + l[:, None]) - _g(table)
            diag = np.arange(classes + 1)
            gain = rows.sum(1) - rows[diag, diag] + cols.sum(0) - cols[diag, diag]
            both = table[diag, diag]
            gain += _g(both + r + l + own) - _g(both) - 2 * (_g(size + weight[u]) - _g(size))
            gain[end] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            size[b] += weight[u]
            if b != a:
                where[u] = b
                moved += 1
                right[:, a] -= n[:, u]
                right[:, b] += n[:, u]
                left[:, a] -= n[u]
                left[:, b] += n[u]
        if not moved:
            break
    return where


def chosen(table: np.ndarray, old: np.ndarray, weight: np.ndarray, key: np.ndarray,
           times: np.ndarray) -> np.ndarray:
    """Best class of every word, most frequent first, by the gain of ``exchange``.

    ``table`` has the bigrams of classes (the end's last) with every word in its ``old`` class;
    ``weight`` the words' counts. ``key`` and ``times`` are the words' contexts: word times
    ``2 w + 1`` plus the class before, w plus the class behind, or 2 w for the word itself, w being
    the table's side. Words are looked at in steps that grow to ``AT_ONCE``; the table follows their
    moves, as far as it goes with the neighbours in the classes that they had.
    """
    wide = len(table)
    classes, stride, out = wide - 1, 2 * wide + 1, old.copy()
    table, size = table.astype(float), table.sum(1).astype(float)
    order = np.argsort(-weight, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[key // stride] * stride + key % stride
    place = np.argsort(key)
    key, times = key[place], times[place]

    def side(x, y, a, table, logs):
        # Adds x to row b of the table, from which the word itself is taken away.
        i, c = np.nonzero(x)
        n, own, rows = x[i, c], a[i], np.arange(len(i))
        base, was = table.T[c][:, :classes], logs.T[c][:, :classes]
        back = np.flatnonzero(c == own)
        base[back] -= y[i[back], :classes]
        base[rows, own] -= n
        was[back] = _g(base[back])
        was[rows, own] = _g(base[rows, own])
        value = _g(base + n[:, None]) - was
        inner = np.flatnonzero(c < classes)
        value[inner, c[inner]] = 0
        total = np.zeros((len(x), classes))
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][:len(i)])
        if len(first):
            total[i[first]] = np.add.reduceat(value, first)
        return total

    at = 0
    while at < len(order):
        some = order[at:at + min(max(1, at // 8), AT_ONCE)]
        a, w, logs = old[some].astype(np.int64), weight[some].astype(float), _g(table)
        cut = np.searchsorted(key, [at * stride, (at + len(a)) * stride])
        dense = np.zeros(len(a) * stride)
        dense[key[cut[0]:cut[1]] - at * stride] = times[cut[0]:cut[1]]
        dense, rows = dense.reshape(-1, stride), np.arange(len(a))
        left, right, own = dense[:, :wide], dense[:, wide:2 * wide], dense[:, -1:]
        gain = side(right, left, a, table, logs) + side(left, right, a, table.T, logs.T)
        more = left[:, :classes] + right[:, :classes] + own
        both = np.tile(table.diagonal()[:classes], (len(a), 1))
        both[rows, a] -= more[rows, a]
        gain += _g(both + more) - _g(both)
        held = np.tile(size[:classes], (len(a), 1))
        held[rows, a] -= w
        gain -= 2 * (_g(held + w[:, None]) - _g(held))
        best = gain.argmax(1)
        best = np.where(gain[rows, best] > gain[rows, a] + 1e-9, best, a)
        moved = np.flatnonzero(best != a)
        for c, sign in ((a[moved], -1.0), (best[moved], 1.0)):
            to = np.zeros((len(moved), wide))
            to[np.arange(len(moved)), c] = sign
            table += to.T @ right[moved] + left[moved].T @ to + np.diag((to * own[moved]).sum(0))
            size += to.T @ w[moved]
        out[some], at = best, at + len(some)
    return out


def fit_of(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what no class changes."""
    return float(_g(table).sum() - _g(table.sum(0)).sum() - _g(table.sum(1)).sum())


# ---------------------------------------------------------------- corpus passes

def blocks(docs: DataFrame) -> DataFrame:
    """Parsed texts: per block the rows, their words as places in the block's dictionary, and the
    dictionary (word hashes, shapes, training counts).

    A text is parsed once; later passes work on numbers. A word in a block is one entry however
    frequent it is.
    """
    def run(batches):
        from pyspark import TaskContext
        task, seq = TaskContext.get().partitionId(), 0
        for b in slices(batches, SLICE):
            data, at = joined(b.column("text"))
            starts, ends, first = word_spans(data, at)
            h = word_hashes(data, starts, ends, lower=True)
            words, where, place = np.unique(h, return_index=True, return_inverse=True)
            s, e = starts[where], ends[where]
            last = data[e - 1] | np.uint8(32)
            before = data[np.maximum(e - 2, s)] | np.uint8(32)
            shape = mixed(last.astype(np.uint64) << np.uint64(16)
                          | before.astype(np.uint64) << np.uint64(8)
                          | np.minimum(e - s, 12).astype(np.uint64)) % np.uint64(SHAPES)
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            train = np.repeat(~held, np.diff(first))
            count = np.bincount(place[train], minlength=len(words))
            yield pa.RecordBatch.from_arrays([
                longs([(task << 32) + seq]),
                pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([held.astype(np.uint8).tobytes()], pa.binary()),
                pa.array([np.diff(first).astype("<i4").tobytes()], pa.binary()),
                pa.array([place.astype("<i4").tobytes()], pa.binary()),
                pa.array([words.astype("<u8").tobytes()], pa.binary()),
                pa.array([shape.astype("<u2").tobytes()], pa.binary()),
                pa.array([count.astype("<i4").tobytes()], pa.binary()),
                longs([int(train.sum()) + int((~held).sum())]), longs([int((~held).sum())])],
                ["block", "doc_ids", "held", "sizes", "places", "words", "shapes", "counts",
                 "tokens", "ends"])
            seq += 1

    return docs.mapInArrow(run, (
        "block long, doc_ids array<long>, held binary, sizes binary, places binary, words binary, "
        "shapes binary, counts binary, tokens long, ends long"))


def frequent(parsed: DataFrame, total: int) -> np.ndarray:
    """Sorted words with at least the share ``FREQUENT`` of the training tokens, by exact counts.

    Such a word has that share in some block too, so only those words are counted.
    """
    def some(batches):
        for b in batches:
            for n, w, c in zip(*(b.column(x) for x in ("tokens", "words", "counts"))):
                count = np.frombuffer(c.as_py(), "<i4")
                often = (count > 0) & (count >= n.as_py() * FREQUENT)
                yield pa.RecordBatch.from_arrays(
                    [longs(np.frombuffer(w.as_py(), "<i8")[often])], ["word"])

    wanted = np.sort(np.array([r["word"] for r in parsed.select("tokens", "words", "counts")
                               .mapInArrow(some, "word long").distinct().collect()], "<i8").view("<u8"))
    if not len(wanted):
        return wanted

    def add(batches):
        out = np.zeros(len(wanted), np.int64)
        for b in batches:
            for w, c in zip(b.column("words"), b.column("counts")):
                words, count = np.frombuffer(w.as_py(), "<u8"), np.frombuffer(c.as_py(), "<i4")
                at = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
                hit = wanted[at] == words
                out[at[hit]] += count[hit]
        found = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([longs(wanted.view("<i8")[found]), longs(out[found])],
                                         ["word", "n"])

    rows = parsed.select("words", "counts").mapInArrow(add, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= total * FREQUENT).collect()
    return np.sort(np.array([r["word"] for r in rows], "<i8").view("<u8"))


def contexts(line: np.ndarray, of: np.ndarray, train: np.ndarray, wide: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Keys (as in ``chosen``, by places in the dictionary) and counts of the words' contexts.

    ``line`` has the places of the words, that of the end being the last; ``of`` their classes.
    """
    end, stride = len(of) - 1, 2 * wide + 1
    before, at = np.r_[end, line[:-1]][train], line[train]
    same = before == at
    left, right = (at != end) & ~same, (before != end) & ~same
    return np.unique(np.concatenate([
        at[left] * stride + of[before[left]], before[right] * stride + wide + of[at[right]],
        at[same & (at != end)] * stride + 2 * wide]), return_counts=True)


def vocabulary(parsed: DataFrame, total: int, often: np.ndarray, where: np.ndarray,
               table: np.ndarray) -> DataFrame:
    """Counts and classes of every block's words over the whole corpus, and statistics of each part.

    Dictionary entries are dealt out by ranges of the word hash, which is the dictionaries' order,
    with the classes around each word in the block. There they are summed, and every training word
    takes the class that fits its contexts best (``table``: class bigrams with all words in the
    class of their unit, ``where``). Rows with a block carry counts and classes back in the order
    in which the block sent them, rows without one carry statistics.
    """
    parts = 1 + total // PER_PART           # whatever the blocks: classes depend on the parts
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype("<u8")
    wide = len(table)
    stride = 2 * wide + 1

    def deal(batches):
        for b in batches:
            for block, held, sizes, places, w, s, c in zip(*(b.column(x) for x in (
                    "block", "held", "sizes", "places", "words", "shapes", "counts"))):
                words = np.frombuffer(w.as_py(), "<u8")
                shape, count = np.frombuffer(s.as_py(), "<u2"), np.frombuffer(c.as_py(), "<i4")
                sizes = np.frombuffer(sizes.as_py(), "<i4")
                line, _ = _walk(sizes, np.frombuffer(places.as_py(), "<i4"), len(words))
                train = np.repeat(np.frombuffer(held.as_py(), np.uint8) == 0, sizes + 1)
                of = np.r_[where[units_of(words, shape, often)], wide - 1]
                key, times = contexts(line, of, train, wide)
                slot = (key % stride).astype("u1")
                around = np.bincount(key // stride, minlength=len(words)).astype("u1")
                cut = np.r_[0, np.searchsorted(words, edges), len(words)]
                first = np.searchsorted(key, cut * stride)
                some = [p for p in range(parts) if cut[p] < cut[p + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), longs([block.as_py()] * len(some)),
                    *(pa.array([x[cut[p]:cut[p + 1]].tobytes() for p in some], pa.binary())
                      for x in (words, shape, count, around)),
                    *(pa.array([x[first[p]:first[p + 1]].tobytes() for p in some], pa.binary())
                      for x in (slot, times.astype("<i4")))],
                    ["part", "block", "words", "shapes", "counts", "around", "slots", "times"])

    def add(group: pa.Table) -> pa.Table:
        words, shape, count, around, slots, times = (
            np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (
                ("words", "<u8"), ("shapes", "<u2"), ("counts", "<i4"), ("around", "u1"),
                ("slots", "u1"), ("times", "<i4")))
        words, at, place = np.unique(words, return_index=True, return_inverse=True)
        count = np.bincount(place, count, len(words)).astype(np.int64)
        known, shape = count > 0, shape[at]
        key, of = np.unique(np.repeat(place, around) * stride + slots, return_inverse=True)
        old = where[units_of(words, shape, often)].astype("u1")
        new = chosen(table, old, count, key, np.bincount(of, times, len(key)))
        sizes = [len(x) // 8 for x in group.column("words").to_pylist()]

        def back(x: np.ndarray) -> pa.Array:
            return pa.array([*(v.tobytes() for v in np.split(x[place], np.cumsum(sizes)[:-1])), None],
                            pa.binary())
        stats = [known.sum(), (count == 1).sum(), (count == 2).sum(), (old != new).sum()]
        kinds = [np.bincount(x[known], minlength=wide) for x in (old, new)]
        return pa.table({
            "part": pa.array([int(group.column("part")[0].as_py())] * (len(sizes) + 1), pa.int32()),
            "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()),
            "counts": back(count.astype("<i8")), "old": back(old), "new": back(new),
            "stats": pa.array([None] * len(sizes) + [np.concatenate([stats, *kinds]).astype(
                "<i8").tobytes()], pa.binary())})

    return parsed.select("block", "held", "sizes", "places", "words", "shapes", "counts").mapInArrow(
        deal, "part int, block long, words binary, shapes binary, counts binary, around binary, "
              "slots binary, times binary").groupBy("part").applyInArrow(
        add, "part int, block long, counts binary, old binary, new binary, stats binary")


def sent_back(found: DataFrame, *columns: str) -> DataFrame:
    """One row a block: what the parts say of its words, in the order of its dictionary."""
    return found.where("block is not null").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("part", *columns))).alias("back"))


def _told(back, column: str, kind: str) -> np.ndarray:
    """What the parts say in one column of ``sent_back``, end to end."""
    return np.frombuffer(b"".join(r[column] for r in back.as_py() or []), kind)


def class_bigrams(parsed: DataFrame, found: DataFrame, wide: int) -> np.ndarray:
    """Training bigrams of the classes that the words have chosen, ends included."""
    def run(batches):
        total = np.zeros(wide * wide, np.int64)
        for b in batches:
            for held, sizes, places, back in zip(*(b.column(c) for c in (
                    "held", "sizes", "places", "back"))):
                of = np.r_[_told(back, "new", "u1"), np.uint8(wide - 1)].astype(np.int64)
                sizes = np.frombuffer(sizes.as_py(), "<i4")
                line, _ = _walk(sizes, np.frombuffer(places.as_py(), "<i4"), len(of) - 1)
                train = np.repeat(np.frombuffer(held.as_py(), np.uint8) == 0, sizes + 1)
                c = of[line]
                total += np.bincount((np.r_[wide - 1, c[:-1]] * wide + c)[train],
                                     minlength=wide * wide)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    rows = parsed.select("block", "held", "sizes", "places").join(
        sent_back(found, "new"), "block", "left").drop("block").mapInArrow(run, "n binary").collect()
    return sum((np.frombuffer(bytes(r["n"]), "<i8") for r in rows),
               np.zeros(wide * wide, np.int64)).reshape(wide, wide)


def units_of(words: np.ndarray, shapes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Unit of each word: its place among the (sorted) frequent words, else its shape behind them."""
    if not len(often):
        return shapes.astype(np.int64)
    at = np.minimum(np.searchsorted(often, words), len(often) - 1)
    return np.where(often[at] == words, at, len(often) + shapes.astype(np.int64))


def _walk(sizes: np.ndarray, units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of all rows, one end behind each, and the place of each row's end."""
    close = np.cumsum(sizes + 1) - 1
    out = np.empty(len(units) + len(sizes), np.int64)
    word = np.ones(len(out), bool)
    word[close] = False
    out[close] = end
    out[word] = units
    return out, close


def bigram_counts(parsed: DataFrame, often: np.ndarray) -> np.ndarray:
    """Training bigrams of units (ends of text included), summed per task, then in Spark by row.

    The matrix has a side of at most 1/FREQUENT + SHAPES + 1, whatever the corpus.
    """
    side = len(often) + SHAPES + 1

    def run(batches):
        total = np.zeros(side * side, np.int64)
        for b in batches:
            for held, sizes, places, words, shapes in zip(*(b.column(c) for c in (
                    "held", "sizes", "places", "words", "shapes"))):
                unit = units_of(np.frombuffer(words.as_py(), "<u8"),
                                np.frombuffer(shapes.as_py(), "<u2"), often)
                sizes = np.frombuffer(sizes.as_py(), "<i4")
                line, close = _walk(sizes, unit[np.frombuffer(places.as_py(), "<i4")], side - 1)
                before = np.r_[side - 1, line[:-1]]
                train = np.repeat(np.frombuffer(held.as_py(), np.uint8) == 0, sizes + 1)
                total += np.bincount((before * side + line)[train], minlength=side * side)
        rows = total.reshape(side, side)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [longs(some), pa.array([rows[i].astype("<i8").tobytes() for i in some], pa.binary())],
            ["unit", "n"])

    def add(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, "<i8") for x in table.column("n").to_pylist())
        return pa.table({"unit": table.column("unit").slice(0, 1), "n": pa.array(
            [n.tobytes()], pa.binary())})

    out = np.zeros((side, side), np.int64)
    for r in (parsed.select("held", "sizes", "places", "words", "shapes").mapInArrow(
            run, "unit long, n binary").groupBy("unit").applyInArrow(add, "unit long, n binary")
            .collect()):
        out[r["unit"]] = np.frombuffer(bytes(r["n"]), "<i8")
    return out


def model_of(table: np.ndarray, kinds: np.ndarray, once: int, twice: int) -> dict:
    """Of class bigrams and training types per class: log10 transitions, per class tokens, discount.

    P(c'|c) = (n(c,c') + K P(c')) / (n(c) + K). P(w|c) = (n(w) - D) / n(c); what D takes from a
    class's types is the probability of its unknown word (one event, as in the base score), so
    words and the unknown one of a class sum to 1. D = n1 / (n1 + 2 n2).
    """
    classes, n = len(table) - 1, table.astype(np.float64)
    size = n.sum(1)
    share = (n.sum(0) + 1) / (n.sum() + classes + 1)
    follow = np.log10((n + classes * share) / (size[:, None] + classes))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    tokens = n.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        unknown = np.where((tokens > 0) & (kinds > 0), np.log10(discount * kinds / tokens), 0.0)
        log_tokens = np.where(tokens > 0, np.log10(tokens), 0.0)
    return {"follow": follow, "discount": discount, "unknown": unknown, "tokens": log_tokens}


def score(docs: DataFrame) -> DataFrame:
    """Score every whole text; learn from rows whose ``held_out`` is false.

    Frequent words and forms are exchanged until none moves; then every training word takes the
    class that its own contexts ask for. That step is kept if the likelihood rises.

    ``docs`` has ``doc_id, held_out, text`` (bytes). Rows stand by themselves, so repeated rows
    repeat; null or empty text is just an end. With nothing to learn from, the base score is 0 per
    token and the model knows only the unknown word.
    """
    parsed = saved(blocks(docs), "blocks")
    total, ends = parsed.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "ends")]).first()
    often = frequent(parsed, total)
    bigrams = bigram_counts(parsed, often)
    where = exchange(bigrams)
    wide = CLASSES + 1
    one = np.zeros((len(where), wide))
    one[np.arange(len(where)), where] = 1
    table = one.T @ bigrams @ one
    found = saved(vocabulary(parsed, total, often, where, table), "vocabulary")
    sums = sum((np.frombuffer(bytes(r["stats"]), "<i8") for r in found.where(
        "block is null").select("stats").collect()), np.zeros(4 + 2 * wide, np.int64))
    known_types, held = int(sums[0]) + (ends > 0), "old"
    if sums[3]:
        after = class_bigrams(parsed, found, wide)
        if fit_of(after) > fit_of(table):
            table, held = after, "new"
    kinds = sums[4:].reshape(2, wide)[int(held == "new")]
    model = model_of(table, kinds, int(sums[1]), int(sums[2]))
    base_below = np.log10(total + known_types + 1)
    end_count = ends

    def run(batches):
        m = model
        for b in batches:
            for names, was, sizes, places, back in zip(*(b.column(c) for c in (
                    "doc_ids", "held", "sizes", "places", "back"))):
                count, of = _told(back, "counts", "<i8"), _told(back, held, "u1").astype(np.int64)
                with np.errstate(divide="ignore"):
                    emit = np.where(count > 0, np.log10(np.maximum(count - m["discount"], 1e-9))
                                    - m["tokens"][of], m["unknown"][of])
                base = np.log10(count + 1) - base_below
                place, sizes = np.frombuffer(places.as_py(), "<i4"), np.frombuffer(
                    sizes.as_py(), "<i4")
                line, close = _walk(sizes, place, len(count))
                of, emit = np.r_[of, CLASSES], np.r_[emit, 0.0]
                base = np.r_[base, np.log10(end_count + 1) - base_below]
                known = np.r_[count > 0, end_count > 0]
                c = of[line]
                value = m["follow"][np.r_[CLASSES, c[:-1]], c] + emit[line]
                first = np.r_[0, close + 1]
                row = np.repeat(np.arange(len(sizes)), sizes + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names.as_py(), pa.int64()),
                    pa.array(np.frombuffer(was.as_py(), np.uint8) == 1),
                    longs(sizes.astype(np.int64) + 1), longs(per_row(known[line], first)),
                    longs([total] * len(sizes)), pa.array(np.bincount(row, base[line], len(sizes))),
                    pa.array(np.bincount(row, value, len(sizes)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                     "score"])

    return parsed.select("block", "doc_ids", "held", "sizes", "places").join(
        sent_back(found, "counts", held), "block", "left").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")


def op1_brown(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    return score(bare(docs, "held_out"))
