"""Suffix-array dedup: repeated byte strings, suffixes ordered by linear grouping construction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tessera.llm.anchors import attach, contents, keyed, lists, picks, repeated, sieve
from tessera.llm.common import (
    NO_ID, _BYTE, documents, joined, longs, mixed, rolled, saved, slices, word_hashes)

LENGTH = 100
GRAM = 32
SLICE = 1 << 20
SYMBOL = 8


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol is its only smallest one.

    Suffixes start in groups of equal first symbol. Groups are taken from the largest to the
    smallest. For each suffix of a group, the previous smaller suffix (the nearest one to the left
    that lies in a lower group) has the group's Lyndon prefix behind its own: such suffixes leave
    their group for new groups right above it, more repeats of the prefix higher. When the last
    group is done, a group holds the suffixes with one longest Lyndon prefix. The second phase
    emits suffixes in order: whatever has its next smaller suffix at the one emitted takes the
    next place of its group. No names are given and nothing is sorted again.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, {}
    start = 0
    for at, i in enumerate(order):
        if at and text[i] != text[order[at - 1]]:
            start = at
        place[i], group[i] = at, start
        size[start] = at - start + 1
    prev = [-1] * n
    top = n
    while top:
        g = group[order[top - 1]]
        hits: dict[int, int] = {}
        for i in sorted(order[g:top]) if top - g > 1 else order[g:top]:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in hits.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[k]:
                h = group[p]
                done = moved.setdefault(h, [])
                done.append(p)
                a, b = place[p], h + size[h] - len(done)
                other = order[b]
                order[a], order[b], place[other], place[p] = other, p, a, b
            for h, members in moved.items():
                if len(members) < size[h]:
                    size[h] -= len(members)
                    new = h + size[h]
                    size[new] = len(members)
                    for p in members:
                        group[p] = new
        top = g
    out, used, placed = [0] * n, dict.fromkeys(size, 0), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        p = out[at] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[g + used[g]] = p
            used[g] += 1
            placed[p] = True
            p = prev[p]
    return out


def ordered(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (fixed-width bytes) and the bytes each shares with the one before it.

    Rows become words of eight bytes over the alphabet of their words, one text, one suffix array.
    """
    rows, width = strings.shape
    words = np.ascontiguousarray(strings).view(f">u{SYMBOL}").reshape(rows, -1)
    names = np.searchsorted(np.unique(words), words) + 2
    text = np.concatenate([names, np.ones((rows, 1), np.int64)], 1).ravel().tolist() + [0]
    step = width // SYMBOL + 1
    sa = np.array(suffix_array(text))
    order = sa[(sa % step == 0) & (sa < rows * step)] // step
    same = strings[order[1:]] == strings[order[:-1]]
    shared = np.where(same.all(1), width, np.argmin(same, 1))
    return order, np.r_[0, shared]


def _classes(strings: np.ndarray, size: np.ndarray, gram: np.ndarray):
    """Function from a prefix length to class numbers of the rows: equal class, equal prefix.

    Only grams under which different strings come need an order; elsewhere the gram tells all.
    ``size`` is the true length of each row; a longer prefix is no row's.
    """
    both = np.concatenate([gram.view(np.uint8).reshape(-1, 8), strings], 1)
    _, first, inverse = np.unique(np.ascontiguousarray(both).view(f"V{both.shape[1]}").ravel(),
                                  return_index=True, return_inverse=True)
    _, where, count = np.unique(gram[first], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(count[where] > 1)
    if not len(open_):
        return lambda length: where[inverse]
    order, shared = ordered(strings[first][open_])
    base = len(count)

    def classes(length: int) -> np.ndarray:
        out = where.astype(np.int64)
        if length:
            out[open_[order]] = base + np.cumsum(shared < length)
        return out[inverse]
    return classes


def later(table: pa.Table, length: int = LENGTH, gram: int = GRAM) -> pa.Table:
    """Windows (runs of starts) that also start earlier, among one part's anchors."""
    known = table.filter(pa.compute.is_null(table.column("bytes")))
    out = [(known.column("content").to_numpy(), known.column("at").to_numpy()
            - known.column("most").to_numpy(), known.column("at").to_numpy()
            - known.column("least").to_numpy())]
    rows = table.filter(pa.compute.is_valid(table.column("bytes")))
    if rows.num_rows:
        doc, content, at, g, least, most, left = (rows.column(c).to_numpy() for c in (
            "doc_id", "content", "at", "gram", "least", "most", "left"))
        o = np.lexsort((at, content, doc))
        doc, content, at, g, least, most, left = (x[o] for x in (
            doc, content, at, g, least, most, left))
        data = rows.column("bytes").to_pylist()
        side = -(-(length - gram) // SYMBOL) * SYMBOL
        after = -(-length // SYMBOL) * SYMBOL
        before = np.zeros((len(o), side), np.uint8)
        behind = np.zeros((len(o), after), np.uint8)
        n_behind = np.zeros(len(o), np.int64)
        for r, (i, k) in enumerate(zip(o.tolist(), left.tolist())):
            b = np.frombuffer(data[i], np.uint8)
            before[r, :k] = b[:k][::-1]
            behind[r, :len(b) - k] = b[k:]
            n_behind[r] = len(b) - k
        left_class, right_class = _classes(before, left, g), _classes(behind, n_behind, g)
        for d in range(length - gram + 1):
            some = np.flatnonzero((least <= d) & (d <= most))
            if not len(some):
                continue
            key = left_class(d)[some] << 32 | right_class(length - d)[some]
            _, first = np.unique(key, return_index=True)
            gone = np.ones(len(some), bool)
            gone[first] = False
            gone = some[gone]
            out.append((content[gone], at[gone] - d, at[gone] - d))
    c, a, z = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((a, c))
    c, a, z = c[order], a[order], z[order]
    # Runs of one part never overlap but at equal rows, so neighbours are joined by their ends.
    begin = np.ones(len(c), bool)
    begin[1:] = (c[1:] != c[:-1]) | (a[1:] > z[:-1] + 1)
    stop = np.r_[begin[1:], True][:len(c)]
    return pa.table({"content": longs(c[begin]), "start": longs(a[begin]), "end": longs(z[stop] + 1)})


def spans(texts: DataFrame, parts: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``content, start, end``: runs of window starts whose string also starts earlier.

    ``texts`` has ``doc_id, content, text, hs``, one row per content, that of its first document.
    Each anchor in ``hs`` goes to its gram's part with the bytes around it, the only ones that its
    windows can cover. What a slice has in the same surroundings before is known to be later: it
    passes through, dealt out by content, so a passage of any frequency is sent once per slice.
    """
    def run(batches):
        for b in slices(batches, SLICE):
            b = b.take(pa.compute.sort_indices(b, [("doc_id", "ascending"),
                                                   ("content", "ascending")]))
            data, at = joined(b.column("text"))
            h = _BYTE[data]
            starts, place = picks(h, at, gram, length)
            if not len(starts):
                continue
            row = np.searchsorted(at, starts, side="right") - 1
            cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
            low, high = starts[cut], starts[np.r_[cut[1:], len(starts)] - 1]
            place, row = place[cut], row[cut]
            g = rolled(h, gram)[place]
            values, hs_at = lists(b.column("hs"), b.num_rows)
            salt = mixed(np.arange(1, b.num_rows + 1, dtype=np.uint64))
            keep = np.isin(g ^ salt[row], values.view(np.uint64) ^ np.repeat(salt, np.diff(hs_at)))
            low, high, place, row, g = low[keep], high[keep], place[keep], row[keep], g[keep]
            if not len(g):
                continue
            a = np.maximum(place - (length - gram), at[row])
            z = np.minimum(place + length, at[row + 1])
            look = word_hashes(data, a, z) ^ mixed((place - a).astype(np.uint64) + np.uint64(9)) ^ g
            order = np.argsort(look, kind="stable")
            copy = np.zeros(len(g), bool)
            copy[order[1:]] = look[order[1:]] == look[order[:-1]]
            content = b.column("content").to_numpy()[row]
            by = np.where(copy, mixed(content.view(np.uint64)), g)
            text = data.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array((by % np.uint64(parts)).astype(np.int32)),
                b.column("doc_id").take(pa.array(row)), longs(content), longs(place - at[row]),
                longs(g.view(np.int64)), pa.array((place - high).astype(np.int32)),
                pa.array((place - low).astype(np.int32)), pa.array((place - a).astype(np.int32)),
                pa.array([None if c else text[i:j] for c, i, j in zip(
                    copy.tolist(), a.tolist(), z.tolist())], pa.binary())],
                ["part", "doc_id", "content", "at", "gram", "least", "most", "left", "bytes"])

    return texts.select("doc_id", "content", "text", "hs").mapInArrow(run, (
        "part int, doc_id long, content long, at long, gram long, least int, most int, left int, "
        "bytes binary")).groupBy("part").applyInArrow(
        lambda t: later(t, length, gram), "content long, start long, end long")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: bytes covered by strings seen earlier are cut.

    Earlier is a smaller doc_id, or an earlier start in the document. A later document of equal
    text is covered as a whole; the first one stands for the content. Rows equal in id and text
    are one document, each row gets its result. Null ids come after all others, by content key.
    Null and short texts have no string of this length and stay whole.
    """
    rows = keyed(docs)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    names = saved(contents(rows), "contents")

    def hashes(batches):
        for b in slices(batches, SLICE):
            data, at = joined(b.column("text"))
            h = _BYTE[data]
            _, place = picks(h, at, gram, length)
            place = np.unique(place)
            owner = np.searchsorted(at, place, side="right") - 1
            yield rolled(h, gram)[place], b.column("content").to_numpy()[owner]

    anchors = repeated(rows, hashes, 1 + size // (40 << 20))
    alone = names.where("doc_id = first").select("doc_id", "content")
    wanted = saved(anchors.join(alone, "content"), "anchors")
    texts = sieve(rows, wanted).join(wanted.hint("shuffle_hash"), ["doc_id", "content"])
    runs = (spans(texts, 1 + size // (12 << 20), length, gram).groupBy("content")
            .agg(F.collect_list("start").alias("from"), F.collect_list("end").alias("to")))
    none = F.array().cast("array<long>")
    what = (alone.join(runs, "content").select(
        "doc_id", "content", F.lit(False).alias("all"), "from", "to")
        .unionByName(names.where("doc_id <> first").select(
            "doc_id", "content", F.lit(True).alias("all"), none.alias("from"), none.alias("to"))))

    def run(batches):
        for b in slices(batches, SLICE):
            data, at = joined(b.column("text"))
            n = np.diff(at)
            mark = np.zeros(len(data) + 1, np.int32)
            (a, rows_at), (z, _) = lists(b.column("from"), b.num_rows), lists(
                b.column("to"), b.num_rows)
            shift = np.repeat(at[:-1], np.diff(rows_at))
            np.add.at(mark, a + shift, 1)
            np.add.at(mark, z - 1 + length + shift, -1)
            gone = np.cumsum(mark[:-1]) > 0
            every = pa.compute.fill_null(b.column("all"), False).to_numpy(zero_copy_only=False)
            gone |= np.repeat(every.astype(bool) & (n >= length), n)
            first = np.zeros(len(data), bool)
            first[at[:-1][n > 0]] = True
            begin = gone & (first | ~np.r_[False, gone[:-1]])
            total = np.r_[0, np.cumsum(gone)]
            begun = np.r_[0, np.cumsum(begin)]
            left = data[~gone].tobytes()
            kept_at = at - total[at]
            ids = b.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NO_ID), longs(n), longs(np.diff(total[at])),
                 longs(np.diff(begun[at])),
                 pa.array([left[i:j] for i, j in zip(kept_at, kept_at[1:])], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return attach(rows, saved(what, "removals")).select(
        "doc_id", "all", "from", "to", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_array(spark, folder: str) -> DataFrame:
    return remove(documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
