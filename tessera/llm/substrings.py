"""Substring dedup by level-wise doubling: only windows repeated at one length are looked at again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tessera.llm.anchors import attach, contents, keyed, lists, picks, repeated, sieve
from tessera.llm.common import (
    NO_ID, documents, joined, longs, mixed, per_row, rolled, saved, slices, word_hashes,
    word_spans)

WINDOW = 35
SLICE = 2 << 20
PER_PART = 1 << 20


def _words(b: pa.RecordBatch):
    data, at = joined(b.column("text"))
    starts, ends, first = word_spans(data, at)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def _half(window: int) -> int:
    return (window + 1) // 2


def level(rows: DataFrame, window: int, bytes_total: int) -> DataFrame:
    """``content, hs``: anchors of half the window length that repeat: the level below."""
    def hashes(batches):
        for b in slices(batches, SLICE):
            *_, first, h = _words(b)
            _, place = picks(h, first, _half(window), window)
            place = np.unique(place)
            g = rolled(h, _half(window))
            owner = np.searchsorted(first, place, side="right") - 1
            yield g[place], b.column("content").to_numpy()[owner]
    return repeated(rows, hashes, 1 + bytes_total // (40 * PER_PART))


def doubled(texts: DataFrame, window: int, parts: int) -> DataFrame:
    """``content, start, end`` (windows as runs of starts): windows of full length that repeat.

    ``texts`` has ``content, text, hs``. Windows whose anchor is not in ``hs`` are not candidates.
    Those of one anchor meet in one part, dealt out by the anchor; a window found twice within a
    slice is known to repeat, so that a slice sends each window's hash once, however often it is
    there, and passes its places on, dealt out by content.
    """
    half = _half(window)
    kinds = "part int, kind byte, h binary, content binary, start binary"

    def run(batches):
        for b in slices(batches, SLICE):
            *_, first, h = _words(b)
            starts, place = picks(h, first, half, window)
            row = np.searchsorted(first, starts, side="right") - 1
            g = rolled(h, half)[place]
            values, at = lists(b.column("hs"), b.num_rows)
            salt = mixed(np.arange(1, b.num_rows + 1, dtype=np.uint64))
            wanted = values.view(np.uint64) ^ np.repeat(salt, np.diff(at))
            keep = np.isin(g ^ salt[row], wanted)
            starts, row, g = starts[keep], row[keep], g[keep]
            if not len(starts):
                continue
            full = rolled(h, window)[starts]
            content = b.column("content").to_numpy()[row]
            inside = starts - first[row]
            order = np.lexsort((inside, content, full))
            full, content, inside, g = (x[order] for x in (full, content, inside, g))
            new = np.r_[True, (full[1:] != full[:-1]) | (content[1:] != content[:-1])
                        | (inside[1:] != inside[:-1])]
            full, content, inside, g = (x[new] for x in (full, content, inside, g))
            same = np.r_[False, full[1:] == full[:-1]]
            group = np.cumsum(~same) - 1
            many = (np.bincount(group) > 1)[group]
            rows = []
            for kind, some, by in ((0, ~many, mixed(g)), (1, many, mixed(content.view(np.uint64))),
                                   (2, many & ~same, mixed(g))):
                part = (by[some] % np.uint64(parts)).astype(np.int64)
                o = np.lexsort((inside[some], content[some], part))
                f, c, i, part = full[some][o], content[some][o], inside[some][o], part[o]
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
                for x, y in zip(cut, [*cut[1:], len(part)]):
                    rows.append((int(part[x]), kind, f[x:y].tobytes() if kind != 1 else b"",
                                 c[x:y].tobytes() if kind != 2 else b"",
                                 i[x:y].astype(np.int32).tobytes() if kind != 2 else b""))
            p, k, f, c, i = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(k, pa.int8()), pa.array(f, pa.binary()),
                 pa.array(c, pa.binary()), pa.array(i, pa.binary())],
                ["part", "kind", "h", "content", "start"])

    def settle(table: pa.Table) -> pa.Table:
        side = {}
        for kind in range(3):
            rows = table.filter(pa.compute.equal(table.column("kind"), kind))
            side[kind] = [np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (
                ("h", np.uint64), ("content", np.int64), ("start", np.int32))]
        h, c, s = side[0]
        order = np.lexsort((s, c, h))
        h, c, s = h[order], c[order], s[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        h, c, s = h[new], c[new], s[new]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[:-1] |= again[1:].copy()
        again |= np.isin(h, side[2][0])
        c, s = np.r_[c[again], side[1][1]], np.r_[s[again], side[1][2]].astype(np.int64)
        order = np.lexsort((s, c))
        c, s = c[order], s[order]
        begin = np.ones(len(c), bool)
        begin[1:] = (c[1:] != c[:-1]) | (s[1:] > s[:-1] + 1)
        stop = np.r_[begin[1:], True][:len(c)]
        return pa.table({"content": longs(c[begin]), "start": longs(s[begin]),
                         "end": longs(s[stop] + 1)})

    return texts.select("content", "text", "hs").mapInArrow(run, kinds).groupBy(
        "part").applyInArrow(settle, "content long, start long, end long")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (kept words joined by a space, as bytes).

    A word goes if a window over it has a word sequence that starts anywhere else. The climb
    begins at half the window's length, at the anchors; windows whose half repeats are extended to
    the full length, and none else. Longer lengths could not change which words are covered.

    Texts of one content are one document in the search; if several documents have it, every
    window of theirs repeats. Rows equal in id and text are one document, and each row gets its
    result; a null id counts as one more id. Null or short texts have no window and stay whole.
    """
    rows = keyed(docs)
    size = rows.agg(F.sum(F.length("text")), F.count("*")).first()[0] or 0
    names = saved(contents(rows), "contents")
    anchors = level(rows, window, size)
    parts = 1 + size // (12 * PER_PART)
    alone = names.where("doc_id = first").select("doc_id", "content")
    wanted = saved(anchors.join(alone, "content"), "anchors")
    texts = sieve(rows, wanted).join(wanted.hint("shuffle_hash"), ["doc_id", "content"])
    runs = (doubled(texts, window, parts).groupBy("content")
            .agg(F.collect_list("start").alias("from"), F.collect_list("end").alias("to")))
    what = (names.where("not shared").join(runs, "content").select(
        "doc_id", "content", F.lit(False).alias("all"), "from", "to")
        .unionByName(names.where("shared").select(
            "doc_id", "content", F.lit(True).alias("all"),
            F.array().cast("array<long>").alias("from"), F.array().cast("array<long>").alias("to"))))

    def run(batches):
        for b in slices(batches, SLICE):
            data, at = joined(b.column("text"))
            starts, ends, first = word_spans(data, at)
            n = np.diff(first)
            mark = np.zeros(len(starts) + 1, np.int64)
            (a, rows_at), (z, _) = lists(b.column("from"), b.num_rows), lists(
                b.column("to"), b.num_rows)
            shift = np.repeat(first[:-1], np.diff(rows_at))
            np.add.at(mark, a + shift, 1)
            np.add.at(mark, z - 1 + window + shift, -1)
            gone = np.cumsum(mark[:-1]) > 0
            every = pa.compute.fill_null(b.column("all"), False).to_numpy(zero_copy_only=False)
            gone |= np.repeat(every.astype(bool) & (n >= window), n)
            text, kept = data.tobytes(), []
            for i in range(b.num_rows):
                words = text[at[i]:at[i + 1]].split()
                if gone[first[i]:first[i + 1]].any():
                    words = [w for w, g in zip(words, gone[first[i]:first[i + 1]].tolist()) if not g]
                kept.append(b" ".join(words))
            ids = b.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NO_ID), longs(n), longs(per_row(gone, first)),
                 pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return attach(rows, saved(what, "removals")).select(
        "doc_id", "all", "from", "to", "text").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept binary")


def op10_substrings(spark, folder: str) -> DataFrame:
    return remove(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
