"""Line sequence labelling: a linear-chain conditional random field marks content lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import (
    bare, documents, joined, longs, mixed, per_row, rolled, slices, table_of, word_hashes,
    word_spans)

# The characters that the base count takes as symbols.
SYMBOLS = table_of("#*$%&|<>")
_MARKS = table_of("#*$%&|<>!=_~^{}[]\\/@+")
_UPPER, _LOWERS, _DIGITS = (table_of("".join(map(chr, range(a, b)))) for a, b in (
    (65, 91), (97, 123), (48, 58)))
_STOPS = table_of(".?!:;,\"')")

FEATURES = ["bias", "short", "long", "shouting", "marks", "many_marks", "digits", "stop_at_end",
            "capital_start", "copy_of_earlier", "few_different_words", "one_word_again", "cue",
            "long_words"]
# Beginnings of lines that pages repeat.
_CUES = [b"copyright", b"licensed under", b"all rights reserved", b"cookie", b"privacy policy",
         b"terms of", b"subscribe", b"sign in", b"log in", b"click here", b"share this"]
SAMPLE_DOCS = 3000
KEEP_SHARE = 0.5


def measure(data: np.ndarray, at: np.ndarray) -> tuple[dict, dict]:
    """Counts per row and features per line with a word, for rows' bytes end to end."""
    starts, ends, first = word_spans(data, at)
    rows = len(at) - 1
    words = np.diff(first)
    h = word_hashes(data, starts, ends)
    row_of = np.repeat(np.arange(rows), words)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    in_word = np.cumsum(inside[:-1]).astype(bool)
    out = {"n_words": words, "word_chars": per_row(in_word & ((data & 0xC0) != 0x80), at),
           "n_symbols": per_row(SYMBOLS[data], at)}

    cover = np.zeros(len(h), bool)
    if len(h) >= 3:
        win = rolled(h, 3)
        whole = row_of[:-2] == row_of[2:]
        key = mixed(win[whole] ^ mixed(row_of[:-2][whole].astype(np.uint64) + np.uint64(1)))
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        again = np.flatnonzero(whole)[n[inverse] > 1]
        for k in range(3):
            cover[again + k] = True
    out["n_repeat_words"] = per_row(cover, first)

    breaks = np.flatnonzero(data == 10)
    a = np.sort(np.r_[at[:-1], breaks + 1])
    b = np.sort(np.r_[breaks, at[1:]])
    line_row = np.repeat(np.arange(rows), per_row(data == 10, at) + 1)
    w0, w1 = np.searchsorted(starts, a), np.searchsorted(starts, b)
    full = w1 > w0
    a, b, w0, w1, line_row = a[full], b[full], w0[full], w1[full], line_row[full]
    line_hash = word_hashes(data, a, b)
    key = mixed(line_hash ^ mixed(line_row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    copy = np.zeros(len(key), bool)
    if len(key):
        copy[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_row[copy], minlength=rows)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total[b] - total[a]

    n, size = w1 - w0, np.maximum(b - a, 1)
    line_of = np.repeat(np.arange(len(a)), n)
    pair = mixed(h ^ mixed(line_of.astype(np.uint64) + np.uint64(1)))
    _, where, count = np.unique(pair, return_index=True, return_counts=True)
    different = np.bincount(line_of[where], minlength=len(a))
    most = np.zeros(len(a), np.int64)
    np.maximum.at(most, line_of[where], count)
    upper, lower, digits, marks = map(share, (_UPPER, _LOWERS, _DIGITS, _MARKS))
    cue = np.zeros(len(a), bool)
    text = data.tobytes().lower()
    for c in _CUES:
        p = text.find(c)
        while p >= 0:
            k = int(np.searchsorted(a, p, side="right")) - 1
            cue[k] |= k >= 0 and p < b[k]
            p = text.find(c, p + 1)
    last_word_end = ends[np.maximum(w1 - 1, 0)] if len(ends) else b
    x = np.stack([
        np.ones(len(a), bool), n <= 3, n >= 8, upper > lower, marks * 50 > size,
        marks * 12 > size, digits * 5 > size, _STOPS[data[last_word_end - 1]] if len(a) else cue,
        _UPPER[data[starts[w0]]] if len(a) else cue, copy, different * 2 < n,
        (most >= 4) & (most * 4 > n), cue, size > 14 * n], 1).astype(np.uint8)
    return out, {"x": x, "row": line_row, "words": n,
                 "first": np.searchsorted(line_row, np.arange(rows + 1))}


def fit(docs: list[np.ndarray], labels: list[int], rounds: int = 80, rate: float = 0.15,
        l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features; content against boilerplate) and 2 x 2 transitions, by likelihood.

    Every line of a document carries the document's quality label as its weak label. Documents
    are padded into one array; forward and backward sums run over all of them at once. Classes
    weigh the same in all. Without both labels nothing can be told apart: all lines are content.
    """
    count = len(FEATURES)
    if len(set(labels)) < 2:
        return np.r_[1.0, np.zeros(count - 1)], np.zeros((2, 2))
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    w, t = np.zeros(count), np.zeros((2, 2))
    batches = []
    for k in range(0, len(order), 250):
        ids = order[k:k + 250]
        length = max(len(docs[i]) for i in ids)
        x = np.zeros((len(ids), length, count))
        mask = np.zeros((len(ids), length), bool)
        for r, i in enumerate(ids):
            x[r, :len(docs[i])] = docs[i]
            mask[r, :len(docs[i])] = True
        y = np.array([labels[i] for i in ids])
        weight = np.where(y == 1, 0.5 / max(1, sum(labels)),
                          0.5 / max(1, len(labels) - sum(labels))) / np.maximum(mask.sum(1), 1)
        batches.append((x, mask, y, weight))
    m, v = np.zeros(count + 4), np.zeros(count + 4)
    for step in range(1, rounds + 1):
        grad = np.zeros(count + 4)
        for x, mask, y, weight in batches:
            d, length, _ = x.shape
            e = np.zeros((d, length, 2))
            e[:, :, 1] = x @ w
            alpha, beta = np.zeros((d, length, 2)), np.zeros((d, length, 2))
            alpha[:, 0] = e[:, 0]
            for i in range(1, length):
                moved = np.logaddexp(alpha[:, i - 1, 0, None] + t[0],
                                     alpha[:, i - 1, 1, None] + t[1]) + e[:, i]
                alpha[:, i] = np.where(mask[:, i, None], moved, alpha[:, i - 1])
            for i in range(length - 2, -1, -1):
                n0 = e[:, i + 1] + beta[:, i + 1]
                moved = np.logaddexp(t[:, 0] + n0[:, :1], t[:, 1] + n0[:, 1:])
                beta[:, i] = np.where(mask[:, i + 1, None], moved, beta[:, i + 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
            grad[:count] += np.einsum("dlf,dl->f", x, (y[:, None] - p) * mask * weight[:, None])
            pairs = mask[:, 1:] * weight[:, None]
            for i in range(2):
                for j in range(2):
                    expected = np.exp(alpha[:, :-1, i] + t[i, j] + e[:, 1:, j] + beta[:, 1:, j]
                                      - z[:, None])
                    seen = ((y == i) & (y == j))[:, None]
                    grad[count + 2 * i + j] += ((seen - expected) * pairs).sum()
        grad -= l2 * np.r_[w, t.ravel()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, t = w + move[:count], t + move[count:].reshape(2, 2)
    return w, t


def viterbi(scores: np.ndarray, t: np.ndarray) -> list[bool]:
    """Most likely labels (True: content) of one document's lines; ties go to content."""
    (t00, t01), (t10, t11) = t.tolist()
    boiler, content, back = 0.0, 0.0, []
    for i, s in enumerate(scores.tolist()):
        if i == 0:
            content = s
            continue
        stay0, come0 = boiler + t00, content + t10
        stay1, come1 = content + t11, boiler + t01
        back.append((come0 >= stay0, stay1 >= come1))
        boiler, content = max(stay0, come0), s + max(stay1, come1)
    state, out = content >= boiler, []
    for from0, from1 in reversed(back):
        out.append(state)
        state = from1 if state else from0
    out.append(state)
    return out[::-1] if len(scores) else []


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS):
    """Fit on at most ``sample`` labelled documents per class, chosen by a hash of the id.

    A document with several labels counts as good only if all of them are 1. Null labels are
    left out. This sample is the only bounded one; labelling covers every document.
    """
    marks = (labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min(F.col("quality").cast("int")).alias("y")))
    some = None
    for y in (0, 1):
        one = (marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
        some = one if some is None else some.unionByName(one)

    def run(batches):
        for b in slices(batches):
            _, lines = measure(*joined(b.column("text")))
            f = lines["first"]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("y"),
                pa.array([lines["x"][f[i]:f[i + 1]].tobytes() for i in range(b.num_rows)],
                         pa.binary())], ["doc_id", "y", "x"])

    rows = (bare(docs).join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")
            .mapInArrow(run, "doc_id long, y int, x binary").collect())
    rows = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in rows if r["x"])
    return fit([np.frombuffer(x, np.uint8).reshape(-1, len(FEATURES)) for *_, x in rows],
               [y for _, y, _ in rows])


def label_lines(docs: DataFrame, model) -> DataFrame:
    """Counts, the words in content lines and the content share of every document.

    Each row is read by itself in one pass without a shuffle. Text without words (also null) has
    no lines and a share of 0; lines without words carry no label.
    """
    w, t = model

    def run(batches):
        for b in slices(batches):
            counts, lines = measure(*joined(b.column("text")))
            scores, f = lines["x"] @ w, lines["first"]
            good = [viterbi(scores[f[i]:f[i + 1]], t) for i in range(b.num_rows)]
            flat = np.array([g for gs in good for g in gs], bool)
            content = per_row(np.where(flat, lines["words"], 0), f)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[longs(counts[c]) for c in (
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                 longs(content), longs(np.diff(f)), longs(per_row(flat, f))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "content_words", "n_lines", "n_content_lines"])

    return bare(docs).mapInArrow(run, (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, content_words long, n_lines long, n_content_lines long"))


def op2_line_labels(spark, folder: str) -> DataFrame:
    """Keep a document that passes the base rules and has half its words in content lines."""
    docs = documents(spark, folder)
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = label_lines(docs, model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed")
        & (F.col("content_words") >= F.lit(KEEP_SHARE) * F.col("n_words")))
