"""Vector codes against plain integer k-means, and the bounds against all distances."""

import hashlib
import math

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, e string"


def plain(x, parts, entries, rounds):
    """Codes, errors and codebooks with every distance computed; x in the order of the first rows."""
    n, w = len(x), x.shape[1] // parts
    x = x.reshape(n, parts, w)
    book = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        if r < rounds:
            for p in range(parts):
                for k in range(book.shape[1]):
                    mine = x[code[:, p] == k, p]
                    if len(mine):
                        book[p, k] = mine.sum(axis=0) // len(mine)
    return code, np.take_along_axis(d, code[..., None], 2).sum(axis=(1, 2)), book


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, .2, (6, 64))
    x = centres[rng.integers(0, 6, 400)] + rng.normal(0, .05, (400, 64))
    x[50:90] = x[50]                                        # a large group of copies
    x[3] = x[2]                                             # equal entries at the start: ties
    out = [(i, [float(c) for c in v], [None, 1, 2][i % 3], "x", 1, "x")
           for i, v in enumerate(x.astype(np.float32))]
    out += [(7, out[7][1], 1, "x", 1, "x"), (None, out[8][1], 2, None, None, None)]
    bad = [None, [], [1.0], [*out[0][1][:-1], None], [*out[0][1][:-1], math.nan],
           [-math.inf, *out[0][1][1:]]]
    return out + [(-1 - i, v, 1, "x", 1, "x") for i, v in enumerate(bad)]


@pytest.mark.parametrize("shape", [(8, 16, 6), (4, 3, 3), (2, 500, 2)])
def test_codes(spark, rows, shape):
    from tessera.llm.codes import compress
    parts, entries, rounds = shape
    good = [r for r in rows if r[1] and len(r[1]) == 64
            and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.floor(np.array([r[1] for r in good]) * 4096).astype(np.int64)
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0))
    if entries > 256:
        with pytest.raises(ValueError):
            compress(spark.createDataFrame(rows, SCHEMA), parts, entries, rounds)
        return
    code, error, book = plain(x[order], parts, entries, rounds)
    got_book, got = compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts, entries, rounds)
    assert (got_book == book).all()
    want = sorted((str(good[i][0]), str(good[i][2]), bytes(c.astype(np.uint8)), int(e))
                  for i, c, e in zip(order, code, error))
    assert sorted((str(r.vec_id), str(r.label), bytes(r.code), r.error) for r in got.collect()) == want


def test_bounds_hold_and_save_work():
    """Bounds of any earlier round hold in every later one; most distances are never computed."""
    from tessera.llm.codes import Bounds
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 800, (12, 8))[rng.integers(0, 12, 3000)] + rng.normal(0, 60, (3000, 8))
         ).astype(np.int64)
    history = [x[None, :16].copy()]
    n, g = len(x), 4
    code, upper_at = np.zeros((2, n), np.int64)
    upper, lower, lower_at = np.full(n, np.inf), np.zeros((n, g)), np.zeros((n, g), np.int64)
    done = []
    for _ in range(9):
        b = Bounds(history)
        done.append(b.assign(x, 0, code, upper, upper_at, lower, lower_at))
        d = np.sqrt(((x[:, None] - b.book[0][None]) ** 2).sum(axis=2))
        assert (code == (d * d).round().astype(np.int64).argmin(axis=1)).all()
        mine = d[np.arange(n), code]
        assert (upper + b.moved[upper_at, 0, code] >= mine).all()
        d[np.arange(n), code] = np.inf
        for k in range(g):
            assert (lower[:, k] - b.most[lower_at[:, k], 0, k] <= d[:, b.group == k].min(axis=1)).all()
        book = b.book.copy()
        for k in range(16):
            if (code == k).any():
                book[0, k] = x[code == k].sum(axis=0) // (code == k).sum()
        history.append(book)
    assert done[0] >= 16 * n and done[-1] < 3 * n
    # The net way is shorter than the way in steps.
    steps = sum(np.sqrt(((history[t + 1] - history[t]) ** 2).sum(axis=2)) for t in range(8))
    assert (b.moved[0] <= steps * (1 + 1e-6)).all() and (b.moved[0] < steps * .99).any()


def test_few_rows_and_none(spark, rows):
    from tessera.llm.codes import book_digest, compress
    book, got = compress(spark.createDataFrame([], SCHEMA))
    assert book.shape[1] == 0 and got.count() == 0
    assert book_digest(book) == hashlib.sha256(b"").hexdigest()
    book, got = compress(spark.createDataFrame(rows[:5], SCHEMA))
    assert book.shape == (8, 5, 8)
    assert sorted(bytes(r.code) for r in got.collect()) == sorted(
        bytes([i] * 8) for i in (0, 1, 2, 2, 4))
    huge = [(1, [1e6] * 64, 1, "x", 1, "x")]
    with pytest.raises(Exception):
        compress(spark.createDataFrame(huge, SCHEMA))
