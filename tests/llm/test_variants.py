"""Spelling variants against all pairs, and the scan against edit distances."""

import collections
import random
import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, word string, n string, block int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_scan():
    from tessera.llm.variants import Scan
    rng = random.Random(2)
    for _ in range(60):
        letters = "abcé"[:rng.randint(1, 4)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
                        for _ in range(rng.randint(1, 150))})
        scan = Scan(words)
        cut = rng.randrange(len(words))
        for word in words[:40]:
            for shared in (len(word) // 2, rng.randint(1, len(word))):
                want = [i for i, v in enumerate(words)
                        if v[:shared] == word[:shared] and distance(v, word) == 1]
                assert scan.near(word, shared) == want
                lo, hi = words[cut], words[min(cut + 5, len(words) - 1)]
                if any(lo <= words[i] <= hi for i in want):
                    assert scan.reaches(word, shared, lo, hi)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 11))) for _ in range(60)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    base += [b[:3] + "x" + b[4:] for b in base[:20]] + ["Q" + b[1:] for b in base[:20]]
    out = []
    for i in range(150):
        text = [rng.choice(base[:8] if rng.random() < .7 else base) for _ in range(rng.randint(0, 60))]
        text = [w.upper() if rng.random() < .1 else w for w in text]
        out.append((i, rng.choice([" ", ", ", "9", "×\n", " "]).join(text), "w", "n", 1))
    out += [out[5], out[5], (None, out[7][1], None, None, None), (151, None, "w", "n", 1),
            (152, "", "w", "n", 1), (153, "÷×Àÿabc " * 900 + "z" * 30_000, "w", "n", 1),
            (154, "z" * 30_000 + " K" + "z" * 9, "w", "n", 1)]
    return out


def expected(rows):
    count = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in count if abs(len(v) - len(w)) < 2 and v != w and (
        len(w) > 1000 or distance(v, w) == 1)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= 10 * count[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, n, len(near[w]), form.get(w), count.get(form.get(w)), root(w))
            for w, n in count.items()}


@pytest.mark.parametrize("block", [1 << 13, 7])
def test_variants(spark, rows, block):
    from tessera.llm.variants import group_variants, vocabulary
    words = vocabulary(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = group_variants(words, block_words=block).select(
        "word", "n", "n_near", "form", "form_n", "root").collect()
    want = expected(rows)
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want
    assert sum(r.form is not None for r in got) > 20
    assert max(r.n_near for r in got) > 2


def test_chains_and_empty(spark):
    from tessera.llm.variants import group_variants, vocabulary
    words = [("abcdefgh"[:7] + "h" * 0, 10**4), ("abcdefx", 10**3), ("abcdeyx", 10**2),
             ("abcdeyxz", 10), ("abcdeyxzz", 1), ("zzzzzzz", 5)]
    got = group_variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {r.word: r.root for r in got} == {
        **{w: "abcdefg" for w, _ in words[:5]}, "zzzzzzz": "zzzzzzz"}
    empty = vocabulary(spark.createDataFrame([], SCHEMA))
    assert group_variants(empty).count() == 0
