"""The corpus operators against brute force on small tables with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, hs string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}x{'é' if rng.random() < .1 else ''}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    out = []
    for i in range(40):
        text = words(rng, rng.choice([0, 3, 4, 5, 6, 12, 60, 200]))
        if i % 5 == 0:
            text[len(text) // 2:len(text) // 2] = [passage]
        out.append((i, " ".join(text), "en", ["b", "a", None][i % 3], 0, 1, "x"))
    base = words(rng, 150)
    for i in range(40, 52):
        copy = list(base)
        copy[rng.randrange(150)] = f"new{i}"
        out.append((i, " ".join(copy), "en", "a", 0, 1, "x"))
    out.append((60, out[41][1], None, "b", None, None, None))           # exact copies
    out.append((61, out[41][1], None, "b", None, None, None))
    out.append((3, out[3][1], "en", "a", 0, 1, "x"))                    # repeated row
    out.append((62, None, None, None, None, None, None))
    out.append((63, "", "en", "a", 0, 1, "x"))
    out.append((64, " \n\t ", "en", "a", 0, 1, "x"))
    out.append((None, "no id here " + passage, "en", "a", 0, 1, "x"))
    out.append((65, "Same line.\n" * 60 + "aaaa " * 300, "en", "a", 0, 1, "x"))
    out.append((66, " ".join(words(rng, 6000, 10**6)), "en", "b", 0, 1, "x"))   # very long
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique(rows):
    """(order, id, text) of the distinct documents, null ids last."""
    return sorted({(2**63 - 1 if r[0] is None else r[0], r[1] or "") for r in rows})


def test_substrings(docs, rows, empty):
    from tessera.llm.substrings import remove
    n = 35
    counts, texts = collections.Counter(), {}
    for key in unique(rows):
        w = texts[key] = W.findall(key[1])
        counts.update(tuple(w[j:j + n]) for j in range(len(w) - n + 1))
    got = remove(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[2**63 - 1 if r["doc_id"] is None else r["doc_id"]].append(r)
    for key, w in texts.items():
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if counts[tuple(w[j:j + n])] > 1:
                gone[j:j + n] = [True] * n
        for r in by[key[0]]:
            assert r["n_words"] == len(w) and r["n_removed"] == sum(gone)
            assert bytes(r["kept"]).decode() == " ".join(x for x, g in zip(w, gone) if not g)
    assert remove(empty).count() == 0


def test_suffix_array_order():
    from tessera.llm.suffix import suffix_array
    rng = random.Random(3)
    for _ in range(800):
        top = rng.choice([1, 2, 3, 9])
        t = [rng.randint(1, top) for _ in range(rng.randint(0, 24))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_dedup(docs, rows, empty):
    from tessera.llm.suffix import remove
    n, seen, want = 100, set(), {}
    for key in unique(rows):
        b = key[1].encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            s = b[j:j + n]
            if s in seen:
                gone[j:j + n] = True
            seen.add(s)
        want[key[0]] = (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                        if len(b) else 0, np.frombuffer(b, np.uint8)[~gone].tobytes())
    got = remove(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = 2**63 - 1 if r["doc_id"] is None else r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[key]
    assert remove(empty).count() == 0


def test_heavy_light(docs, rows, empty):
    from tessera.llm.heavylight import bitmap, join, may_link
    sets = {}
    for k, text in unique(rows):
        w = text.encode().lower().split()
        sets[k] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else (
            {tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = 2**63 - 1 if r["doc_id"] is None else r["doc_id"]
        component = 2**63 - 1 if r["component_id"] is None else r["component_id"]
        assert (r["n_shingles"], component) == (len(sets[key]), root(key))
    assert join(empty).count() == 0
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        x = np.unique(rng.choice(pool, rng.integers(1, 60)))
        y = np.unique(rng.choice(pool, rng.integers(1, 60)))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            assert may_link(bitmap(x), len(x), bitmap(y), len(y))


def test_heavy_light_maps():
    """Many pairs at once are ruled out as one by one, on maps folded to a bounded width too."""
    from tessera.llm.heavylight import Maps, bitmap, may_link
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 700).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[:k], k)) for k in rng.integers(1, 700, 120)]
    n = np.array([len(s) for s in sets])
    x, y = (v.ravel() for v in np.meshgrid(np.arange(120), np.arange(120)))
    near = 100 * np.minimum(n[x], n[y]) >= 75 * np.maximum(n[x], n[y])
    x, y = x[near], y[near]
    for share, most in ((2, None), (2, 256), (8, 1024)):
        maps = [bitmap(s, share, most) for s in sets]
        want = [may_link(maps[i], int(n[i]), maps[j], int(n[j])) for i, j in zip(x, y)]
        assert Maps(maps, n).may_link(x, y).tolist() == want
        assert most or not all(want)
        for i, j, may in zip(x, y, want):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert may or 100 * both < 75 * (n[i] + n[j] - both)


def test_heavy_light_links(spark, docs, rows, empty, monkeypatch):
    """Every link between different sets counts, in a list of many similar texts too."""
    from tessera.llm import heavylight
    rng = random.Random(21)
    base = words(rng, 200)
    more = []
    for i in range(30):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(200)] = f"other{rng.randrange(10**6)}"
        more.append((500 + i, " ".join(copy), "en", "a", 0, 1, "x"))
    table = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    ids = {}
    for k, text in unique([*rows, *more]):
        w = text.encode().lower().split()
        s = frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset(
            [tuple(w)] if w else [])
        ids.setdefault(s, []).append(k)
    links = {frozenset((a, b)) for a in ids for b in ids if a != b
             and a & b and 100 * len(a & b) >= 75 * len(a | b)}
    degree = collections.Counter(s for pair in links for s in pair)
    want = {k: degree[s] for s, ks in ids.items() for k in ks}
    pairs = {frozenset(min(ids[s]) for s in pair) for pair in links}
    assert max(want.values()) > 11 and len(pairs) > 150
    for chunk in (2048, 7):
        monkeypatch.setattr(heavylight, "CHUNK_SETS", chunk)
        got = heavylight.join(table).collect()
        assert len(got) == len(rows) + len(more)
        assert {2**63 - 1 if r["doc_id"] is None else r["doc_id"]: r["n_links"] for r in got} == want
    found = [tuple(2**63 - 1 if r[c] is None else r[c] for c in "ab")
             for r in heavylight.links_of(table).collect()]
    assert len(found) == len(pairs) and {frozenset(p) for p in found} == pairs
    assert heavylight.links_of(empty).count() == 0


def test_heavy_light_lists_of_equal_members(spark):
    """Of lists with the same members one travels; subset entries and copies of a row count apart."""
    from tessera.llm.heavylight import open_lists
    rows = [(h, k, c) for h in (2, 4, 8, 3, 5) for k, c in ((10, 10), (20, 10), (30, 30))]
    rows += [(6, 10, 10), (6, 20, 10)]                               # one component
    rows += [(12, 10, 10), (12, 10, 10), (12, 20, 10), (12, 30, 30)]  # four rows, two alike
    rows += [(14, 10, 10), (14, 30, 30), (16, 40, 40), (16, 30, 30)]
    known = spark.createDataFrame(rows, "h long, key long, component long")
    got = sorted((r["h"], r["number"]) for r in open_lists(known).collect())
    assert got == [(2, 3), (3, 3), (12, 4), (14, 2), (16, 2)]


def test_brown(docs, rows, empty):
    from pyspark.sql import functions as F
    from tessera.llm.brown import exchange, score
    from tessera.llm.common import bare, remainder
    held = remainder(F.col("doc_id"), 7) == 2
    got = score(bare(docs.withColumn("held_out", held), "held_out")).collect()
    assert len(got) == len(rows)
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2:
            counts.update([*(r[1] or "").encode().lower().split(), b" end"])
    total, kinds = sum(counts.values()), len(counts)
    texts = {r[0]: [*(r[1] or "").encode().lower().split(), b" end"] for r in rows}
    for r in got:
        t = texts[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(w in counts for w in t)
        assert r["train_tokens"] == total and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    nothing = score(bare(empty.withColumn("held_out", held), "held_out"))
    assert nothing.count() == 0
    rng = np.random.default_rng(2)
    m = rng.integers(0, 30, (9, 9))
    m[:, -1] = m[-1] = 1
    blocks = np.kron(np.array([[1, 20], [20, 1]]), np.ones((4, 4), int))
    m[:8, :8] = blocks
    where = exchange(m, classes=2)
    assert len(set(where[:4])) == 1 and len(set(where[4:8])) == 1 and where[0] != where[4]


def test_line_labels(docs, rows, empty, spark):
    from tessera.llm.lines import fit, label_lines, train, viterbi
    got = {r["doc_id"]: r for r in label_lines(docs, fit([], [])).collect()}
    for i, text, *_ in rows:
        text = text or ""
        w = W.findall(text)
        where = collections.defaultdict(list)
        for j in range(len(w) - 2):
            where[tuple(w[j:j + 3])].append(j)
        cover = {j + k for v in where.values() if len(v) > 1 for j in v for k in range(3)}
        seen, copies = set(), 0
        for line in text.split("\n"):
            if W.search(line):
                copies += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(
                    r"[#*$%&|<>]", text)), copies, len(cover))
        assert r["content_words"] == len(w)
    labels = spark.createDataFrame([(65, 0), (1, 1), (7, 1), (None, 1), (66, None)],
                                   "doc_id long, quality int")
    model = train(docs, labels)
    assert label_lines(empty, model).count() == 0
    rng = np.random.default_rng(4)
    for _ in range(100):
        s, t = rng.normal(size=6), rng.normal(size=(2, 2))
        best = max(np.ndindex(*[2] * 6), key=lambda y: sum(s[i] * y[i] for i in range(6))
                   + sum(t[y[i], y[i + 1]] for i in range(5)))
        assert viterbi(s, t) == [bool(v) for v in best]


def test_rans(docs, rows, empty, spark):
    from tokenizers import Tokenizer
    from tessera.llm import rans
    path = rans.default_tokenizer()
    library = Tokenizer.from_file(path)
    pieces, rng = rans.Pieces(path), random.Random(2)
    bits = [",", ". ", "a", "B", "1", " ", " ", ".", "'s", "\n", "\t", "é", " ", "​",
            "\x1f", "中", "👍", "'", "-", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for text, ids in zip(texts, pieces(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(
            text, add_special_tokens=False).ids, text
    _, back = rans.encode_documents(docs, path)
    start = 0
    got = back.orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(
        r[0] for r in rows if r[0] is not None)
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in got:
        want = library.encode(by_id[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"]) == (start, len(want))
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        start += len(want)
    assert rans.encode_documents(empty, path)[1].count() == 0
    # Blocks decode alone, and damage is found.
    tokens = np.random.default_rng(1).zipf(1.3, 200_000).clip(max=5000).astype(np.int64)
    table = rans.Table(rans.frequencies(np.bincount(tokens)))
    data = rans.encode_chunk([tokens[:150_000], tokens[150_000:]], table)
    assert (np.concatenate(rans.decode_chunk(data, table)) == tokens).all()
    assert (rans.decode_chunk(data, table, only=2) == tokens[2 << 16:3 << 16]).all()
    with pytest.raises(ValueError):
        rans.decode_chunk(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], table)


def test_toxicity(spark, empty):
    from tessera.llm.toxicity import score, train
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = words(rng, 40)
        if bad:
            for k in range(6):
                text[rng.randrange(40)] = rng.choice(["grumblefoo", "zonkster", "blargle"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(1000, "w1x w2x grumbblefoo zonksterr grumblefo w4x blarglee zonkstr w9x"), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = train(docs, marks)
    got = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= .5) == y for i, y in held]) > 0.95
    assert got[1000] > 0.5 > got[1001]
    assert all(0 <= s <= 1 for s in got.values())
    assert score(empty, model).count() == 0
    assert train(docs, marks.where("toxic = 1")) is not None


def test_toxicity_passes_texts_on_once(spark, monkeypatch):
    """The text that is scored is the one passed on, whatever the slices; null stays null."""
    from tessera.llm import toxicity
    rng = np.random.default_rng(3)
    model = rng.standard_normal(toxicity.BUCKETS).astype(np.float32), 0.25
    rows = [(1, "Some words here", "en"), (2, None, None), (3, "", "de"), (None, "\u00e4\u00f6 x" * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    bare = [tuple(r) for r in toxicity.score(docs, model).collect()]
    for size in (toxicity.SLICE, 16):
        monkeypatch.setattr(toxicity, "SLICE", size)
        got = toxicity.score(docs, model, "text", "lang")
        assert got.columns == ["doc_id", "text", "lang", "score"]
        assert [(r.doc_id, r.text, r.lang) for r in got.collect()] == rows
        assert [(r.doc_id, r.score) for r in got.collect()] == bare


def test_leaks(spark, docs, empty):
    from tessera.llm.leaks import Items, distance, edits, leaks, plain
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, rng.randint(15, 60), 10**6))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "tiny"), (93, items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    planted = spark.createDataFrame([
        (1000, "before " + items[3][1].replace("w", "W") + " after"), (1001, items[0][1]), (1002, "a tiny b"),
        (None, "x " + items[5][1].replace("x w", "x  w", 1))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in leaks(
        docs.select("doc_id", "text").unionByName(planted), table).collect()}
    assert got == {(1000, 3, 0), (1001, 0, 0), (1001, 93, 0), (1002, 92, 0), (None, 5, 0)}
    assert leaks(empty, table).count() == 0
    assert leaks(docs, table.where("item_id < 0")).count() == 0
    index, found, tries = Items([(i, plain(t.encode())) for i, t in items[:30]]), 0, 200
    for _ in range(tries):
        i, text = rng.choice(items[:30])
        copy = bytearray(text.encode())
        for _ in range(rng.randint(1, 4)):
            p = rng.randrange(1, len(copy) - 1)
            copy[p:p + rng.randint(0, 1)] = bytes([rng.randrange(97, 123)])
        text = b"some words " + plain(bytes(copy)) + b" more words"
        found += any(h[1] == i for h in index.find(text + b"\0", np.array([0, len(text) + 1])))
    assert found >= 0.9 * tries

    def slow(a, b):
        row = list(range(len(a) + 1))
        best = row[-1]
        for c in b:
            new = [row[0] + 1]
            for k, x in enumerate(a, 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != c)))
            row = new
            best = min(best, row[-1])
        return best
    for _ in range(300):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        want = slow(a, b[:len(a) + 3])
        assert distance(a, b, 3) == (want if want <= 3 else None)
    assert edits(100) == 8


def test_toxicity_sample_and_counts(spark, monkeypatch):
    from tessera.llm import toxicity
    assert toxicity.SAMPLE_DOCS >= 3000
    monkeypatch.setattr(toxicity, "fit", lambda bags, labels: bags)
    docs = spark.createDataFrame([(0, "abc " * 70000)], "doc_id long, text string")
    marks = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    (_, n), = toxicity.train(docs, marks)
    assert n.max() == 70000


def edited(rng, item, e):
    """The item after ``e`` edits at places of its own."""
    out = bytearray(item)
    for _ in range(e):
        p, kind = rng.randrange(len(out)), rng.randrange(3)
        out[p:p + (kind > 0)] = bytes([rng.randrange(97, 123)]) if kind < 2 else b""
    return bytes(out)


@pytest.mark.parametrize("size", [13, 25, 26, 60, 100, 240, 390, 1000, 3000])
def test_leaks_full_radius(size):
    """Every match within 8 % is found, whatever the item's length."""
    from tessera.llm.leaks import Items, distances, edits
    rng = random.Random(size)
    items = [(i, "".join(rng.choice("abcdefgh ijklm") for _ in range(size)).replace("  ", "xy")
              .strip().ljust(size, "q").encode()) for i in range(8)]
    index = Items(items)
    for _ in range(24):
        i, item = rng.choice(items)
        text = b"some words " + edited(rng, item, edits(size)) + b" more words"
        near = min(distances(item, text))
        assert near <= edits(size)
        got = {h[1]: h for h in index.find(text + b"\0", np.array([0, len(text) + 1]))}
        assert got[i][2] == near


def test_leaks_against_brute_force():
    """All rows and items, matches that just miss the radius included."""
    from tessera.llm.leaks import Items, distances, edits
    rng = random.Random(6)
    items = [(i, bytes(rng.choice(b"abc ") for _ in range(rng.randint(9, 60)))) for i in range(12)]
    texts = []
    for _ in range(150):
        i, item = rng.choice(items)
        texts.append(bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 30))) + edited(
            rng, item, rng.randint(0, edits(len(item)) + 2)) + rng.choice([b"", b" ab", item]))
    rows = np.cumsum([0] + [len(t) + 1 for t in texts])
    want = {}
    for r, t in enumerate(texts):
        for i, item in items:
            best = min(distances(item, t), default=len(item))
            if best <= edits(len(item)):
                want[r, i] = best
    got = Items(items).find(b"\0".join(texts) + b"\0", rows)
    assert {(r, i): d for r, i, d, _ in got} == want and len(want) > 100


def test_leaks_start_at_any_byte(spark):
    from tessera.llm.leaks import leaks
    rng = random.Random(12)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60))
    item = "Which of the rivers named above runs north, and how long is it in all?"
    items = spark.createDataFrame([(1, han[20:50]), (2, item), (3, "tiny"), (4, "東京")],
                                  "item_id long, text string")
    texts = [han, han[:30] + "x" + han[30:], "see\u00a0" + item + "\u00a0end", "(" + item[1:] + ")",
             "so tiny, yes", "destiny tinys", "「tiny」", "前に東京は"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in leaks(docs, items).collect()}
    assert got == {(0, 1, 0), (1, 1, 1), (2, 2, 0), (3, 2, 1), (4, 3, 0), (6, 3, 0), (7, 4, 0)}


def test_mixing(docs, rows, empty):
    from tessera.llm.mixing import mix, sized, targets
    got = mix(sized(docs)).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(sized(docs.repartition(5)))
                                                          .collect()), key=str)
    taken, size = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    for s, n, target in targets(list(size.items())):
        assert taken[s] == int(target) <= 3 * n
    assert mix(sized(empty)).count() == 0
    assert targets([("a", 100), ("b", 100), (None, 100)]) == [
        ("a", 100, 187.5), ("b", 100, 75.0), (None, 100, 37.5)]
    assert targets([("a", 10), ("b", 100)])[0][2] == 30.0


def test_pii(docs, rows, empty):
    from tessera.llm.pii import KINDS, automaton, find, luhn, spans
    auto, rng = automaton(), random.Random(1)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(x):
        out = [(m.start(), 0, m.end()) for m in email.finditer(x)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(x)
                if all(int(p) <= 255 for p in m.group().split("."))]
        for m in card.finditer(x):
            d = re.sub("[ -]", "", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(x)
                             if 9 <= len(re.sub(r"\D", "", m.group())) <= 15])
    parts = ["a", "@", ".", "1", "2", "25", "300", "-", "+", " ", "(", ")", "4111111111111111",
             "b.c", "é"]
    for _ in range(5000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert [s for s in find(x, auto) if s[1] < 4] == brute(x), x
    text = ("IBAN: DE89 3704 0044 0532 0130 00, account number 12345678, SSN 123-45-6789, "
            "see https://bob:pw@example.com/x at 12 Old Mill Road")
    kinds = {KINDS[k] for _, k, _ in find(text, auto)}
    assert {"iban", "account", "ssn", "url", "address", "email"} <= kinds
    assert spans(docs).count() == len(rows) and spans(empty).count() == 0


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline as p
    rng = random.Random(8)
    item = " ".join(words(rng, 30, 10**6))
    extra = [(200 + i, " ".join(words(rng, 80, 10**6)), "en", "a", 9, 1, "x") for i in range(5)]
    extra.append((300, "see " + item + " there", "en", "b", 9, 1, "x"))
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    folder = str(tmp_path)
    docs.drop("part", "hs").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert p.drop_toxic(spark, docs, folder).count() == docs.count()
    kept = [r["doc_id"] for r in p.one_of_near_copies(spark, docs, folder).collect()]
    assert 40 in kept and not set(range(41, 52)) & set(kept) and not {60, 61} & set(kept)
    assert {200, 201, 202, 203, 204, 300, 62, 63, 64} <= set(kept) and kept.count(3) == 2  # wordless
    clean = {r["doc_id"] for r in p.drop_leaks(spark, docs, folder).collect()}
    assert clean == {r["doc_id"] for r in docs.collect()} - {300}
    mixed = p.mix_sources(spark, docs, folder)
    assert mixed.columns == p.COLUMNS
    got = collections.Counter()
    for r in mixed.collect():
        got[r["source"]] += len(W.findall(r["text"]))
    from tessera.llm.mixing import targets
    size = collections.Counter()
    for r in docs.collect():
        size[r["source"]] += len(W.findall(r["text"] or ""))
    assert dict(got) == {s: int(t) for s, _, t in targets(list(size.items())) if int(t)}
    assert p.run(spark, folder).count() > 0


def test_bitmaps_of_many_pairs_are_compared_in_little_memory():
    import tracemalloc

    from tessera.llm import heavylight

    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2 ** 63, 512).astype(np.uint64) for _ in range(200)]
    maps = heavylight.Maps([heavylight.bitmap(s, 8, 1 << 12) for s in sets], np.full(200, 512))
    x, y = (rng.integers(0, 200, 1 << 18) for _ in range(2))
    tracemalloc.start()
    ok = maps.may_link(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ok == (x == y)).all()
    assert most < 48 << 20


def test_every_training_word_chooses_its_class():
    from tessera.llm.brown import chosen, contexts, fit_of
    rng = np.random.default_rng(5)
    end, classes = 30, 4
    wide, stride = classes + 1, 2 * (classes + 1) + 1
    line = np.r_[rng.zipf(1.6, 400) % end, end]
    line[rng.integers(0, 400, 60)] = end
    old = np.r_[rng.integers(0, classes, end), classes]

    def table(of):
        out = np.zeros((wide, wide))
        np.add.at(out, (of[np.r_[end, line[:-1]]], of[line]), 1)
        return out
    key, times = contexts(line, old, np.ones(len(line), bool), wide)
    weight = np.bincount(line, minlength=end + 1)[:end]
    assert (np.bincount(key // stride, times, end) <= 2 * weight).all()
    for w in range(end):
        mine = key // stride == w
        best = chosen(table(old), old[w:w + 1], weight[w:w + 1], key[mine] - w * stride, times[mine])
        fits = [fit_of(table(np.r_[old[:w], c, old[w + 1:]])) for c in range(classes)]
        assert fits[best[0]] == pytest.approx(max(fits)) and (weight[w] or best[0] == old[w])
    got = chosen(table(old), old[:-1], weight, key, times)
    assert fit_of(table(np.r_[got, classes])) > fit_of(table(old))


def test_rare_words_of_one_form_get_their_own_classes(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tessera.llm import brown
    monkeypatch.setattr(brown, "FREQUENT", 0.03)
    rng = np.random.default_rng(6)
    # Two word lists stand in other places, but their words have the same last letters and length.
    first, second = ([f"{c}{i:02d}xyz" for i in range(30)] for c in "ab")
    texts = [" ".join(f"the {first[rng.integers(30)]} of {second[rng.integers(30)]} ran"
                      for _ in range(20)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "the zzzxyz", "", None])],
                                 "doc_id long, text string").select(
        "doc_id", (F.col("doc_id") == 30).alias("held_out"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text")).repartition(3)
    found, kept = [], brown.saved
    monkeypatch.setattr(brown, "saved", lambda df, name: found.append(kept(df, name)) or found[-1])
    scores = {r["doc_id"]: r for r in brown.score(docs).collect()}
    assert len(scores) == 33 and all(r["score"] < 0 for r in scores.values())
    parsed, told = found
    # Rows dealt otherwise give the same scores; more parts give every word a class too.
    other = {r["doc_id"]: r for r in brown.score(docs.repartition(1)).collect()}
    assert all(other[d]["score"] == pytest.approx(r["score"]) for d, r in scores.items())
    monkeypatch.setattr(brown, "PER_PART", 100)
    assert all(r["score"] < 0 for r in brown.score(docs).collect())
    classes = {}
    for r in parsed.join(brown.sent_back(told, "counts", "old", "new"), "block").collect():
        words = np.frombuffer(bytes(r["words"]), "<u8")
        was, now = (np.frombuffer(b"".join(bytes(p[c]) for p in r["back"]), "u1") for c in ("old", "new"))
        assert len(words) == len(was) == len(now)
        for w, *c in zip(words.tolist(), was.tolist(), now.tolist()):
            assert classes.setdefault(w, c) == c

    def of(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        from tessera.llm.common import word_hashes, word_spans
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        return [classes[h] for h in word_hashes(data, starts, ends, lower=True).tolist()]
    one, two = of(first), of(second)
    assert len({was for was, _ in one + two}) == 1, "by their form they are in one class"
    assert {now for _, now in one}.isdisjoint(now for _, now in two)
    assert len(set(of(["zzzxyz"])[0])) == 1, "an unknown word stays with its form"
