"""Spelling variants: words one edit apart, by dynamic programming along a sorted word list."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import bare, documents, longs, saved, slices

LEAST_CHARS, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31
BLOCK_WORDS = 1 << 13        # words of the sorted list in a block, until MAX_BLOCKS are reached
MAX_BLOCKS = 1 << 12         # blocks a direction, so the directory of blocks stays small
_TOP = chr(0x10FFFF)
_RUN = re.compile(r"[a-zÀ-ÿ]+")


def damaged(run: str, prefix: int, every: int = EVERY) -> str:
    """The run without one code point where ``every`` divides its checksum, else as it is."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
               every: int = EVERY) -> DataFrame:
    """``word, n``: letter runs of all whole texts, lower-cased in A-Z, with their occurrences.

    Every run is looked at; one whose ``crc32(<doc_id>:<run>)`` is divisible by ``every`` loses a
    code point. Null text has no words; a null id counts as an empty one; repeated rows count each.
    Counts are combined in each slice of text before the shuffle, so a word that makes up a third of
    a corpus costs one row a slice, and a very long text one slice by itself.
    """
    def run(batches):
        for b in slices(batches):
            total = Counter()
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                words = Counter(_RUN.findall(text.as_py().lower().decode()))
                for word, n in words.items():
                    if len(word) >= least_chars:
                        total[damaged(word, prefix, every)] += n
            rows = [(w, n) for w, n in total.items() if len(w) >= least_chars]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.string()), longs([n for _, n in rows])],
                ["word", "n"])
    return bare(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least_count)


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Scan:
    """A sorted list and its adjacent common prefixes, scanned for words one edit from another."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lcp = [0, *(common_prefix(a, b) for a, b in zip(words, words[1:]))]

    def near(self, word: str, shared: int) -> list[int]:
        """Places of the words at edit distance 1 whose first ``shared`` characters are ``word``'s.

        Row r of the edit matrix (r characters of the list's word) holds the three cells around the
        diagonal; others exceed one edit. Rows up to the common prefix with the word before are
        kept. Where all cells of a row exceed one edit, so do all words with that prefix: the scan
        goes on behind them.
        """
        words, lcp, m = self.words, self.lcp, len(word)
        w = "\0" + word + "\0\0\0"
        start = word[:shared]
        i = bisect_left(words, start)
        end = bisect_left(words, start + _TOP, i)
        rows = [None] * shared + [(1, 0, 1)] + [None] * (m + 2 - shared)
        depth, out = shared, []
        while i < end:
            v = words[i]
            stop = min(len(v), m + 1)
            a, b, c = rows[depth]
            while depth < stop:
                x = v[depth]
                na = a + (w[depth] != x)
                if b < na:
                    na = b + 1
                nb = b + (w[depth + 1] != x)
                if c < nb:
                    nb = c + 1
                if na < nb:
                    nb = na + 1
                nc = c + (w[depth + 2] != x)
                if nb < nc:
                    nc = nb + 1
                a, b, c = na, nb, nc
                depth += 1
                rows[depth] = (a, b, c)
                if a > 1 and b > 1 and c > 1:
                    break
            else:
                if len(v) == depth:
                    if -2 < m - depth < 2 and (a, b, c)[m - depth + 1] == 1:
                        out.append(i)
                    i += 1
                    if i < end:
                        depth = min(depth, lcp[i])
                    continue
            # All words with these first characters are too far, or too long: go behind them.
            i += 1
            if i < end and lcp[i] >= depth:
                i = bisect_left(words, v[:depth] + _TOP, i, end)
            if i < end:
                depth = min(depth, lcp[i])
        return out

    def reaches(self, word: str, shared: int, lo: str, hi: str) -> bool:
        """Whether the range from lo to hi may hold such a word: one edit suffices for its prefix."""
        prefix = lo[:common_prefix(lo, hi)][:len(word) + 1]
        if len(prefix) <= shared:
            return True
        row = [1, 0, 1]
        for r in range(shared, len(prefix)):
            x = prefix[r]
            cells = [word[j - 1] != x if 0 < j <= len(word) else 1 for j in (r, r + 1, r + 2)]
            a = min(row[1] + 1, row[0] + cells[0])
            b = min(row[2] + 1, a + 1, row[1] + cells[1])
            row = [a, b, min(b + 1, row[2] + cells[2])]
            if min(row) > 1:
                return False
        return True


def _directory(lists: DataFrame) -> list[tuple[str, str, int]]:
    """(first key, last key, block) in key order: at most ``MAX_BLOCKS`` rows."""
    rows = lists.groupBy("block").agg(F.min("key"), F.max("key")).collect()
    return sorted((lo, hi, block) for block, lo, hi in rows)


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, n, n_near, best_n, best``: near words of each word, and of them the most frequent.

    ``words`` has distinct ``word`` and their ``n``. Two words are near at exactly one inserted,
    deleted or replaced code point. An edit in a word's second half leaves its first half as it is,
    any other leaves the second: so a word is looked up among the words with its first half in the
    sorted list, and among those with its second half in the sorted list of reversed words, where
    only those without its first half count. Each near word is thus found once.

    Both lists are range-partitioned into blocks; a word goes to the blocks that its half's range
    meets and whose own common prefix one edit can reach, so a first half that a third of all words
    share doesn't bring them all together. A block with many visitors is dealt to several tasks. A
    task holds a block and its visitors, and hands on one row a visitor: number and best. Ties of
    ``best_n`` go to the smallest word by code points; ``best`` is null where nothing is near.
    """
    spark = words.sparkSession
    total = words.count()
    size = max(block_words, -(-total // MAX_BLOCKS))
    blocks = max(1, -(-total // size))

    def listed(key, first):
        ranged = words.select(key.alias("key"), "n").repartitionByRange(blocks, "key")
        return saved(ranged.withColumn("block", F.spark_partition_id() * 2 + first), "word_list")
    forward, backward = listed(F.col("word"), 0), listed(F.reverse("word"), 1)
    ranges = [_directory(forward), _directory(backward)]

    def route(batches):
        firsts = [[hi for _, hi, _ in r] for r in ranges]
        scan = Scan([])
        for b in batches:
            out = []
            for word, n in zip(*(c.to_pylist() for c in b.columns)):
                half = len(word) // 2
                for side, key, shared in ((0, word, half), (1, word[::-1], len(word) - half)):
                    start = key[:shared]
                    for lo, hi, block in ranges[side][bisect_left(firsts[side], start):]:
                        if lo > start + _TOP:
                            break
                        if scan.reaches(key, shared, lo, hi):
                            out.append((block, key, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()),
                 longs([r[2] for r in out])], ["block", "key", "n"])
    visitors = saved(words.select("word", "n").mapInArrow(route, "block int, key string, n long"),
                     "visitors")
    # Blocks with many visitors get several shares: a table of at most two rows a block of the list.
    shares = F.broadcast(spark.createDataFrame(
        [(r["block"], -(-r["count"] // (4 * size))) for r in visitors.groupBy("block").count().collect()],
        "block int, shares int"))
    lists = forward.unionByName(backward).join(shares, "block").withColumn(
        "share", F.explode(F.sequence(F.lit(1), "shares"))).drop("shares")
    visitors = visitors.join(shares, "block").withColumn(
        "share", F.pmod(F.hash("key"), F.col("shares")) + 1).drop("shares")

    def look(_, table, asked):
        rows = sorted(zip(table["key"].to_pylist(), table["n"].to_pylist()))
        scan, counts = Scan([r[0] for r in rows]), [r[1] for r in rows]
        turned = table["block"][0].as_py() % 2 if rows else 0
        found = []
        for key, n in sorted(zip(asked["key"].to_pylist(), asked["n"].to_pylist())):
            word = key[::-1] if turned else key
            half = len(word) // 2
            hits = [(-counts[i], scan.words[i][::-1] if turned else scan.words[i])
                    for i in scan.near(key, len(word) - half if turned else half)]
            if turned:
                hits = [h for h in hits if not h[1].startswith(word[:half])]
            if hits:
                best = min(hits)
                found.append((word, n, len(hits), -best[0], best[1]))
        cols = list(zip(*found)) or [()] * 5
        return pa.table([pa.array(cols[0], pa.string()), longs(cols[1]), longs(cols[2]),
                         longs(cols[3]), pa.array(cols[4], pa.string())],
                        ["word", "n", "n_near", "best_n", "best"])
    found = lists.groupBy("block", "share").cogroup(visitors.groupBy("block", "share")).applyInArrow(
        look, "word string, n long, n_near long, best_n long, best string")
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"),
                         F.lit(None).cast("struct<less:long,best:string>").alias("b"))
    return every.unionByName(found.select(
        "word", "n", "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("b"))
    ).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"),
                          F.min("b").alias("b")).select(
        "word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def group_variants(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``word, n``.

    ``form`` is the near word of largest n (ties: smallest by code points) if that is at least
    ``ratio`` times the word's, else null; ``root`` follows forms to the last, the word itself where
    there is none. Each step raises n ``ratio`` times, so chains are short and have no cycles; they
    are followed by doubling on the words that have a form, each round a written table. An empty
    table gives no rows.
    """
    words = saved(words.select("word", "n"), "vocabulary")
    is_form = F.col("best_n") >= ratio * F.col("n")
    table = saved(near_words(words, block_words).select(
        "word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "near_words")
    chain = saved(table.where("form is not null").select("word", F.col("form").alias("root")), "chain")
    while True:
        step = chain.select(F.col("word").alias("root"), F.col("root").alias("up"))
        chain = saved(chain.join(step, "root", "left").select(
            "word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")),
            "chain")
        if not chain.where("moved").limit(1).count():
            break
        chain = chain.drop("moved")
    return table.join(chain.select("word", "root"), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))


# crc32 as a fold over the bytes of "<doc_id>:<run>", its table by the rule; code points above
# U+00BF of this alphabet are the two bytes 195 and code point - 64.
OP12_SQL = r"""
with recursive crc as materialized (
  select list(list_reduce(range(8), lambda c, i: case when c & 1 = 1
             then xor(c >> 1, 3988292384::bigint) else c >> 1 end, k::bigint) order by k) as t
  from range(256) r(k)),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents),
per as (select doc_id, run, count(*) as n from runs where length(run) >= 7 group by all),
h as (select run, n, xor(list_reduce(flatten(list_transform(
             string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
             lambda c: case when ord(c) < 128 then [ord(c)::bigint]
                            else [195::bigint, (ord(c) - 64)::bigint] end)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint),
             4294967295::bigint) as h from per, crc),
w as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint)
                  || substr(run, (h % length(run))::bigint + 2) else run end as word, n from h),
v as materialized (select word, sum(n)::bigint as n from w where length(word) >= 7
                   group by word having sum(n) >= 2),
cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
                     from (select *, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (select distinct a.word, b.word as other, b.n as other_n
          from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
          union
          select a.word, b.word, b.n from cut a join v b on a.rest = b.word
          union
          select b.word, a.word, a.n from cut a join v b on a.rest = b.word),
near as (select word, count(*)::bigint as n_near, max(other_n) as best_n,
                arg_min(other, (-other_n, other)) as best from pairs group by word),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near,
             case when best_n >= 10 * v.n then best end as form,
             case when best_n >= 10 * v.n then best_n end as form_n
      from v left join near using (word)),
chain as (select word, word as root from f
          union all
          select c.word, f.form from chain c join f on f.word = c.root where f.form is not null),
last as (select c.word, c.root from chain c join f on f.word = c.root where f.form is null)
select f.word, f.n, f.n_near, f.form, f.form_n, last.root from f join last using (word)
"""


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of all documents with near words, forms and roots."""
    return group_variants(vocabulary(documents(spark, folder)))
