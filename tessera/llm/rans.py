"""Token ids in a binary format: static range asymmetric numeral system, interleaved blocks.

A file row ("chunk") holds whole documents in ascending order. Its payload is

    magic "TRA1", bits, lanes, tokens, documents, blocks       six unsigned 32-bit numbers
    document lengths                                           unsigned 32-bit each
    checkpoints: tokens, words, crc32 of each block            three unsigned 32-bit each
    blocks: lane states (64-bit), then renormalisation words (32-bit)

all little-endian. Blocks are independent: token i of a block belongs to lane i mod lanes, a
reader seeks to any block by the checkpoints, checks its checksum and decodes it alone. All share
one frequency table, which is stored beside the chunks.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm.common import documents, joined, longs, saved, slices
from tessera.session import new_path

MAGIC = b"TRA1"
BITS = 18
LANES = 512
BLOCK = 1 << 16
CHUNK = 1 << 18
END = 0
BROADCAST_ROWS = 200_000     # file parts; beyond this their offsets come by a shuffle join
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


# ---------------------------------------------------------------- frequency table

def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2^bits, at least 1 where a symbol occurs, exact remainders first."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    used = counts > 0
    spare = size - int(used.sum())
    if spare < 0:
        raise ValueError("more symbols in use than slots in the table")
    exact = counts.astype(np.float64) * spare / total
    freq = np.floor(exact).astype(np.int64) + used
    order = np.lexsort((np.arange(len(counts)), -(exact - np.floor(exact)) * used))
    freq[order[:size - int(freq.sum())]] += 1
    return freq


class Table:
    """Lookups for both directions; rebuilt in each task from the frequencies alone."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        start = np.cumsum(freq) - freq
        self.start = start.astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.slot_freq = self.freq[self.symbol]
        self.slot_rest = np.arange(len(self.symbol), dtype=np.uint64) - self.start[self.symbol]


def encode_block(tokens: np.ndarray, t: Table, lanes: int = LANES) -> bytes:
    state = np.full(lanes, _LOW, np.uint64)
    words = []
    for at in range((len(tokens) - 1) // lanes * lanes, -1, -lanes):
        s = tokens[at:at + lanes]
        x, f = state[:len(s)], t.freq[s]
        full = x >= t.limit[s]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[:len(s)] = (q << t.bits) + (x - q * f) + t.start[s]
    return state.astype("<u8").tobytes() + (
        np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b"")


def decode_block(data: bytes, n: int, t: Table, lanes: int = LANES) -> np.ndarray:
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    mask, read = (np.uint64(1) << t.bits) - np.uint64(1), 0
    for at in range(0, n, lanes):
        k = min(lanes, n - at)
        x = state[:k]
        slot = (x & mask).astype(np.int64)
        out[at:at + k] = t.symbol[slot]
        x = t.slot_freq[slot] * (x >> t.bits) + t.slot_rest[slot]
        short = np.flatnonzero(x < _LOW)
        x[short] = x[short] << _WORD | words[read:read + len(short)]
        read += len(short)
        state[:k] = x
    if read != len(words) or (state != _LOW).any():
        raise ValueError("block does not end where its encoder began")
    return out


def encode_chunk(docs: list[np.ndarray], t: Table) -> bytes:
    tokens = np.concatenate(docs)
    blocks = [tokens[i:i + BLOCK] for i in range(0, len(tokens), BLOCK)]
    data = [encode_block(b, t) for b in blocks]
    points = [(len(b), (len(d) - 8 * LANES) // 4, zlib.crc32(d)) for b, d in zip(blocks, data)]
    return b"".join([
        MAGIC, struct.pack("<5I", int(t.bits), LANES, len(tokens), len(docs), len(blocks)),
        np.array([len(d) for d in docs], "<u4").tobytes(), np.array(points, "<u4").tobytes(), *data])


def checkpoints(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Document lengths, and (byte offset, bytes, tokens, crc32) of each block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk")
    _, lanes, _, docs, blocks = struct.unpack_from("<5I", payload, 4)
    lengths = np.frombuffer(payload, "<u4", docs, 24)
    points = np.frombuffer(payload, "<u4", 3 * blocks, 24 + 4 * docs).reshape(-1, 3)
    at, out = 24 + 4 * docs + 12 * blocks, []
    for n, words, crc in points.tolist():
        out.append((at, 8 * lanes + 4 * words, n, crc))
        at += out[-1][1]
    return lengths, out


def decode_chunk(payload: bytes, t: Table, only: int | None = None) -> list[np.ndarray] | np.ndarray:
    """The documents' ids, or with ``only`` the ids of that block alone. Checksums must hold."""
    lengths, blocks = checkpoints(payload)
    parts = []
    for at, size, n, crc in blocks if only is None else blocks[only:only + 1]:
        data = payload[at:at + size]
        if zlib.crc32(data) != crc:
            raise ValueError("block checksum does not match")
        parts.append(decode_block(data, n, t))
    tokens = np.concatenate(parts)
    return tokens if only is not None else np.split(tokens, np.cumsum(lengths)[:-1])


# ---------------------------------------------------------------- tokens

@cache
def _library(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Pieces:
    """Encode whole texts with the tokenizers library, each distinct piece of text once.

    A byte-level pre-tokenizer never joins text across a single space or line end between two
    visible characters, so a text falls into pieces there, and its ids are those of its pieces one
    after another; nor does it join a letter and a stop that ends its piece. New pieces are encoded
    together, a line end between each two. A text with other white space, or with the text of an
    added token, goes to the library whole. Once ``KNOWN`` pieces are kept, later ones are encoded
    whenever they come; that changes no result.
    """

    KNOWN = 300_000
    _OTHER = re.compile("[\x00-\x09\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029"
                        "\u202f\u205f\u3000]")

    def __init__(self, path: str):
        self.library = _library(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line_end, self.stops = b"", {}
        self.line_end = self._whole(["\n"])[0]
        self.stops = {c: self._whole([c])[0] for c in ",."}
        self.known: dict[str, bytes] = {"\n": self.line_end}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> set[str]:
        """Add pieces to ``known`` and return them: a word before a stop by itself, the rest as they are."""
        stopped = [p for p in new if p[-1] in self.stops and p[-2:-1].isalpha()]
        plain = new.difference(stopped)
        plain.update({p[:-1] for p in stopped}.difference(self.known))
        for first in (True, False):
            keys = [p for p in plain if (p[0] == "\x00") is first]
            if not keys:
                continue
            text = "\n".join([p[1:] if first else " " + p for p in keys])
            data = self._whole([text])[0]
            ids = np.frombuffer(data, "<u4")
            cuts = np.flatnonzero(ids == int.from_bytes(self.line_end, "little"))
            if len(cuts) != len(keys) - 1:
                raise ValueError("this tokenizer joins text across line ends")
            ends = [*(4 * cuts).tolist(), len(data)]
            self.known.update(zip(keys, (data[i:j] for i, j in zip(
                [0, *(e + 4 for e in ends)], ends))))
        for p in stopped:
            self.known[p] = self.known[p[:-1]] + self.stops[p[-1]]
        return plain.union(stopped)

    def _plain(self, text: str) -> bool:
        flat = text.replace("\n", " ")
        return bool(flat) and flat[0] != " " != flat[-1] and "  " not in flat and not (
            self._OTHER.search(flat)) and not any(a in text for a in self.added)

    def _of_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: split and numbered by Arrow, each distinct piece looked up once."""
        # A part at the beginning of a line, which no space precedes, is marked by \x00.
        parts = pc.split_pattern(pa.array(["\x00" + t.replace("\n", " \n \x00") for t in texts],
                                          pa.large_string()), " ")
        words = parts.values.dictionary_encode()
        kinds = words.dictionary.to_pylist()
        full = len(self.known) > self.KNOWN
        added = self._learn(set(kinds).difference(self.known))
        data = [self.known[k] for k in kinds]
        for p in added if full else ():
            del self.known[p]
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        ids, start = np.frombuffer(b"".join(data), "<u4"), np.cumsum(size) - size
        at = words.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        # Each word's ids, one after another: place in the output, moved to the word's own start.
        out = ids[np.arange(end[-1]) + np.repeat(start[at] - (end - n), n)].tobytes()
        cuts = (4 * np.r_[0, end][parts.offsets.to_numpy()]).tolist()
        return [out[i:j] for i, j in zip(cuts, cuts[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        split = iter(self._of_pieces([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        whole = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        return [next(split if p else whole) for p in plain]


@cache
def pieces_of(path: str) -> Pieces:
    """One store of pieces for all tasks of a worker process."""
    return Pieces(path)


def width_of(path: str, end: int = END) -> int:
    """Bytes that any id of the tokenizer fits in: 2 or 4."""
    return 2 if max(_library(path).get_vocab_size(), end + 1) <= 1 << 16 else 4


def tokenize(docs: DataFrame, path: str, end: int = END, width: int = 4) -> DataFrame:
    """``doc_id, ids``: little-endian ids of ``width`` bytes of the whole text (null: empty), and end.

    Texts are taken by slices of a few megabytes, a longer one by itself.
    """
    last, kind = np.array([end], f"<u{width}").tobytes(), f"<u{width}"

    def run(batches):
        pieces = pieces_of(path)
        for b in batches:
            text = b.column("text").fill_null("")
            for part in slices([pa.RecordBatch.from_arrays([b.column("doc_id"), text],
                                                           ["doc_id", "text"])]):
                ids = pieces(part.column("text").to_pylist())
                if width != 4:
                    ids = [np.frombuffer(i, "<u4").astype(kind).tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([i + last for i in ids], pa.binary())],
                    ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids binary")


# ---------------------------------------------------------------- files

def write(ids: DataFrame, folder: str, per_file: int = 1 << 22, width: int = 4) -> None:
    """Write ``doc_id, ids`` (of ``width`` bytes each) in ascending doc_id order (null first; equal ids by their tokens).

    ``folder`` gets ``table`` (the shared frequencies) and ``chunks``. Token counts are summed in
    each task before they are shuffled; the table has one entry per vocabulary id. Documents are
    range-partitioned, so files follow one another in doc_id order, and a hot or repeated id is
    split by its tokens' checksum. Spark's commit makes a task's chunks visible once, so a lost
    executor only repeats its own range.
    """
    spark = ids.sparkSession

    def count(batches):
        total = np.zeros(1 << 12, np.int64)
        for b in batches:
            for part in slices([b], column="ids"):
                n = np.bincount(np.frombuffer(joined(part.column("ids"))[0].tobytes(),
                                              f"<u{width}"), minlength=len(total))
                total = np.pad(total, (0, len(n) - len(total))) + n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(used), longs(total[used])], ["token", "n"])

    seen = (ids.select("ids").mapInArrow(count, "token long, n long").groupBy("token")
            .agg(F.sum("n").alias("n")).orderBy("token").collect())
    counts = np.zeros(1 + max([0, *(r["token"] for r in seen)]), np.int64)
    counts[[r["token"] for r in seen]] = [r["n"] for r in seen]
    freq = frequencies(counts)
    spark.createDataFrame([(BITS, freq.astype("<u4").tobytes())], "bits int, freq binary").write \
        .parquet(f"{folder}/table")

    def pack(batches):
        from pyspark import TaskContext
        part, t = TaskContext.get().partitionId(), Table(freq)
        held, names, size, before, place = [], [], 0, 0, 0

        def chunk():
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([place], pa.int32()), longs([before]),
                longs([size]), pa.array([names], pa.list_(pa.int64())),
                pa.array([encode_chunk(held, t)], pa.binary())],
                ["part", "place", "before", "n_tokens", "doc_ids", "payload"])
        for b in batches:
            for name, v in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                held.append(np.frombuffer(v.as_py(), f"<u{width}").astype(np.int64))
                names.append(name)
                size += len(held[-1])
                if size >= CHUNK:
                    yield chunk()
                    held, names, before, size, place = [], [], before + size, 0, place + 1
        if held:
            yield chunk()

    files = max(1, -(-int(counts.sum()) // per_file))
    (ids.withColumn("crc", F.crc32("ids")).repartitionByRange(files, "doc_id", "crc")
     .sortWithinPartitions("doc_id", "crc").select("doc_id", "ids").mapInArrow(
        pack, "part int, place int, before long, n_tokens long, doc_ids array<long>, "
              "payload binary")
     .write.option("compression", "none").parquet(f"{folder}/chunks"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; every checksum is verified.

    Chunks are decoded where they lie, and their rows don't move: one total per file part is
    accumulated, and meets the chunks before they are decoded (broadcast if the counted parts allow).
    """
    table = spark.read.parquet(f"{folder}/table").first()
    freq = np.frombuffer(bytes(table["freq"]), "<u4").astype(np.int64)
    chunks = spark.read.parquet(f"{folder}/chunks")

    def run(batches):
        t = Table(freq)
        for b in batches:
            for start, names, payload in zip(*(b.column(c) for c in (
                    "start", "doc_ids", "payload"))):
                docs = decode_chunk(payload.as_py(), t)
                n = np.array([len(d) for d in docs], np.int64)
                yield pa.RecordBatch.from_arrays([
                    longs(names.as_py()), longs(start.as_py() + np.cumsum(n) - n), longs(n),
                    pa.array([d.astype("<u4").tobytes() for d in docs], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])
    offsets = saved(chunks.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(
            W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("part", "offset"), "offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return chunks.join(offsets, "part").select(
        (F.col("offset") + F.col("before")).alias("start"), "doc_ids", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode_documents(docs: DataFrame, tokenizer: str) -> tuple[str, DataFrame]:
    """Tokenize, write to a new shared folder and read back: the folder and ``read``'s rows."""
    spark = docs.sparkSession
    folder = new_path(spark, "rans")
    width = width_of(tokenizer)
    write(saved(tokenize(docs, tokenizer, width=width), "ids"), folder, width=width)
    return folder, read(spark, folder)


def op5_rans(spark, folder: str, tokenizer: str | None = None) -> DataFrame:
    _, rows = encode_documents(documents(spark, folder), tokenizer or default_tokenizer())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
