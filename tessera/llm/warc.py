"""Web archives as seekable Zstandard bundles.

An archive file is a row of independent Zstandard frames, each holding whole WARC records, then a
skippable frame with the index of the records (identifier, frame, offset in the decompressed frame,
length), then the seek table of the public seekable format as footer. Any frame can be found and
decompressed without the others, and any Zstandard tool reads the whole file.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import longs, slices
from tessera.session import new_path, written

# Fixed values of the WARC and seekable Zstandard formats.
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CHECKSUMS = 0x80

LEAST_REVISIT = 100          # bytes of payload below which equal records are all stored
FRAME_BYTES = 1 << 18        # a frame is closed once its records reach this size
ARCHIVE_BYTES = 32 << 20     # an archive is closed once its frames reach this size
BROADCAST_ROWS = 200_000     # repeated payloads; beyond this the lookup is a shuffle join
_NAME = b"urn:x-page:"


def annotated(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each page's record says.

    Of equal payloads of at least 100 bytes the smallest page_id stays a response (``refers_to``
    null), the others refer to it. Rows that repeat that id are responses too, since a record can't
    revisit itself; null ids come last, and where all are null all stay responses. The smallest id
    is a partial aggregate by digest, so a payload that a third of the pages share costs one row a
    task; only digests that occur twice go into the lookup, broadcast if its counted rows allow.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = written(
        page.where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null").select("same", "first"), "repeated_payloads")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    return page.join(first, page["digest"] == first["same"], "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def identifier(page_id: int | None) -> bytes:
    return _NAME + (b"null" if page_id is None else b"%d" % page_id)


def page_of(name: bytes) -> int | None:
    last = name.rsplit(b":", 1)[1]
    return None if last == b"null" else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record: the HTTP response with its payload, or a revisit with the head alone."""
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d"
             b"\r\n\r\n" % len(payload))
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            b"WARC-Record-ID: <" + identifier(page_id) + b">", b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(
            url.strip() or "about:blank", safe="%:/?#[]@!$&'()*+,;=-._~").encode())
    if refers_to is not None:
        head += [b"WARC-Refers-To: <" + identifier(refers_to) + b">", b"WARC-Profile: " + PROFILE]
    else:
        block += payload
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(),
             b"Content-Type: application/http; msgtype=response",
             b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[int | None, str, int | None, str, int, bytes | None]:
    """(page_id, type, refers_to, digest, payload bytes, payload or None) of one record.

    A response's payload must have the length and digest that its heads name.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    field = dict(line.split(b": ", 1) for line in lines)
    size = int(field[b"Content-Length"])
    if version != b"WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(http.rsplit(b": ", 1)[1])
    digest = field[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    page = page_of(field[b"WARC-Record-ID"][1:-1])
    if field[b"WARC-Type"] == b"revisit":
        return page, "revisit", page_of(field[b"WARC-Refers-To"][1:-1]), digest, length, None
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload does not match its digest")
    return page, "response", None, digest, length, payload


class Writer:
    """Collects records into frames and gives the archive's bytes at the end."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames, self.seek, self.index = [], [], []
        self.open, self.at, self.size = [], 0, 0

    def add(self, name: bytes, data: bytes) -> None:
        self.index.append(b"%d %d %d %s\n" % (len(self.frames), self.at, len(data), name))
        self.open.append(data)
        self.at += len(data)
        if self.at >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            data = b"".join(self.open)
            packed = self.packer.compress(data)
            self.frames.append(packed)
            self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.size += len(packed)
            self.open, self.at = [], 0

    def close(self) -> bytes:
        self.end_frame()
        index = self.packer.compress(b"".join(self.index))
        self.frames.append(struct.pack("<2I", INDEX_FRAME, len(index)) + index)
        self.seek.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<3I", *s) for s in self.seek) + struct.pack(
            "<IBI", len(self.seek), CHECKSUMS, SEEK_MAGIC)
        return b"".join([*self.frames, struct.pack("<2I", SEEK_FRAME, len(table)), table])


class Reader:
    """One archive: seek table and index at once, frames when asked for."""

    def __init__(self, data: bytes):
        self.data = data
        n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end")
        table = len(data) - 9 - 12 * n
        if struct.unpack_from("<2I", data, table - 8) != (SEEK_FRAME, 12 * n + 9):
            raise ValueError("seek table does not match its frame")
        self.seek, at = [], 0
        for packed, size, check in struct.iter_unpack("<3I", data[table:len(data) - 9]):
            self.seek.append((at, packed, size, check))
            at += packed
        if at != table - 8:
            raise ValueError("frames don't fill the archive")
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, size, check = self.seek[i]
        out = self.unpacker.decompress(self.data[at:at + packed])
        if len(out) != size or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError("frame checksum does not match")
        return out

    def index(self) -> list[tuple[bytes, int, int, int]]:
        """(identifier, frame, offset in it, length) of every record, in order."""
        at, packed, *_ = self.seek[-1]
        if struct.unpack_from("<2I", self.data, at) != (INDEX_FRAME, packed - 8):
            raise ValueError("no index before the seek table")
        lines = self.unpacker.decompress(self.data[at + 8:at + packed]).split(b"\n")[:-1]
        rows = (line.split(b" ", 3) for line in lines)
        return [(name, int(f), int(a), int(n)) for f, a, n, name in rows]

    def records(self, entries):
        """The records of ``entries`` (frame, offset, length), each frame decompressed once a run."""
        now, data = -1, b""
        for frame, at, length in entries:
            if frame != now:
                now, data = frame, self.frame(frame)
            yield data[at:at + length]


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
          frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record a row of ``pages`` (``page_id, url, html``) into archives in ``folder``.

    Each task turns its rows into archives of about ``archive_bytes`` compressed, so memory holds
    one archive and no row moves except for the digests of ``annotated``. Archives go through
    Spark's committer to any file system: a row of the text writer is a whole file, its line
    separator being the last four bytes that every archive ends in; a task run twice leaves one
    copy. Null html is an empty payload, a null url gives no target field, a null id is named so;
    repeated rows are written each; a page larger than a frame or an archive is one by itself;
    an empty table gives a folder without records. The pages have no capture time: ``date`` is
    written in all records. Other columns are not read.
    """
    def pack(batches):
        out = Writer(frame_bytes)
        for b in slices(batches, column="payload"):
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                out.add(identifier(page), record(page, url, payload, digest, refers, date))
                if out.size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([out.close()[:-4]])], ["archive"])
                    out = Writer(frame_bytes)
        if out.index:
            yield pa.RecordBatch.from_arrays([pa.array([out.close()[:-4]])], ["archive"])

    (annotated(pages).mapInArrow(pack, "archive binary")
     .select(F.col("archive").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", struct.pack("<I", SEEK_MAGIC).decode("latin-1")).text(folder))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of each archive; empty files of empty tasks are left out."""
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, path, frame, at, length`` of every record, without decompressing a frame."""
    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                rows = Reader(data.as_py()).index()
                yield pa.RecordBatch.from_arrays(
                    [longs([page_of(r[0]) for r in rows]), pa.array([path] * len(rows), pa.string()),
                     *(longs([r[k] for r in rows]) for k in (1, 2, 3))],
                    ["page_id", "path", "frame", "at", "length"])
    return archives(spark, folder).mapInArrow(
        run, "page_id long, path string, frame long, at long, length long")


def read(spark: SparkSession, folder: str, pages: DataFrame | None = None,
         payloads: bool = True) -> DataFrame:
    """``page_id, record_type, refers_to, payload_digest, payload_bytes, payload`` of the records.

    With ``pages`` (a ``page_id`` column) only the frames that hold those pages' records are
    decompressed, by the index. A revisit has no payload of its own; ``payloads=False`` checks
    payloads but doesn't hand them on. Any checksum or length that doesn't match raises.
    """
    table = archives(spark, folder)
    if pages is None:
        table = table.withColumn("entries", F.lit(None).cast("array<array<long>>"))
    else:
        wanted = index(spark, folder).join(pages.select("page_id").distinct(), "page_id", "left_semi")
        table = table.join(wanted.groupBy("path").agg(F.sort_array(F.collect_list(
            F.array("frame", "at", "length"))).alias("entries")), "path")

    def run(batches):
        for b in batches:
            for data, entries in zip(b.column("content"), b.column("entries").to_pylist()):
                archive = Reader(data.as_py())
                rows, size = [], 0
                for data in archive.records(
                        entries or [entry[1:] for entry in archive.index()]):
                    rows.append(parsed(data))
                    size += len(data)
                    if size >= 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    def batch(rows):
        page, kind, refers, digest, n, payload = zip(*rows) if rows else [()] * 6
        return pa.RecordBatch.from_arrays(
            [longs(page), pa.array(kind, pa.string()), longs(refers), pa.array(digest, pa.string()),
             longs(n), pa.array(payload if payloads else [None] * len(n), pa.binary())],
            ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
    return table.select("content", "entries").mapInArrow(
        run, "page_id long, record_type string, refers_to long, payload_digest string, "
             "payload_bytes long, payload binary")


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload`` of all pages, a revisit's payload taken from the record it refers to."""
    rows = read(spark, folder)
    kept = rows.where("record_type = 'response'").select("page_id", "payload")
    revisits = rows.where("record_type = 'revisit'").select("page_id", "refers_to")
    origin = kept.select(F.col("page_id").alias("refers_to"), "payload").join(
        revisits.select("refers_to").distinct(), "refers_to", "left_semi").dropDuplicates(["refers_to"])
    return kept.unionByName(revisits.join(origin, "refers_to").select("page_id", "payload"))


OP13_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end
           as record_type,
       case when payload_bytes >= 100 and first <> page_id then first end as refers_to
from f
"""


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives with the default sizes, then read back through their index."""
    target = new_path(spark, "warc")
    write(spark.read.parquet(f"{folder}/pages.parquet"), target)
    return read(spark, target, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
