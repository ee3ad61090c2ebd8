"""Archives: format, index, revisits and an exact round trip."""

import collections
import hashlib
import random

import pytest
import zstandard

SCHEMA = "page_id long, url string, html string, path string, digest string, first long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, f"http://h/{i}", "<p>" + " ".join(str(rng.random()) for _ in range(rng.randint(
        0, 60))) + "é</p>", "x", "y", 1) for i in range(60)]
    same = "<html>" + "copy " * 40
    out += [(i, None, same, None, None, None) for i in (105, 101, 103, 101, None)]
    out += [(200, "u", "short", "x", "y", 1), (201, "u", "short", "x", "y", 1)]
    out += [(300, "a b\r\nWARC-Type: x", None, "x", "y", 1), (301, "", "", "x", "y", 1)]
    out += [(None, "u", "n" * 150, "x", "y", 1), (None, "u", "n" * 150, "x", "y", 1)]
    out += [(400, "u", "long \r\n\r\n" * 90_000, "x", "y", 1),
            (399, "u", "long \r\n\r\n" * 90_000, "x", "y", 1)]
    out += [(500, "u", "a" * 100, "x", "y", 1), (501, "u", "a" * 100, "x", "y", 1),
            (502, "u", "b" * 99, "x", "y", 1), (503, "u", "b" * 99, "x", "y", 1)]
    return out


def expected(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r[0])
    out = []
    for page, _, html, *_ in rows:
        b = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        revisit = len(b) >= 100 and ids and min(ids) != page
        out.append((page, len(b), hashlib.sha256(b).hexdigest(),
                    "revisit" if revisit else "response", min(ids) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame,archive", [(1 << 18, 32 << 20), (500, 3000)])
def test_round_trip(spark, rows, tmp_path, frame, archive):
    from tessera.llm import warc
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = str(tmp_path / "warc")
    warc.write(pages, folder, frame_bytes=frame, archive_bytes=archive)
    got = warc.read(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got), key=str) == expected(rows)
    back = [(r.page_id, bytes(r.payload).decode()) for r in warc.restored(spark, folder).collect()]
    assert sorted(back, key=str) == sorted(((r[0], r[2] or "") for r in rows), key=str)
    # Records by id, from their frames alone.
    some = spark.createDataFrame([(5,), (101,), (400,), (9999,)], "page_id long")
    assert sorted(r.page_id for r in warc.read(spark, folder, some).collect()) == [5, 101, 101, 400]
    index = warc.index(spark, folder).collect()
    assert len(index) == len(rows)
    files = {r.path: bytes(r.content) for r in warc.archives(spark, folder).collect()}
    assert (len(files) > 3) == (archive < 1 << 20)
    for path, data in files.items():
        archive_file = warc.Reader(data)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall()
        mine = [archive_file.frame(i) for i in range(len(archive_file.seek) - 1)]
        assert whole == b"".join(mine) and whole.count(b"WARC/1.1\r\n") == len(archive_file.index())
        for r in (r for r in index if r.path == path):
            assert warc.parsed(mine[r.frame][r.at:r.at + r.length])[0] == r.page_id
        for at in (len(data) - 9 - 12 * len(archive_file.seek) + 8, len(data) - 1):
            bad = bytearray(data)                      # a frame's checksum, then the footer
            bad[at] ^= 1
            with pytest.raises(ValueError):
                warc.Reader(bytes(bad)).frame(0)


def test_large_lookup_and_empty(spark, rows, tmp_path, monkeypatch):
    from tessera.llm import warc
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame(rows, SCHEMA)
    got = warc.annotated(pages).select("page_id", "refers_to").collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(
        ((r[0], r[4]) for r in expected(rows)), key=str)
    folder = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read(spark, folder).count() == 0 and warc.restored(spark, folder).count() == 0
