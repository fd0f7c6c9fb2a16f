"""Archives read back, by this package and by the library's own stream reader; copies, ties, odd urls, broken files."""

import base64
import glob
import hashlib
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from shelfwise.llm import warc
from tests.oracle import compare

SCHEMA = "page_id long, url string, html string"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, min_bytes=0):
    top, used = {}, set()
    lowest = -(1 << 63)
    for i, _, h in rows:
        h = (h or "").encode()
        top[h] = max(top.get(h, lowest), lowest if i is None else i)
    out = []
    for i, u, h in rows:
        h = (h or "").encode()
        first = len(h) < min_bytes or ((lowest if i is None else i) == top[h] and h not in used)
        used |= {h} if first else set()
        out.append((i, u, "response" if first else "revisit", len(h), sha1(h), None if first or top[h] == lowest else top[h]))
    return out


def by_page(rows):
    return sorted(((r[0], r[2], r[3], r[4], r[5]) for r in rows), key=repr)


ROWS = [
    (5, "http://a/", "<html>same</html>"), (9, "http://b/", "<html>same</html>"), (1, None, "<html>same</html>"), (2, "http://c/\r\nX-Page-ID: 77\r\n", None), (3, "http://d/%41 é", ""), (None, "http://e/", "alone"),
    (7, "http://f/", "tie"), (7, "http://g/", "tie"), (None, "http://h/", "none"), (None, "http://i/", "none"), (8, "http://j/", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"), (10, "http://k/", "é𝄞" * 40_000),
]


@pytest.mark.parametrize("min_bytes", [0, 4, 1000])
def test_round_trip(spark, tmp_path, min_bytes):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in ("payload", "row", "place", "key", "top", "digest", "n")})
    for k, again in enumerate((df, df.repartition(4))):
        warc.write_warc(again, path := f"{tmp_path}/{k}", min_bytes=min_bytes, archive_bytes=1 << 10)
        got = warc.read_warc(spark, path, with_payload=True).collect()
        assert by_page(got) == by_page(plain(ROWS, min_bytes))
        assert sorted((r.url or "") for r in got) == sorted((u or "") for _, u, _ in ROWS)
        assert all(sha1(bytes(r.payload)) == r.payload_digest for r in got if r.record_type == "response")
        assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], SCHEMA), path := f"{tmp_path}/w")
    assert warc.read_warc(spark, path).collect() == []


def test_other_readers_and_dictionary(spark, tmp_path):
    """Each archive begins with its dictionary; a stream reader that knows only that sees one WARC file; the dictionary pays."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(2)
    warc.write_warc(pages, path := f"{tmp_path}/w", archive_bytes=40 << 10, sample_bytes=200 << 10)
    files = [f for f in glob.glob(f"{path}/*") if not os.path.basename(f).startswith("_")]
    assert len(files) > 4
    seen = 0
    for name in files:
        data = open(name, "rb").read()
        assert data[:4] == warc.DICTIONARY.to_bytes(4, "little")
        size = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        assert known.dict_id() > 0
        with zstandard.ZstdDecompressor(dict_data=known).stream_reader(data[8 + size :], read_across_frames=True) as reader:
            whole = reader.read()
        seen += whole.count(b"WARC/1.1\r\nWARC-Type: ")
        at = 0
        while at < len(whole):  # by the lengths in the headers alone
            head = whole[at : whole.index(b"\r\n\r\n", at)]
            n = int(head.rpartition(b"Content-Length: ")[2])
            at += len(head) + 4 + n
            assert whole[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert seen == pages.count()


def test_dictionary_pays(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(1)
    size = {}
    for n in (0, 64 << 10):
        warc.write_warc(pages, path := f"{tmp_path}/{n}", dictionary_bytes=n)
        size[n] = sum(map(os.path.getsize, glob.glob(f"{path}/part-*")))
        assert warc.read_warc(spark, path).count() == pages.count()
    assert size[64 << 10] < size[0]


def test_records_are_read_alone():
    records = [warc.record(i, f"http://x/{i}", b"<p>words of a page</p>" * (i % 7), sha1(b"<p>words of a page</p>" * (i % 7)), 22 * (i % 7), None, "2024-01-01T00:00:00Z") for i in range(300)]
    trained = warc.dictionary(records, 4096)
    packer = warc._packer(trained, 3)
    data = b"".join(packer.compress(r) for r in records)
    view, at, ends = memoryview(data), 0, []
    while at < len(data):
        at = warc.frame_end(view, at)
        ends.append(at)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    assert opener.decompress(data[ends[99] : ends[100]]) == records[100]
    assert warc.dictionary([b"x"], 4096) is None


def test_broken_payload_is_an_error():
    good = warc.record(1, None, b"abc", sha1(b"abc"), 3, None, "2024-01-01T00:00:00Z")
    assert warc.parsed(good)[2] == b"abc"
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"abc", b"abd"))


def test_large_frames():
    """Blocks of every type, with and without a known size."""
    for data in (b"", b"a" * 500_000, os.urandom(300_000), b"ab" * 90_000 + os.urandom(1000)):
        for packer in (zstandard.ZstdCompressor(), zstandard.ZstdCompressor(write_checksum=True, write_content_size=False)):
            frame = packer.compress(data)
            assert warc.frame_end(memoryview(frame + b"more"), 0) == len(frame)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    assert compare(spark, warc.op13_warc, warc.OP13_SQL, f"/root/testdata/{sf}") >= 50
