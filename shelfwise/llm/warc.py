"""WARC archives with a Zstandard dictionary each.

An archive is a file of frames: a skippable frame that holds a dictionary trained on the archive's own records, then one
Zstandard frame for each WARC record, which can be read alone given the dictionary, then a skippable frame of one byte.

Spark writes the files: a task makes whole archives of bounded size, a row each, and the text writer, one row a file, puts
them where any of Hadoop's file systems reaches and commits them with the job, so an archive appears whole or not at all. The
line end that the writer adds is the content of the last, skippable frame.

A payload that several pages have is stored once. The page of the largest id is a ``response``, the others are ``revisit``
records that name it and have no payload of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import broadcast_if, column, keep, new_path
from ._words import release

#: The magic numbers of a Zstandard frame, of the skippable frame of a dictionary, and of the first other skippable frame.
FRAME, DICTIONARY, SKIPPED = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
#: What a revisit record says of itself.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
#: Pages whose decision is broadcast, at most; more are joined.
BROADCAST_ROWS = 500_000


def _little(n: int, size: int = 4) -> bytes:
    return n.to_bytes(size, "little")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    """A header's value: percent signs, white space and control characters as percent escapes, so that it stays one line and can be read back."""
    return re.sub(r"[%\s\x00-\x1f\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def _from_line(value: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n: int, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or, without one, a revisit."""
    kind = "revisit" if payload is None else "response"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {page_id} {digest} {url}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}"] + ([] if refers_to is None else [f"X-Refers-To-Page-ID: {refers_to}"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parsed(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers, full length of the payload, and the payload, of a record of this writer; a payload is held against its digest."""
    end = data.index(b"\r\n\r\n")
    head = _headers(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    http = block.index(b"\r\n\r\n")
    n = int(_headers(block[:http])["content-length"])
    if head["warc-type"] == "revisit":
        return head, n, None
    payload = block[http + 4 :]
    if len(payload) != n or "sha1:" + base32_sha1(payload) != head["warc-payload-digest"]:
        raise ValueError(f"record {head.get('warc-record-id')} does not have the payload that its headers name")
    return head, n, payload


def dictionary(records: list[bytes], size: int) -> bytes | None:
    """A dictionary of up to ``size`` bytes, and a 32nd part of the records, trained on these. Few or large ones are given in pieces;
    None if they are too little to train on."""
    total = sum(map(len, records))
    size = min(size, total // 32)
    pieces = records if len(records) >= 64 else [r[i : i + 512] for r in records for i in range(0, len(r), 512)]
    if size < 256:
        return None
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return None


def _packer(trained: bytes | None, level: int) -> zstandard.ZstdCompressor:
    if trained is None:
        return zstandard.ZstdCompressor(level=level, write_checksum=True)
    known = zstandard.ZstdCompressionDict(trained)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by the lengths in its header and blocks."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & ~0xF == SKIPPED:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if magic != FRAME:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single, sizes = flags >> 5 & 1, flags >> 6
    to = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[sizes]
    last = 0
    while not last:
        block = int.from_bytes(data[to : to + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        to += 3 + (1 if kind == 1 else block >> 3)
    return to + 4 * (flags >> 2 & 1)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed alone."""
    view, at = memoryview(data), 0
    opener = zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic == DICTIONARY:
            opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : end])))
        elif magic == FRAME:
            yield opener.decompress(view[at:end])
        at = end


def _writer(archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # records before there is a dictionary
        size = packed = 0
        packer, out = None, bytearray()

        def start() -> None:
            nonlocal packer, held, out
            trained = dictionary(held, dictionary_bytes)
            packer = _packer(trained, level)
            if trained is not None:
                out += _little(DICTIONARY) + _little(len(trained)) + trained
            for r in held:
                out += packer.compress(r)
            held = []

        def closed() -> pa.RecordBatch:
            nonlocal packer, out, size
            if packer is None:
                start()
            out += _little(SKIPPED) + _little(1)
            row = pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["archive"])
            packer, out, size = None, bytearray(), 0
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, n, refers_to = (batch.column(c)[i].as_py() for c in range(6))
                r = record(page_id, url, payload, base64.b32encode(digest).decode(), n, refers_to, date)
                size += len(r)
                if packer is None:
                    held.append(r)
                    if size >= sample_bytes:
                        start()
                else:
                    out += packer.compress(r)
                if len(out) >= archive_bytes:
                    yield closed()
        if held or out:
            yield closed()
        release()

    return run


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, n, refers_to`` of each page; ``payload`` is null where another page of the same one is the response.

    Payloads are the same if their SHA-256 are. Pages of one payload that share an id, or have none, are told apart by numbers of
    their rows, written once: one of them is the response, the others refer to its id. A null id is smaller than any other.
    """
    html = F.coalesce(column("html").cast("string"), F.lit("")).cast("binary")
    lowest = F.lit(-(1 << 63)).cast("long")
    zero = F.lit(0).cast("long")
    chosen = pages.select(column("page_id").cast("long").alias("page_id"), column("url").cast("string").alias("url"), html.alias("payload"), zero.alias("row"))
    place = F.struct(F.coalesce("page_id", lowest).alias("id"), "row").alias("place")
    key = F.unhex(F.sha2("payload", 256)).alias("key")

    def keys_of(rows: DataFrame) -> DataFrame:
        return keep(rows.filter(F.octet_length("payload") >= min_bytes).select(key, place), "warc-keys")

    keys = keys_of(chosen)
    if keys.groupBy("key", "place").count().filter("count > 1").limit(1).count():  # a copy of the pages, only where ids leave a tie
        chosen = keep(chosen.withColumn("row", F.monotonically_increasing_id()), "warc-pages")
        keys = keys_of(chosen)
    groups = keep(keys.groupBy("key").agg(F.max("place").alias("top"), F.count("*").alias("pages")).filter("pages > 1").drop("pages"), "warc-groups")
    joined = chosen.withColumns({"key": key, "place": place}).join(broadcast_if(groups, BROADCAST_ROWS), "key", "left")
    first = F.col("top").isNull() | (F.octet_length("payload") < min_bytes) | (F.col("place") == F.col("top"))
    refers_to = F.when(~first & (F.col("top.id") != lowest), F.col("top.id"))
    return joined.select(
        "page_id", "url", F.when(first, F.col("payload")).alias("payload"), F.unhex(F.sha1("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("n"), refers_to.alias("refers_to"),
    )


def write_warc(
    pages: DataFrame, path: str, *, min_bytes: int = 0, archive_bytes: int = 16 << 20, sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Writes a record for every page (``page_id, url, html``) into archives below ``path``.

    The payload is the whole html in UTF-8 (null: empty). Of pages with the same payload of at least ``min_bytes`` bytes, that of
    the largest id is the response; see ``decided``. An archive's dictionary has up to ``dictionary_bytes`` and is trained on
    the records it begins with, up to ``sample_bytes`` of them; archives of less than about 8 kB have none. A new archive begins
    once one has ``archive_bytes``, so a task holds the larger of that and of its longest record. All records have one
    ``date``, so that reruns agree. White space, control characters and percent signs of a url are written as percent escapes;
    a null url or id has no header. An empty table gives files without records. Other columns are not read.
    """
    rows = decided(pages, min_bytes)
    made = rows.mapInArrow(_writer(archive_bytes, sample_bytes, dictionary_bytes, level, date), "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for value in batch.column(0):
                rows, held = [], 0
                for data in frames(value.as_buffer()):
                    head, n, payload = parsed(data)
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    url = _from_line(head["warc-target-uri"]) if "warc-target-uri" in head else None
                    rows.append((number("x-page-id"), url, head["warc-type"], n, head["warc-payload-digest"].removeprefix("sha1:"), number("x-refers-to-page-id")) + ((payload,) if with_payload else ()))
                    held += len(payload or b"") if with_payload else 0
                    if held >= 8 << 20 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
        release()

    return run


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """A row for each record below ``path``: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to``, and the
    ``payload`` (null for revisits) if asked for. A payload that differs from its digest is an error, as is a broken frame."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), RECORDS + ", payload binary" * with_payload)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all ``pages``, read back from their archives."""
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
tops AS (SELECT html, max(page_id) AS top FROM own GROUP BY html),
hashed AS (SELECT page_id, top, strlen(html) AS n, sha1(html) AS hex FROM own JOIN tops USING (html))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM hashed
"""
