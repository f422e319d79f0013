"""WARC archives with a Zstandard dictionary per file.

A file starts with a skippable frame that embeds a dictionary built from the
file's own records; every record is one frame compressed with it, so a record
can be read alone. Files are written by Spark's text writer, which commits whole
tasks: a lost executor leaves no half archive. The writer ends every row with a
line feed, so each row closes with a skippable frame whose one byte of content
is that line feed; the bytes are a valid ``.warc.zst`` stream.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import arrow_rows, in_arrow, shared_path

DICTIONARY_FRAME, PLAIN_FRAME = 0x184D2A5D, 0x184D2A50
#: Closes a row; the writer's line feed is the frame's content.
LINE_FRAME = struct.pack("<II", PLAIN_FRAME, 1)
#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Records buffered to build a dictionary, their bytes, and the dictionary's size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 4 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _uri(url: str | None) -> str:
    """The URL with blanks, controls and non-ASCII bytes percent-encoded: one header line."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in (url or "").encode("utf-8", "replace"))


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit holds the HTTP header only, and the digest and length of the payload it refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}", f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """Fields of a record; checks the payload of a response against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("the payload does not match its digest")
    number = lambda text: int(text) if text else None
    return {
        "page_id": number(fields["Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": digest,
        "payload_bytes": int(http.rsplit(b": ", 1)[1]), "refers_to": number(fields.get("Refers-To-Page-ID", "")),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from the records; of a few records their text itself serves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def pack_rows(records: Iterator[bytes], level: int = 6) -> Iterator[bytes]:
    """The rows of one archive: the dictionary's frame, then a frame per record."""
    held: list[bytes] = []
    total = 0
    compressor = None

    def start() -> bytes:
        nonlocal compressor
        words = build_dictionary(held)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
        return struct.pack("<II", DICTIONARY_FRAME, len(words)) + words + LINE_FRAME

    for record in records:
        if compressor:
            yield compressor.compress(record) + LINE_FRAME
            continue
        held.append(record)
        total += len(record)
        if len(held) >= SAMPLE_RECORDS or total >= SAMPLE_BYTES:
            yield start()
            yield from (compressor.compress(r) + LINE_FRAME for r in held)
            held.clear()
    if held:
        yield start()
        yield from (compressor.compress(r) + LINE_FRAME for r in held)


def rolled_rows(records: Iterator[bytes], most: int) -> Iterator[tuple[int, int, bytes]]:
    """(archive, place, row) of as many archives as it takes: a new one, with a dictionary of its own, once one has ``most`` bytes."""
    archive, ahead = 0, next(records, None)
    while ahead is not None:
        size = 0

        def some() -> Iterator[bytes]:
            record = ahead
            while record is not None:
                yield record
                if size >= most:
                    return
                record = next(records, None)

        for place, row in enumerate(pack_rows(some())):
            size += len(row)
            yield archive, place, row
        archive, ahead = archive + 1, next(records, None)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends: its header, blocks and checksum."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    data, at = memoryview(archive), 0
    opener = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic >> 4 == PLAIN_FRAME >> 4:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if magic == DICTIONARY_FRAME:
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : end])))
        else:
            end = _frame_end(data, at)
            yield opener.decompress(data[at:end])
        at = end


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` to archives below ``path``.

    A task begins a new archive once one has ``archive_bytes``, so a file stays small
    enough to be read as one value, however many pages a task has.

    Of the records with equal payloads of ``least_bytes`` or more, that with the
    largest page_id is a response and the others revisit it; rows tied at that id
    are all responses. Shorter payloads are all responses. A null html is an empty
    payload, a null URL an empty one; null page_ids count as smallest, and where
    all of a group are null all are responses. An empty table writes no archive.

    Payloads are exchanged once, by digest; a hot digest is split by the join.
    """
    digest = F.sha1(F.encode("html", "UTF-8"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    latest = rows.where(F.octet_length("html") >= least_bytes).groupBy(digest.alias("__digest")).agg(F.max("page_id").alias("__latest"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    placed = rows.withColumn("__key", digest).join(latest, F.col("__key") == F.col("__digest"), "left").select("page_id", "url", "html", "__latest")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    for page_id, url, html, latest_id in zip(*(part.column(k).to_pylist() for k in range(4))):
                        revisit = latest_id is not None and page_id != latest_id
                        yield make_record(page_id, url, html.encode("utf-8", "replace"), latest_id, revisit)

        kinds, names = [pa.int32(), pa.int64(), pa.binary()], ["archive", "place", "frame"]
        held, size = [], 0
        for row in rolled_rows(records(), archive_bytes):
            held.append(row)
            size += len(row[2])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    frames = placed.transform(in_arrow, pack, "archive int, place bigint, frame binary").sortWithinPartitions("archive", "place")
    frames.select(F.col("frame").cast("string").alias("value"), "archive").write.partitionBy("archive").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """A row per record of the archives below ``path``; each file is read by one task."""

    def make():
        def step(batch: pa.RecordBatch):
            for archive in batch.column(0):
                for record in unpack(archive.as_buffer()):
                    row = read_record(record)
                    row.pop("payload")
                    yield row

        return step

    files = spark.read.format("binaryFile").load(path).select("content")
    return arrow_rows(files, make, "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint", rows=1)


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives to a new shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
