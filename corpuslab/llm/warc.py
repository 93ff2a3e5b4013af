"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with whole records, and
a footer with the sizes of all frames in the seekable format, which plain
decompressors skip.  The index maps a record's id to its bundle, frame, and
offset inside the frame, so that one record is read by decompressing one frame.
Records of equal payloads refer to the one of the largest page id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, frugal, written

# fixed values of the seekable format
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long, record_type string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, date: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit has the block's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """(WARC headers, payload, HTTP headers) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])


class BundleWriter:
    """Writes records into frames of about ``frame_bytes``, then the seek table."""

    def __init__(self, sink, frame_bytes: int, level: int = 6):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset inside it, length) of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size, len(record)
        self.open.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, source, size: int):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the bundle has no seek table")
        width = 12 if flags & 0x80 else 8
        source.seek(size - 9 - width * count)
        table = source.read(width * count)
        self.places, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, width * k)
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.places[number]
        self.source.seek(at)
        return self.unpacker.decompress(self.source.read(packed), max_output_size=plain)


def _duplicates(pages: DataFrame, least: int) -> DataFrame:
    """Digests of payloads of ``least`` bytes or more that several pages have, and their largest id."""
    same = pages.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    return written(same.filter("copies > 1").drop("copies"), "warc-same")


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, frame_bytes: int = 1 << 18, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` and return the index of the records.

    Among rows of equal payloads of at least ``least_bytes`` bytes, those of the
    largest id are responses and the others revisits; all rows of smaller
    payloads are responses.  A null payload is empty, a null url too; a null id
    is smaller than any other, and where no row of a payload has an id, all of
    them are responses, as no revisit could name one.  Rows that are equal
    throughout are written each.  A record's id is ``urn:page:`` and the page's
    id; rows without an id, or that share one, have their bundle and place in it
    added, so that no two records have the same.  Other columns are ignored.
    Bundles lie in ``folder``, one for each task, under names that no second
    attempt of the task shares; only the attempt that ended well is indexed.  No
    rows give bundles with a seek table alone.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    source = source.withColumn("digest", F.sha1("payload"))
    marked = source.join(_duplicates(source, least_bytes), "digest", "left")
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    shared = written(source.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1 and page_id is not null").select("page_id", F.lit(True).alias("shared")), "warc-shared")
    marked = marked.join(shared, "page_id", "left")
    plain = F.col("page_id").isNotNull() & F.col("shared").isNull()
    marked = marked.select("page_id", "url", "payload", "keeper", F.coalesce(revisit, F.lit(False)).alias("revisit"), plain.alias("plain"))

    def write(batches: Iterator[pa.RecordBatch]):
        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{path}/part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        writer, done = BundleWriter(store.open_output_stream(name, compression=None), frame_bytes), 0
        for batch in batches:
            out = [[] for _ in range(7)]
            for page_id, url, payload, keeper, again, plain in zip(*(c.to_pylist() for c in batch.columns)):
                payload = payload.encode()
                record_id = f"urn:page:{page_id}" if plain else f"urn:page:{page_id}:{name.rpartition('/')[2].partition('.')[0]}:{done}"
                done += 1
                record = record_bytes(record_id, url, payload, payload_digest(payload), date, keeper, again)
                row = (record_id, page_id, f"{folder}/{name.rpartition('/')[2]}", *writer.add(record), "revisit" if again else "response")
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split(" ")[0] for x in INDEX.split(", ")])
        writer.close()

    return written(marked.mapInArrow(frugal(write), INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the indexed records, each out of its frame.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url
    and payload (null for revisits).  A response's length and digest are those of
    the payload read; a revisit's are in its headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
    def number(urn: str) -> int | None:
        page_id = urn.strip("<>").split(":")[2]
        return None if page_id == "None" else int(page_id)

    def read(batches: Iterator[pa.RecordBatch]):
        bundle = reader = frame = data = None
        for batch in batches:
            for k in range(0, len(batch), 500):
                rows = []
                for name, part, offset, length in zip(*(batch.slice(k, 500).column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                    if name != bundle:
                        store, path = fs.FileSystem.from_uri(name)
                        reader = BundleReader(store.open_input_file(path), store.get_file_info(path).size)
                        bundle, frame = name, None
                    if part != frame:
                        frame, data = part, reader.frame(part)
                    headers, payload, http = parse_record(data[offset : offset + length])
                    again = headers["WARC-Type"] == "revisit"
                    size, digest = (int(http["Content-Length"]), headers["WARC-Payload-Digest"].partition(":")[2]) if again else (len(payload), payload_digest(payload))
                    refers = number(headers["WARC-Refers-To"]) if again else None
                    rows.append((number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], refers, headers["WARC-Target-URI"], None if again else payload.decode()))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                columns = zip(*rows) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [x.split(" ")[0] for x in schema.split(", ")])

    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a few neighbouring frames go to a task together: a large bundle is read by several
    deal = index.repartition(parts, "bundle", F.floor(F.col("frame") / 8)).sortWithinPartitions("bundle", "frame", "offset")
    return deal.select("bundle", "frame", "offset", "length").mapInArrow(frugal(read), schema)
