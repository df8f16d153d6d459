"""WARC records in seekable Zstandard bundles, with repeated payloads written as revisits.

A bundle is a sequence of independent Zstandard frames, each of several whole records, followed by a seek table in a
skippable frame, so that a reader needs the footer and one frame for any record.  Bundles are rows of a table (Spark
commits them, so a lost executor only means that its tasks run again); next to each lies the index of its records:
record id -> (frame, offset in the frame, length).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm.common import register, table
from strandfold.session import scratch_path

# Fixed values of the seekable format and of the records.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CREATED = "2024-01-01T00:00:00Z"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23

INDEX = "array<struct<page_id:long,frame:int,offset:long,length:long>>"
BUNDLES = f"bundle_id string, data binary, index {INDEX}"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit of ``refers_to`` has no payload but its digest and length."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {CREATED}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record that ``data`` holds, as written by ``record``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    revisit = fields["WARC-Type"] == "revisit"

    def page(value: str | None):
        return int(value[10:-1]) if value and value[10:-1] else None

    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"] or None, "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")), "payload": None if revisit else payload,
    }


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Bundle:
    """Collects records into frames and closes with the seek table."""

    def __init__(self, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.pending, self.pending_bytes, self.packed_bytes = [], 0, 0
        self.index: list[dict] = []

    def add(self, page_id, data: bytes) -> None:
        if self.pending and self.pending_bytes + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append(
            {"page_id": page_id, "frame": len(self.frames), "offset": self.pending_bytes, "length": len(data)})
        self.pending.append(data)
        self.pending_bytes += len(data)

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.pending_bytes))
            self.packed_bytes += len(packed)
            self.pending, self.pending_bytes = [], 0

    def close(self) -> bytes:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of every frame, read from the footer."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 128 else 8
    at, start, out = len(data) - 9 - count * step, 0, []
    for k in range(count):
        packed, size = struct.unpack_from("<II", data, at + k * step)
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=size)


def read_record(data: bytes, frame: int, offset: int, length: int) -> dict:
    """One record by its place in the index: the footer and a single frame are read."""
    return parse(read_frame(data, seek_table(data)[frame])[offset : offset + length])


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads the row with the largest page_id is the response.

    Null html is an empty payload.  Payloads of fewer than ``least_bytes`` bytes, and rows whose page_id is the
    largest or null, refer to nothing.  Only (digest, largest id) of repeated payloads is joined back.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    known = rows.filter((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
    last = known.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    found = rows.join(last.filter("n > 1").select("digest", "last"), "digest", "left")
    refers = F.when(F.col("last") > F.col("page_id"), F.col("last"))
    return found.select("page_id", "url", "payload", refers.alias("refers_to"))


def bundles(rows: DataFrame) -> DataFrame:
    """(bundle_id, data, index) for rows of ``with_references``; bundles end at about ``BUNDLE_BYTES`` packed bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([
            ("bundle_id", pa.string()), ("data", pa.binary()),
            ("index", pa.list_(pa.struct([
                ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
        ])
        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(
                    [f"{part:06d}-{number:06d}", bundle.close(), bundle.index], names.types)], schema=names)

        for batch in batches:
            for row in batch.to_pylist():
                data = record(row["page_id"], row["url"], row["payload"], sha1_base32(row["payload"]), row["refers_to"])
                bundle.add(row["page_id"], data)
                if bundle.packed_bytes >= BUNDLE_BYTES:
                    yield closed()
                    number, bundle = number + 1, Bundle()
        if bundle.index:
            yield closed()

    return rows.mapInArrow(pack, BUNDLES)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html; other columns are left out) as a table of bundles."""
    bundles(with_references(pages, least_bytes)).write.parquet(path)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of a table of bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Every frame is unpacked once and its records are cut out by the index; payload digests are verified.  A revisit has
    no payload of its own; without ``payloads`` none is returned.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                frames = seek_table(row["data"])
                by_frame: dict[int, list[dict]] = {}
                for place in row["index"]:
                    by_frame.setdefault(place["frame"], []).append(place)
                for number, places in by_frame.items():
                    raw = read_frame(row["data"], frames[number])
                    found = [parse(raw[p["offset"] : p["offset"] + p["length"]]) for p in places]
                    if not payloads:
                        for f in found:
                            f["payload"] = None
                    names = list(found[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[n] for f in found], t) for n, t in zip(names, kinds)], names=names)

    return archives.select("data", "index").mapInArrow(unpack, RECORDS)


def bundle_rows(archives: DataFrame) -> DataFrame:
    """The index as a table: (page_id, bundle_id, frame, offset, length)."""
    return archives.select("bundle_id", F.inline("index")).select("page_id", "bundle_id", "frame", "offset", "length")


SQL_TEXT = r"""
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b) n, sha1(b) h from p),
bits as (select page_id, n, h, list_aggregate(list_transform(range(1, 41),
  lambda k: right('000' || bin(strpos('0123456789abcdef', h[k]) - 1), 4)), 'string_agg', '') s from d),
b32 as (select page_id, n, h, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (1 + list_sum(list_transform(range(0, 5), lambda j: case when s[5 * k + j + 1] = '1' then (1 << (4 - j)) else 0 end)))::int, 1)),
  'string_agg', '') g, max(page_id) over (partition by h, n) top from bits)
select page_id, n payload_bytes, g payload_digest, case when top > page_id then 'revisit' else 'response' end record_type,
  case when top > page_id then top end refers_to from b32
"""


@register("op6_warc_bundles", SQL_TEXT)
def op6(spark, sf_dir):
    """Every page as a record of the archives that were written from the table and read back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark.read.schema(BUNDLES).parquet(path), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
