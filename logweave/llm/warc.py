"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent zstd frames, each holding whole WARC
records up to about FRAME_BYTES, and ends with a seek table in a skippable
frame (the public seekable format: per frame its compressed and plain size,
then the number of frames, a descriptor byte and a magic number). Any
zstd reader can read a bundle from end to end; a seeker reads the table, then
one frame.

Bundles are rows of a table (``bundle``, ``data``) with, beside each, the map
from record identifiers to (frame, offset in the plain frame, length). Spark's
writer commits them, so a lost executor leaves no half-written archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, join_on, stage

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24  # plain bytes after which a bundle is closed
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ── records ────────────────────────────────────────────────────────────────
def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    value = identifier[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def make_record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": _DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(size),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": "0" if revisit else str(len(payload)),
    }
    if url is not None:  # a header is one line
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the offset behind the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    to = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : to], to + 4


# ── bundles ────────────────────────────────────────────────────────────────
class BundleWriter:
    """Collects records into frames; ``close`` gives the bundle and its record map."""

    def __init__(self):
        import zstandard

        self.z = zstandard.ZstdCompressor(level=3)
        self.frames, self.sizes, self.open, self.held, self.plain = [], [], [], 0, 0
        self.places: list[tuple[str, int, int, int]] = []

    def add(self, identifier: str, record: bytes) -> None:
        self.places.append((identifier, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        self.plain += len(record)
        if self.held >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        frame = self.z.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.held))
        self.open, self.held = [], 0

    def close(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        if self.open:
            self._frame()
        entries = b"".join(struct.pack("<II", c, p) for c, p in self.sizes)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        table = struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join([*self.frames, table]), self.places


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    sizes = np.frombuffer(data, "<u4", 2 * n, len(data) - 9 - 8 * n).reshape(n, 2).astype(np.int64)
    offsets = np.cumsum(sizes[:, 0]) - sizes[:, 0]
    return [(int(o), int(c), int(p)) for o, (c, p) in zip(offsets, sizes)]


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    at, size, plain = frame
    return zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=plain)


def read_at(data: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: only its frame is decompressed."""
    plain = read_frame(data, seek_table(data)[frame])
    return parse_record(plain[offset : offset + length])[:2]


BUNDLES = "bundle string, data binary, records array<struct<record: string, frame: int, offset: long, length: long>>"
_BUNDLE_PA = pa.schema([
    ("bundle", pa.string()), ("data", pa.binary()),
    ("records", pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
])


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """pages plus payload_bytes, payload_digest and refers_to (null for responses).

    Of pages with equal payloads of at least ``least_bytes``, the smallest
    page_id (null last) is the response; of repeated rows with that page_id
    all are. Only digests that occur twice are joined back, on digest; the
    payload itself never is a key.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(
        F.col("page_id"), F.col("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")
    )
    long = p.filter(F.col("payload_bytes") >= least_bytes)
    firsts = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    out = join_on(p, firsts, ["payload_digest"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write_bundles(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """The bundle table over ``pages`` (page_id, url, html), written to the shared folder."""

    def bundles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()

        def row() -> pa.RecordBatch:
            data, places = writer.close()
            name = f"{hashlib.sha256(data).hexdigest()[:24]}.warc.zst"
            recs = [dict(zip(("record", "frame", "offset", "length"), p)) for p in places]
            return pa.RecordBatch.from_pydict({"bundle": [name], "data": [data], "records": [recs]}, schema=_BUNDLE_PA)

        for batch in batches(rows, "payload"):
            for page, url, payload, size, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"))):
                page, body = page.as_py(), payload.as_py() or b""
                writer.add(record_id(page), make_record(page, url.as_py(), digest.as_py(), size.as_py(), body, first.as_py()))
                if writer.plain >= BUNDLE_BYTES:
                    yield row()
                    writer = BundleWriter()
        if writer.places:
            yield row()

    marked = with_revisits(pages, least_bytes)
    empty = F.lit(None).cast("binary")  # revisits carry no payload
    marked = marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(empty))
    rows = marked.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    return stage(rows.mapInArrow(bundles, BUNDLES), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame, from their bytes alone."""

    def records(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in rows:
            for cell in batch.column("data"):
                data = cell.as_py()
                for frame in seek_table(data):
                    plain, at, cols = read_frame(data, frame), 0, [[] for _ in names]
                    while at < len(plain):
                        head, payload, at = parse_record(plain, at)
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(head["X-Payload-Length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                        first = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                        for col, v in zip(cols, (page_of(head["WARC-Record-ID"]), size, digest, kind, first)):
                            col.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return bundles.select("data").mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def record_map(bundles: DataFrame) -> DataFrame:
    """(record, bundle, frame, offset, length): where each record stands."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record", "bundle", "r.frame", "r.offset", "r.length")


def archive(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write ``pages`` as bundles, read them back: one row per row of ``pages``.

    Null html is an empty payload, null url has no target header, null
    page_id is a record of its own; repeated rows are repeated records; extra
    columns are ignored; no rows give no bundles and no rows.
    """
    return read_bundles(write_bundles(pages, least_bytes))
