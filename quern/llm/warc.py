"""Web archives in seekable zstandard bundles (operator 4).

Records are grouped into independent zstandard frames. A bundle is the frames, a skippable frame with the index (record
identifier, frame, offset inside the frame's content) and, last, the seek table of the zstandard seekable
format, so one record is read by decompressing one frame. Ordinary zstandard tools read a bundle as one plain WARC file.
Bundles are cells of a table in the shared folder, written by Spark's commit protocol.

Of records with equal payloads of at least MIN_SHARED bytes, that with the largest page_id is the response and the others
are revisits that refer to it. The group is found by digest, aggregated before the shuffle. Where
few payloads occur twice (a counted bound), their digests are broadcast and payloads stay where they are; beyond, long payloads meet
their group's row in a join that Spark can split where one payload is very frequent, and short ones stay.

Defined cases. Null html is an empty payload. A null url gives no target header. A null page_id is never the largest beside
others, and is the response among nulls only. Repeated rows of the largest page_id are all responses. Control
characters and spaces in a url are percent-encoded. An empty table gives no bundle. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, bounded_batches, lean, stored

MIN_SHARED = 1000
#: Bytes of records after which a frame is closed, and of frames after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
#: Fixed values of the zstandard frame formats.
_INDEX_MAGIC, _SEEK_MAGIC, _SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe=_SAFE)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record at an offset."""
    end = bytes(data[at : at + 65_536]).find(b"\r\n\r\n")
    end = at + end if end >= 0 else bytes(data).index(b"\r\n\r\n", at)
    version, *lines = bytes(data[at:end]).decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no record here")
    fields = dict(x.split(": ", 1) for x in lines)
    block = bytes(data[end + 4 : end + 4 + int(fields["Content-Length"])])
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


class BundleWriter:
    def __init__(self) -> None:
        import zstandard

        self._compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self._clear()

    def _clear(self) -> None:
        self._frames: list[bytes] = []
        self._sizes: list[int] = []
        self._open: list[bytes] = []
        self._open_bytes = self._frame_bytes = 0
        self._index: list[str] = []

    def add(self, identifier: str, raw: bytes) -> None:
        self._index.append(f"{identifier}\t{len(self._frames)}\t{self._open_bytes}")
        self._open.append(raw)
        self._open_bytes += len(raw)
        if self._open_bytes >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        if self._open:
            self._frames.append(self._compress(b"".join(self._open)))
            self._sizes.append(self._open_bytes)
            self._frame_bytes += len(self._frames[-1])
            self._open, self._open_bytes = [], 0

    @property
    def full(self) -> bool:
        return self._frame_bytes >= BUNDLE_BYTES

    def close(self) -> tuple[int, bytes] | None:
        """Number of records and the bundle."""
        self._end_frame()
        if not self._index:
            return None
        index = self._compress("\n".join(self._index).encode())
        index = struct.pack("<II", _INDEX_MAGIC, len(index)) + index
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip([*self._frames, index], [*self._sizes, 0], strict=True))
        footer = struct.pack("<IBI", len(self._frames) + 1, 0, _SEEK_FOOTER)
        seek = struct.pack("<II", _SEEK_MAGIC, len(table) + len(footer)) + table + footer
        out = (len(self._index), b"".join([*self._frames, index, seek]))
        self._clear()
        return out


class BundleReader:
    """Random access to the records of one bundle."""

    def __init__(self, data: bytes):
        import zstandard

        self._decompress = zstandard.ZstdDecompressor().decompress
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != _SEEK_FOOTER:
            raise ValueError("no seek table")
        self._data, self._starts, at = data, [], 0
        for size, _ in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
            self._starts.append(at)
            at += size
        self._starts.append(at)
        index = data[self._starts[-2] + 8 : at]
        self.index = [(i, int(f), int(o)) for i, f, o in (x.split("\t") for x in self._decompress(index).decode().split("\n"))]
        self._held: tuple[int, bytes] = (-1, b"")
        self._places: dict[str, list[tuple[int, int]]] = {}
        for identifier, frame, offset in self.index:
            self._places.setdefault(identifier, []).append((frame, offset))

    def at(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        if self._held[0] != frame:
            self._held = (frame, self._decompress(self._data[self._starts[frame] : self._starts[frame + 1]]))
        return parse_record(memoryview(self._held[1]), offset)

    def find(self, identifier: str) -> list[tuple[dict[str, str], bytes]]:
        return [self.at(f, o) for f, o in self._places.get(identifier, ())]


def write_bundles(pages: DataFrame) -> DataFrame:
    """A table of bundles: n_records, content."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size")
    )
    long = rows.where(F.col("size") >= MIN_SHARED)
    shared = stored(long.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept"), "shared-payloads")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared.withColumnRenamed("digest", "same"))
        rows = rows.join(shared, (F.col("size") >= MIN_SHARED) & (F.col("digest") == F.col("same")), "left")
    else:
        rows = long.join(shared, "digest", "left").unionByName(rows.where(F.col("size") < MIN_SHARED).withColumn("kept", F.lit(None).cast("long")))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()

        def closed() -> Iterator[pa.RecordBatch]:
            if row := writer.close():
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.binary())], ["n_records", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, digest, kept, again = (c[k].as_py() for c in batch.columns)
                writer.add(record_id(page_id), record(page_id, url, html.encode(), digest, kept, again))
                if writer.full:
                    yield from closed()
        yield from closed()

    rows = rows.select("page_id", "url", "html", "digest", "kept", revisit.alias("again"))
    return stored(rows.mapInArrow(lean(write), "n_records long, content binary"), "bundles")


def _page(identifier: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|none)>", identifier)[1]
    return None if found == "none" else int(found)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row per record, found through index and seek table: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response whose payload does not have the digest and length of its header is an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                bundle, out = BundleReader(content.as_py()), []
                for identifier, frame, offset in bundle.index:
                    fields, payload = bundle.at(frame, offset)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
                    if kind == "response":
                        if (found := hashlib.sha1(payload).hexdigest()) != digest or len(payload) != size:
                            raise ValueError(f"{identifier} holds {found}, not {digest}")
                    out.append((_page(identifier), size, digest, kind, _page(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return bundles.select("content").mapInArrow(
        lean(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
