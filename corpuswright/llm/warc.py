"""WARC records in seekable Zstandard bundles: written, indexed, and read back."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, columns_of, salt_of, salted, text_of

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Plain bytes of a frame and of a bundle, about; a longer record has a frame or bundle to itself.
FRAME, BUNDLE = 256 << 10, 8 << 20
LEVEL = 6
# Fixed values of the Zstandard seekable format: the skippable frame's magic number, and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle string, records int, archive binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """The identifier of a page's record."""
    return f"urn:page:{'' if page_id is None else page_id}"


def _escaped(value: str) -> str:
    """A header value with control characters and per cent signs escaped."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _plain(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has no payload, but its size and digest in the header."""
    kept = b"" if revisit else payload
    broken = url is not None and (any(c < " " or c == "\x7f" for c in url))  # else the line would end
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),  # the tables have no time of capture
        ("WARC-Target-URI", None if url is None else _escaped(url) if broken else url),
        ("WARC-Target-URI-Escaped", "1" if broken else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{record_id(refers_to)}>" if revisit else None),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(kept))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    return head.encode() + kept + b"\r\n\r\n"


class Bundle:
    """Records in independent Zstandard frames; `close` appends the seek table."""

    def __init__(self, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.limit, self.frames, self.table, self.held, self.size = frame, [], [], [], 0
        self.index: list[dict] = []
        self.plain = 0

    def add(self, name: str, body: bytes) -> None:
        if self.held and self.size + len(body) > self.limit:
            self._frame()
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.size, "length": len(body)})
        self.held.append(body)
        self.size += len(body)
        self.plain += len(body)

    def _frame(self) -> None:
        packed = self.pack(b"".join(self.held))
        self.frames.append(packed)
        self.table.append(struct.pack("<II", len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> bytes:
        if self.held:
            self._frame()
        footer = b"".join(self.table) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(footer)) + footer


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Place, packed and plain size of each frame, from the archive's end."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8  # an optional checksum for each frame
    begin = len(archive) - 9 - n * width
    if begin < 8 or struct.unpack("<II", archive[begin - 8 : begin]) != (SKIPPABLE, n * width + 9):
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", archive, begin + i * width)
        out.append((at, packed, plain))
        at += packed
    if at != begin - 8:
        raise ValueError("the seek table doesn't fit the frames")
    return out


def frame(archive: bytes, which: tuple[int, int, int]) -> bytes:
    """One frame's plain bytes, without reading any other."""
    import zstandard

    at, packed, plain = which
    return zstandard.ZstdDecompressor().decompress(archive[at : at + packed], max_output_size=plain)


def fetch(archive: bytes, entry: dict) -> bytes:
    """The record that an index entry names."""
    return frame(archive, seek_table(archive)[entry["frame"]])[entry["offset"] : entry["offset"] + entry["length"]]


def parse(body: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and content of the record at a place, and the place after it."""
    stop = body.index(b"\r\n\r\n", at)
    first, *lines = body[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    if body[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} doesn't end where it says")
    return headers, body[begin:end], end + 4


def _number(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def bundles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Bundles of one record per row of pages (page_id, url, html): bundle, records, archive, index.

    The payload is the html in UTF-8, null as empty. Of equal payloads of `least` bytes or more the one with the
    largest page_id is the response, and the others revisit it; smaller ones are all responses. Payloads are equal if
    their SHA-1, SHA-256 and size are. Groups of equal payloads are looked up over salts, so a payload that a third of
    all pages share spreads over tasks; its bytes move once, with its row. A null page_id is less than any other; rows
    that repeat the largest page_id are responses each.

    Each task writes bundles of about BUNDLE plain bytes, named by their content, so a repeated task names them alike.
    """
    rows = columns_of(pages, ["page_id", "url", "html"], "WARC").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    body = F.encode("html", "UTF-8")
    keyed = rows.withColumns({"_d": F.unhex(F.sha1(body)), "_e": F.unhex(F.sha2(body, 256)), "_z": F.octet_length("html"), "_salt": salt_of(F.col("page_id"), n=SALTS)})
    groups = keyed.where(F.col("_z") >= least).groupBy("_d", "_e", "_z").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    found = keyed.join(salted(groups), ["_d", "_e", "_z", "_salt"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    ready = found.select("page_id", "url", "html", F.lower(F.hex("_d")).alias("digest"), F.when(revisit, F.col("_first")).alias("first"), revisit.alias("revisit"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("bundle", pa.string()), ("records", pa.int32()), ("archive", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])

        def closed(b: Bundle) -> pa.RecordBatch:
            archive = b.close()
            return pa.RecordBatch.from_pylist([{"bundle": hashlib.sha1(archive).hexdigest(), "records": len(b.index), "archive": archive, "index": b.index}], schema)

        held = Bundle()
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, html, digest, first, again = (x.as_py() for x in row)
                held.add(record_id(page_id), record(page_id, url, html.encode(), digest, first, again))
                if held.plain >= BUNDLE:
                    yield closed(held)
                    held = Bundle()
        if held.index:
            yield closed(held)

    return ready.mapInArrow(write, BUNDLES)


def records(archives: DataFrame) -> DataFrame:
    """One row per record of archives (archive): page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    Frames are opened one by one by the seek table. A response's size and digest are computed from its payload and must
    be what its header says; a revisit's are those of the payload it refers to, from its header, and its html is null.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.binary())])
        for batch in batches:
            for held in batch.column(0):
                archive = held.as_py()
                for which in seek_table(archive):
                    body, at, out = frame(archive, which), 0, []
                    while at < len(body):
                        headers, content, at = parse(body, at)
                        revisit = headers["WARC-Type"] == "revisit"
                        said = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(headers["WARC-Payload-Length"])
                        if not revisit and (len(content) != size or hashlib.sha1(content).hexdigest() != said):
                            raise ValueError(f"{headers['WARC-Record-ID']}: the payload isn't what was written")
                        url = headers.get("WARC-Target-URI")
                        out.append((_number(headers["WARC-Record-ID"]), None if url is None else _plain(url) if "WARC-Target-URI-Escaped" in headers else url, size, said, headers["WARC-Type"], _number(headers["WARC-Refers-To"]) if revisit else None, None if revisit else content))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], types.names)

    return archives.select("archive").mapInArrow(read, RECORDS)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as <bundle>.warc.zst under a folder that every executor mounts; bundle, path and bytes of each.

    A file is written under another name and then renamed, so a repeated task leaves it whole.
    """

    def write(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pyarrow as pa

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(body)
                os.replace(part, path)
                yield pa.RecordBatch.from_pylist([{"bundle": name, "path": path, "bytes": len(body)}])

    return archives.select("bundle", "archive").mapInArrow(write, "bundle string, path string, bytes long")
