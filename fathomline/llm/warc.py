"""WARC records in ZIP-packaged archives, and a reader that never extracts.

Writing: each partition packs its records into ZIP archives of a bounded size.
Every archive has two *stored* (uncompressed) members, ``data.warc.gz`` with
one gzip member a record, and ``index.cdx`` with a line a record: its offset
and length in the data member, and its page_id.  Archives are written under a
name of their own attempt, so a lost or repeated task leaves no half archive in
the result: only archives that the written manifest names are read.

Reading: the end-of-directory record (ZIP64 where its fields say so) leads to
the central directory, whose entries and local headers give the place of each
stored member.  The index is range-read, then each record by its own range.

Payload digests are SHA-256.  Of pages with equal payloads of at least 100
bytes, the smallest page_id is the response and the others revisit it.

Edge cases: a null html has an empty payload; a null page_id is written as a
record without an id, is a response only if no equal payload has an id, and
reads back as null; repeated rows give a record each, the first as written
being no different from the others (one page_id may then hold a response and
refer to itself); extra columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, shared_dir, short_batches

#: Payloads below it are always stored.
DEDUPE_BYTES = 100
#: Bytes of compressed records in one archive, about.
ARCHIVE_BYTES = 32 << 20
#: Rows of repeated digests that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
DATA, INDEX = "data.warc.gz", "index.cdx"
_DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

# Fixed values of the ZIP format: signatures and layouts.
_LOCAL, _CENTRAL, _END = 0x04034B50, 0x02014B50, 0x06054B50
_END64, _LOCATE64 = 0x06064B50, 0x07064B50
_LOCAL_LAYOUT, _CENTRAL_LAYOUT = "<IHHHHHIIIHH", "<IHHHHHHIIIHHHHHII"
_END_LAYOUT, _END64_LAYOUT, _LOCATE64_LAYOUT = "<IHHHHIIH", "<IQHHIIQQQQ", "<IIQI"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_DOS_DATE = 33  # 1980-01-01


# -- ZIP ---------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    start: int  # of the stored bytes
    size: int
    crc: int


class ZipWriter:
    """Stored members one after the other; ``zip64`` forces the long forms."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        size, crc = sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        offset, raw = self.at, name.encode()
        long = self.zip64 or size >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if long else b""
        shown = _MAX32 if long else size
        self._put(struct.pack(_LOCAL_LAYOUT, _LOCAL, 45 if long else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for part in parts:
            self._put(part)
        self.entries.append((raw, crc, size, offset))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            long = self.zip64 or size >= _MAX32 or offset >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if long else b""
            shown, place = (_MAX32, _MAX32) if long else (size, offset)
            self._put(struct.pack(_CENTRAL_LAYOUT, _CENTRAL, 45, 45 if long else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        size, n, end64 = self.at - start, len(self.entries), self.at
        long = self.zip64 or start >= _MAX32 or n >= _MAX16
        if long:
            self._put(struct.pack(_END64_LAYOUT, _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack(_LOCATE64_LAYOUT, _LOCATE64, 0, end64, 1))
        shown = (_MAX16, _MAX32, _MAX32) if long else (n, size, start)
        self._put(struct.pack(_END_LAYOUT, _END, 0, 0, shown[0], *shown, 0))


def _range(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"archive ends before byte {start + size}")
    return data


def members(file, length: int) -> dict[str, Member]:
    """The stored members of an archive, from its central directory."""
    fixed = struct.calcsize(_END_LAYOUT)
    for reach in (fixed, fixed + _MAX16):  # without and with a comment
        tail = _range(file, at := max(0, length - reach), length - at)
        found = tail.rfind(struct.pack("<I", _END))
        while found >= 0 and (len(tail) - found < fixed or struct.unpack_from("<H", tail, found + 20)[0] != len(tail) - found - fixed):
            found = tail.rfind(struct.pack("<I", _END), 0, found)
        if found >= 0:
            break
    else:
        raise ValueError("no end-of-directory record")
    _, _, _, _, n, size, start, _ = struct.unpack_from(_END_LAYOUT, tail, found)
    if n == _MAX16 or size == _MAX32 or start == _MAX32:
        place = at + found - struct.calcsize(_LOCATE64_LAYOUT)
        mark, _, end64, _ = struct.unpack(_LOCATE64_LAYOUT, _range(file, place, struct.calcsize(_LOCATE64_LAYOUT)))
        if mark != _LOCATE64:
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, n, size, start = struct.unpack(_END64_LAYOUT, _range(file, end64, struct.calcsize(_END64_LAYOUT)))
        if mark != _END64:
            raise ValueError("no ZIP64 end record")
    directory, out, p = _range(file, start, size), {}, 0
    for _ in range(n):
        mark, _, _, _, method, _, _, crc, packed, full, n_name, n_extra, n_note, _, _, _, offset = struct.unpack_from(_CENTRAL_LAYOUT, directory, p)
        if mark != _CENTRAL:
            raise ValueError("broken central directory")
        p += struct.calcsize(_CENTRAL_LAYOUT)
        name = directory[p : p + n_name].decode()
        extra = directory[p + n_name : p + n_name + n_extra]
        p += n_name + n_extra + n_note
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # holds only the fields that are at their limits, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = next(wide) if full == _MAX32 else full
                packed = next(wide) if packed == _MAX32 else packed
                offset = next(wide) if offset == _MAX32 else offset
            extra = extra[4 + width :]
        if method != 0:
            continue  # only stored members can be read by range
        local = struct.unpack(_LOCAL_LAYOUT, _range(file, offset, struct.calcsize(_LOCAL_LAYOUT)))
        if local[0] != _LOCAL:
            raise ValueError(f"no local header for {name}")
        out[name] = Member(name, offset + struct.calcsize(_LOCAL_LAYOUT) + local[9] + local[10], packed, crc)
    return out


# -- WARC --------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Record(NamedTuple):
    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def _page(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def parse(packed: bytes) -> Record:
    """A record read back; the payload of a response is checked against its digest."""
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return Record(_page(fields["WARC-Record-ID"]), size, digest, kind, _page(fields.get("WARC-Refers-To")))


def _store(folder: str, records: list[bytes], ids: list[int | None], zip64: bool) -> str:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.zip"
    lines, at = [], 0
    for page_id, own in zip(ids, records, strict=True):
        lines.append(f"{at} {len(own)} {'-' if page_id is None else page_id}\n")
        at += len(own)
    with fs.open_output_stream(posixpath.join(root, name)) as out:
        archive = ZipWriter(out, zip64)
        archive.add(DATA, records)
        archive.add(INDEX, ["".join(lines).encode()])
        archive.close()
    return f"{folder}/{name}"


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int, zip64: bool) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    ids: list[int | None] = []
    size = 0

    def named() -> pa.RecordBatch:
        path = _store(folder, records, ids, zip64)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(records)], pa.int64())], ["archive", "records"])

    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]
        for page_id, url, html, digest, refers_to, revisit in zip(*columns, strict=True):
            own = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers_to.as_py(), revisit.as_py())
            records.append(own)
            ids.append(page_id.as_py())
            size += len(own)
            if size >= archive_bytes:
                yield named()
                records, ids, size = [], [], 0
    if records:
        yield named()


def _folder(uri: str) -> str:
    return uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write every row of ``pages`` and return the manifest (archive, records)."""
    spark = pages.sparkSession
    short_batches(spark)
    folder = _folder(folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}").rstrip("/")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n"))
    again = rows.where(F.col("n") >= DEDUPE_BYTES).groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("refers_to")).where("copies > 1")
    again = materialize(again.select("digest", "refers_to"), "repeated")
    few = again.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(again) if few else again, "digest", "left")
    rows = rows.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False)) & F.col("refers_to").isNotNull())
    rows = rows.withColumn("refers_to", F.when(F.col("revisit"), F.col("refers_to")))
    rows = rows.select("page_id", "url", "html", "digest", "refers_to", "revisit")
    return materialize(rows.mapInArrow(lambda it: _write_batches(it, folder, archive_bytes, zip64), "archive string, records long"), "manifest")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            fs, path = pa.fs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as file:
                found = members(file, file.size())
                data, index = found[DATA], found[INDEX]
                listing = _range(file, index.start, index.size)
                if zlib.crc32(listing) != index.crc:
                    raise ValueError(f"broken index in {uri}")
                lines = [line.split() for line in listing.decode().splitlines()]
                rows = [parse(_range(file, data.start + int(at), int(size))) for at, size, _ in lines]
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(Record._fields))


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a manifest names."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(min(n, 4096), "archive").mapInArrow(_read_batches, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back."""
    return read(write(pages))
