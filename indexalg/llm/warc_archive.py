"""WARC records in ZIP-packaged archives.

An archive is a ZIP file whose members are stored, not compressed: WARC files
of single-record gzip members under archive/, and under indexes/ one line per
record: key, offset, length. A reader finds the central directory (ZIP64 where
needed), locates the members' data and reads records by range; nothing is
extracted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import NewFile, RangeReader
from .shared import cut, fresh_folder
from .tidy import tidy

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Neighbouring records are read together, up to so many bytes.
READ_BYTES = 4 << 20
#: Digests of repeated payloads up to so many (under 100 bytes each) are broadcast; more are joined by sort and merge.
BROADCAST_DIGESTS = 200_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FULL = 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member: a response, or without the payload a revisit."""
    body = b"" if revisit else _HTTP + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_uri(page_id)), ("WARC-Date", "2000-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", page_uri(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(raw.encode() + body + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    fields: dict[str, str]
    payload: bytes

    def page(self, field: str = "warc-record-id") -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", self.fields.get(field, ""))
        return int(found[1]) if found else None


def parse_record(data: bytes) -> Record:
    raw = zlib.decompress(data, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = body[: int(fields["content-length"])]
    return Record(fields, block.partition(b"\r\n\r\n")[2])


class ZipWriter:
    """Stored members to a stream that can only be appended to."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.members = out, zip64, []
        self.open: list | None = None

    def begin(self, name: str) -> None:
        raw = name.encode()
        at = self.out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        self.open = [raw, at, 0, 0]

    def write(self, data: bytes) -> int:
        """Appends to the open member; returns the place within it."""
        at = self.open[3]
        self.out.write(data)
        self.open[2], self.open[3] = zlib.crc32(data, self.open[2]), at + len(data)
        return at

    def end(self) -> None:
        name, at, crc, size = self.open
        self.out.write(struct.pack("<IIQQ", 0x08074B50, crc, size, size) if size >= _FULL else struct.pack("<IIII", 0x08074B50, crc, size, size))
        self.members.append((name, at, crc, size))

    def close(self) -> None:
        start = self.out.at
        for name, at, crc, size in self.members:
            wide = self.zip64 or size >= _FULL or at >= _FULL
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            self.out.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x808, 0, 0, 0x21, crc, _FULL if wide else size, _FULL if wide else size, len(name), len(extra), 0, 0, 0, 0, _FULL if wide else at) + name + extra)
        end, n = self.out.at, len(self.members)
        wide = self.zip64 or end >= _FULL or n >= 0xFFFF
        if wide:
            self.out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, end - start, start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self.out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF if wide else n, 0xFFFF if wide else n, _FULL if wide else end - start, _FULL if wide else start, 0))


class ZipReader:
    """Members of an archive and where their stored data lie."""

    def __init__(self, source):
        self.source = source
        n = min(source.size, 22 + 0xFFFF)
        tail = source.read(source.size - n, n)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, count, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
        locator = source.size - n + at - 20
        if (count == 0xFFFF or _FULL in (size, start)) and locator >= 0:
            mark, _, where, _ = struct.unpack("<IIQI", source.read(locator, 20))
            if mark != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            count, _, size, start = struct.unpack_from("<QQQQ", source.read(where, 56), 24)
        self.members: dict[str, tuple[int, int, int]] = {}
        data, at = source.read(start, size), 0
        for _ in range(count):
            f = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if f[0] != 0x02014B50:
                raise ValueError("damaged central directory")
            method, packed, full, header = f[4], f[8], f[9], f[16]
            name = data[at + 46 : at + 46 + f[10]].decode()
            extra, k = data[at + 46 + f[10] : at + 46 + f[10] + f[11]], 0
            while k + 4 <= len(extra):
                tag, m = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # only the fields that are full elsewhere, in this order
                    wide = list(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                    full = wide.pop(0) if full == _FULL else full
                    packed = wide.pop(0) if packed == _FULL else packed
                    header = wide.pop(0) if header == _FULL else header
                k += 4 + m
            self.members[name] = (method, header, packed)
            at += 46 + f[10] + f[11] + f[12]

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begin, and their length."""
        method, header, size = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.source.read(header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        names, extra = struct.unpack_from("<HH", head, 26)
        return header + 30 + names + extra, size


def records(source) -> Iterator[Record]:
    """All records of an archive, by its indexes, in stored order."""
    archive = ZipReader(source)
    for name in archive.members:
        if not name.startswith("archive/"):
            continue
        start, size = archive.place(name)
        index, n = archive.place(f"indexes/{name.removeprefix('archive/')}.cdx")
        lines = [(int(o), int(m)) for _, o, m in (x.split() for x in source.read(index, n).decode().splitlines())]
        k = 0
        while k < len(lines):
            j = k + 1
            while j < len(lines) and lines[j][0] == sum(lines[j - 1]) and sum(lines[j]) - lines[k][0] <= READ_BYTES:
                j += 1
            if sum(lines[j - 1]) > size:
                raise ValueError("index beyond its member")
            data = source.read(start + lines[k][0], sum(lines[j - 1]) - lines[k][0])
            for at, m in lines[k:j]:
                yield parse_record(data[at - lines[k][0] : at - lines[k][0] + m])
            k = j


class _Archive:
    def __init__(self, folder: str):
        self.out = NewFile(folder, ".zip")
        self.zip, self.index = ZipWriter(self.out), []
        self.zip.begin("archive/data.warc.gz")

    def add(self, page_id: int | None, record: bytes) -> None:
        at = self.zip.write(record)
        self.index.append(f"{'-' if page_id is None else page_id} {at} {len(record)}\n")

    def close(self) -> str:
        self.zip.end()
        self.zip.begin("indexes/data.warc.gz.cdx")
        self.zip.write("".join(self.index).encode())
        self.zip.end()
        self.zip.close()
        return self.out.close()


@tidy
def _packed(rows: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    archive, done = None, []
    for batch in rows:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for page_id, url, html, revisit, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                archive = archive or _Archive(folder)
                archive.add(page_id, warc_record(page_id, url, (html or "").encode(), first, revisit))
                if archive.out.at >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
    if archive:
        done.append(archive.close())
    yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """(paths, folder) of archives with a record per page.

    Of pages with equal payloads (null html: empty) that with the smallest
    page_id is a response, the others revisit it. Rows that repeat the smallest
    page_id are all responses; a null page_id comes after all others.
    """
    folder = fresh_folder(pages.sparkSession, "archives")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    mark = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    first = cut(rows.select("page_id", mark.alias("mark")).groupBy("mark").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    both = rows.withColumn("mark", mark).join(first, "mark", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.lit(False))
    paths = cut(both.select("page_id", "url", "html", revisit.alias("revisit"), "first").mapInArrow(lambda batches: _packed(batches, folder), "path string"))
    return paths, folder


@tidy
def _listed(rows: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in rows:
        for path in batch.column(0).to_pylist():
            source, out = RangeReader(folder, path), []
            for r in records(source):
                kind, own = r.fields["warc-type"], r.fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(r.payload) != own:
                    raise ValueError(f"damaged record of page {r.page()}")
                out.append((r.page(), len(r.payload) if kind == "response" else int(r.fields["x-payload-length"]), own, kind, r.page("warc-refers-to")))
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], _COLUMNS)
                    out = []
            source.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], _COLUMNS)


_COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response are those of the bytes read, and checked
    against its header; a revisit has them from its header.
    """
    n = max(1, paths.count())
    return paths.repartition(n).mapInArrow(lambda batches: _listed(batches, folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, **columns: str) -> DataFrame:
    """write_archives() and read_archives(); no rows for an empty table."""
    return read_archives(*write_archives(pages, **columns))
