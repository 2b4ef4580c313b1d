"""Archives: readable by others, read back exactly, revisits by brute force."""

import base64
import hashlib
import io
import struct
import zipfile

import pytest

from indexalg.llm import warc_archive as M


class Memory:
    def __init__(self):
        self.data = bytearray()

    at = size = property(lambda self: len(self.data))

    def write(self, data):
        at = len(self.data)
        self.data += data
        return at

    def read(self, at, n):
        return bytes(self.data[at : at + n])


def archive(zip64, n=30):
    out = Memory()
    z, index = M.ZipWriter(out, zip64), []
    z.begin("archive/data.warc.gz")
    for i in range(n):
        record = M.warc_record(i, f"http://host/\r\n {i}" if i % 3 else None, b"payload" * i, i // 2, i % 2 == 1)
        index.append(f"{i} {z.write(record)} {len(record)}\n")
    z.end()
    z.begin("indexes/data.warc.gz.cdx")
    z.write("".join(index).encode())
    z.end()
    z.close()
    return out


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("window", [1, 500, 1 << 20])
def test_archive(zip64, window, monkeypatch):
    monkeypatch.setattr(M, "READ_BYTES", window)
    out = archive(zip64)
    other = zipfile.ZipFile(io.BytesIO(bytes(out.data)))
    assert other.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in other.infolist())
    got = list(M.records(out))
    assert [r.page() for r in got] == list(range(30))
    for i, r in enumerate(got):
        assert r.payload == (b"" if i % 2 else b"payload" * i) and r.page("warc-refers-to") == (i // 2 if i % 2 else None)
        assert r.fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"payload" * i).digest()).decode()
        assert r.fields.get("warc-target-uri") == (f"http://host/%0D%0A%20{i}" if i % 3 else None)


def test_members_elsewhere_and_damage():
    out = Memory()
    out.write(bytes(archive(True).data) + b"")
    out.data[-2:] = struct.pack("<H", 3)  # a comment
    out.write(b"abc")
    assert len(list(M.records(out))) == 30
    with pytest.raises(ValueError):
        M.ZipReader(Memory())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x", b"y" * 100)
    out = Memory()
    out.write(packed.getvalue())
    with pytest.raises(ValueError, match="not stored"):
        M.ZipReader(out).place("archive/x")


def test_pages_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "ARCHIVE_BYTES", 4000)
    rows = [(i, f"u{i}", ["one", "two", None, "", f"own {i}", "big " * 30_000][i % 6], "clash") for i in range(60)] + [(None, None, "one", "c"), (0, "again", "one", "c"), (70, "u", "only", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string")
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        own = first[html or ""] == i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, M.archived(pages).collect()), key=key) == sorted(want, key=key)
    monkeypatch.setattr(M, "BROADCAST_DIGESTS", 0)
    assert sorted(map(tuple, M.archived(pages).collect()), key=key) == sorted(want, key=key)
    assert M.archived(pages.limit(0)).count() == 0
