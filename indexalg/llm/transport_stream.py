"""Payloads in MPEG transport streams (ISO/IEC 13818-1).

mux() packs a payload as one private elementary stream: access units in PES
packets with timestamps, every few of them a random-access point led by the
program tables and a clock reference. demux() parses program association and
map tables, checks continuity counters, reassembles the elementary packets and
returns payload, timestamps and random-access points. A packet sent twice in a
row counts once. Where packets are missing, the open elementary packet is given
up, its place in the payload is reported, and reading goes on at the next one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tidy import tidy

PACKET = 188
PMT_PID, ES_PID = 0x1000, 0x100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of payload in an access unit, ticks of the 90 kHz clock between them, units from one random-access point to the next.
UNIT_BYTES, TICKS, UNITS_PER_POINT = 16_384, 3_600, 4
#: Payloads end at a multiple of so many bytes.
ALIGN = 64


@lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(pid: int, body: bytes) -> np.ndarray:
    body += crc32_mpeg(body).to_bytes(4, "big")
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + body
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _section(0, bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
_PMT = _section(PMT_PID, bytes([0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))


def _stamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream of a non-empty payload."""
    out, counter = [], 0
    for unit in range(-(-len(payload) // UNIT_BYTES)):
        data = payload[unit * UNIT_BYTES : (unit + 1) * UNIT_BYTES]
        time = unit * TICKS % 2**33
        pes = np.frombuffer(b"\0\0\1" + bytes([STREAM_ID]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(time) + data, np.uint8)
        point = unit % UNITS_PER_POINT == 0
        lead = 8 if point else 0  # adaptation field with the clock
        if point:
            tables = np.stack((_PAT, _PMT))
            tables[:, 3] |= unit // UNITS_PER_POINT & 15
            out.append(tables)
        n = -(-(len(pes) + lead) // 184)
        packets = np.zeros((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        field = np.zeros(n, np.int64)  # bytes of adaptation field
        field[0] = lead
        field[-1] += 184 * n - len(pes) - lead
        body = packets[:, 4:]
        if n > 2 or (n == 2 and not lead):
            body[1:-1] = pes[184 - field[0] : 184 - field[0] + 184 * (n - 2)].reshape(-1, 184)
        body[0, field[0] :] = pes[: 184 - field[0]]
        if n > 1:
            body[-1, field[-1] :] = pes[len(pes) - (184 - field[-1]) :]
        for k in {0, n - 1}:
            if field[k]:
                packets[k, 3] |= 0x20
                body[k, 0] = field[k] - 1
                if field[k] > 1:
                    body[k, 1] = 0
                    body[k, 2 : field[k]] = 0xFF
        if point:
            body[0, 1] = 0x50
            clock = time << 15 | 0x7E00
            body[0, 2:8] = np.frombuffer(clock.to_bytes(6, "big"), np.uint8)
        out.append(packets)
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    payload: bytes
    program: int
    stream_type: int
    times: list[int]
    points: list[int]
    discontinuities: int
    #: where in the payload an elementary packet is missing
    damaged: list[int]


def _table(packets: np.ndarray, pid: int, ids: np.ndarray, table: int) -> bytes:
    """The first section of a table, checked."""
    own = packets[(ids == pid) & (packets[:, 1] & 0x40 > 0)]
    if not len(own):
        raise ValueError(f"no table on packet id {pid}")
    raw = own[0].tobytes()
    at = 5 + raw[4] + (1 + raw[4] if raw[3] & 0x20 else 0)
    size = 3 + ((raw[at + 1] & 0x0F) << 8 | raw[at + 2])
    section = raw[at : at + size]
    if section[0] != table or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError(f"damaged table on packet id {pid}")
    return section


def demux(stream: bytes) -> Stream:
    packets = np.frombuffer(stream, np.uint8)
    if len(packets) % PACKET or not len(packets):
        raise ValueError("not whole packets")
    packets = packets.reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    ids = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    pat = _table(packets, 0, ids, 0)
    programs = [(int.from_bytes(pat[k : k + 2], "big"), int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF) for k in range(8, len(pat) - 4, 4)]
    program, map_pid = next(x for x in programs if x[0])
    pmt = _table(packets, map_pid, ids, 2)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
    stream_type, es = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    lost = 0
    for pid in (0, map_pid):
        lost += int(_breaks(_once(packets[(ids == pid) & (packets[:, 3] & 0x10 > 0)])).sum())
    own = _once(packets[(ids == es) & (packets[:, 3] & 0x10 > 0)])
    gap = _breaks(own)
    lost += int(gap.sum())
    adapted = own[:, 3] & 0x20 > 0
    skip = np.minimum(np.where(adapted, 5 + own[:, 4].astype(np.int64), 4), PACKET)
    random = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    begins = np.flatnonzero(own[:, 1] & 0x40 > 0)
    data = own[np.arange(PACKET) >= skip[:, None]].tobytes()
    where = np.concatenate(([0], np.cumsum(PACKET - skip)))
    until = np.concatenate((begins[1:], [len(own)])).astype(np.int64)
    gaps = np.flatnonzero(gap)
    parts, times, points, damaged, place = [], [], [], [0] if not len(begins) or begins[0] else [], 0

    def miss() -> None:
        if damaged[-1:] != [place]:
            damaged.append(place)

    for k, to in zip(begins.tolist(), until.tolist(), strict=True):
        if gap[k]:  # what came before may have ended early, or not have come at all
            miss()
        # up to the first gap; what follows it up to the next beginning is of a packet whose own beginning is missing
        inside = gaps[np.searchsorted(gaps, k, side="right") : np.searchsorted(gaps, to)]
        at, end = int(where[k]), int(where[inside[0] if len(inside) else to])
        size, head = int.from_bytes(data[at + 4 : at + 6], "big"), data[at + 8] if end > at + 8 else 0
        if data[at : at + 3] != b"\0\0\1" or end - at != 6 + size or size < 3 + head:
            miss()
            continue
        if data[at + 7] & 0x80:
            p = data[at + 9 : at + 14]
            time = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
            times.append(time)
            if random[k]:
                points.append(time)
        parts.append(data[at + 9 + head : at + 6 + size])
        place += len(parts[-1])
        if len(inside):
            miss()
    return Stream(b"".join(parts), program, stream_type, times, points, lost, damaged)


def _once(packets: np.ndarray) -> np.ndarray:
    """Packets of one id without those that repeat the one before; only a clock reference may differ."""
    counter = packets[:, 3] & 15
    again = np.flatnonzero(counter[1:] == counter[:-1]) + 1
    drop = []
    for k in again.tolist():
        x, y = packets[k - 1].copy(), packets[k].copy()
        for z in (x, y):
            if z[3] & 0x20 and z[4] >= 7 and z[5] & 0x10:
                z[6:12] = 0
        if (x == y).all():
            drop.append(k)
    return np.delete(packets, drop, axis=0) if drop else packets


def _breaks(packets: np.ndarray) -> np.ndarray:
    """Whether packets are missing before each one, by its counter."""
    counter = packets[:, 3] & 15
    out = np.zeros(len(packets), bool)
    out[1:] = (counter[1:] - counter[:-1]) & 15 != 1
    return out


@tidy
def _muxed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            size, media = [], []
            for t in part.column(1):
                raw = b"" if t.as_py() is None else t.as_buffer().to_pybytes()
                size.append(len(raw))
                media.append(mux(raw.ljust(max(1, -(-len(raw) // ALIGN)) * ALIGN, b"\0")))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text, padded with bytes 0 to a positive multiple of 64, as a transport stream; null text: empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_muxed, "doc_id long, n_bytes long, media binary")


@tidy
def _featured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for blob in batch.column(2):
            raw = blob.as_buffer().to_pybytes()
            s = demux(raw)
            feature = f"program={s.program};type={s.stream_type};units={len(s.times)};pts={min(s.times, default=0)}-{max(s.times, default=0)};points={len(s.points)};lost={s.discontinuities};packets={len(raw) // PACKET}"
            out.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, s.times, s.points, s.damaged))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_bytes", *_FEATURES])


_FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "random_access", "damaged"]


def media_features(media: DataFrame) -> DataFrame:
    """Features of media_column()'s rows, from the stored bytes alone.

    payload_* are of the payload read back, tail_crc32 of its last 64 bytes,
    media_* of the stream; times and random_access are the timestamps of all
    access units and of those where decoding may begin; lost in `feature`
    counts breaks of continuity. damaged lists the places in the payload where
    access units are missing; it is empty for an intact stream. A stream that is
    not whole packets in step, or has no readable tables, raises ValueError.
    """
    return media.mapInArrow(_featured, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, random_access array<long>, damaged array<long>")
