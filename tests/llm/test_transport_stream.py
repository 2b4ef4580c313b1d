"""Transport streams: exact round trips, timestamps, what is damaged is noticed."""

import hashlib
import random
import zlib

import pytest

from indexalg.llm.transport_stream import PACKET, UNIT_BYTES, UNITS_PER_POINT, crc32_mpeg, demux, media_column, media_features, mux


@pytest.mark.parametrize("n", [*range(64, 1300, 64), UNIT_BYTES - 64, UNIT_BYTES, UNIT_BYTES + 64, 9 * UNIT_BYTES + 128, 70 * UNIT_BYTES])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    stream = mux(payload)
    got = demux(stream)
    units = -(-n // UNIT_BYTES)
    assert got.payload == payload and got.discontinuities == 0 and got.damaged == [] and len(stream) % PACKET == 0
    assert (got.program, got.stream_type) == (1, 6) and got.times == [3600 * k for k in range(units)] and got.points == got.times[::UNITS_PER_POINT]
    assert all(stream[k] == 0x47 for k in range(0, len(stream), PACKET))


def test_damage():
    stream = mux(random.Random(1).randbytes(20_000 // 64 * 64))
    lost = stream[: 20 * PACKET] + stream[21 * PACKET :]
    assert demux(lost).discontinuities == 1
    for bad in (stream[:-1], b"", b"\0" + stream[1:], stream[:10] + bytes([stream[10] ^ 1]) + stream[11:]):
        with pytest.raises(ValueError):
            demux(bad)
    assert crc32_mpeg(b"123456789") == 0x0376E6E7


def packets_of(stream):
    return [stream[k : k + PACKET] for k in range(0, len(stream), PACKET)]


def test_lost_and_repeated_packets():
    payload = random.Random(2).randbytes(6 * UNIT_BYTES + 640)
    units = [payload[k : k + UNIT_BYTES] for k in range(0, len(payload), UNIT_BYTES)]
    packets = packets_of(mux(payload))
    ours = [k for k, p in enumerate(packets) if (p[1] & 0x1F) << 8 | p[2] == 0x100]
    unit_of, n = {}, -1
    for k in ours:
        n += packets[k][1] >> 6 & 1
        unit_of[k] = n
    for k in ours:
        twice = demux(b"".join([*packets[: k + 1], packets[k], *packets[k + 1 :]]))
        assert twice.payload == payload and (twice.discontinuities, twice.damaged) == (0, [])
    for k in ours:
        got = demux(b"".join([*packets[:k], *packets[k + 1 :]]))
        kept = [u for i, u in enumerate(units) if i != unit_of[k]]
        assert got.payload == b"".join(kept)
        assert got.damaged == [min(unit_of[k] * UNIT_BYTES, len(got.payload))]
    # a whole unit gone
    got = demux(b"".join(p for k, p in enumerate(packets) if unit_of.get(k) != 2))
    assert got.payload == b"".join(units[:2] + units[3:]) and got.damaged == [2 * UNIT_BYTES]
    # a repeat that is not one
    k = ours[5]
    other = packets[k][:100] + bytes([packets[k][100] ^ 1]) + packets[k][101:]
    assert demux(b"".join([*packets[: k + 1], other, *packets[k + 1 :]])).damaged == [0]


def test_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "é" * 32, "c"), (3, "é" * 32, "c"), (None, "x" * 300_000, "c"), (5, "a" * 65, "c")]
    got = media_features(media_column(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    assert len(got) == len(rows)
    values = {}
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        raw = (text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(mux(padded)).hexdigest() and r.random_access == r.times[::4]
        assert values.setdefault(text or "", tuple(r)[1:]) == tuple(r)[1:]
    assert media_features(media_column(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
