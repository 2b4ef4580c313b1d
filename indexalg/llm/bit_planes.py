"""Token-id files of bit or byte planes.

Ids are cut into blocks of a fixed number of ids. A block is transposed: byte
planes hold the k-th bytes of all its ids together, bit planes their k-th bits.
Each plane is compressed by zstandard on its own; a plane of zeros takes no
room. The index at the file's end has, per block, its number of ids and each
plane's place, and the documents' keys and lengths, so any block is read by
its own ranges.

File: magic, planes of block 0, planes of block 1, ..., index (zstandard), its
length as 8 bytes, magic. The index is six little-endian 64-bit integers
(version, ids per block, planes per block, number of blocks, of documents, of
ids), then per block its ids and per plane place and length, then the
documents' ids and lengths.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"IDPLANE1"
BLOCK_IDS = 65_536


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.view("<u4").reshape(-1)
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p is not None:
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Writes documents' ids, as little-endian unsigned 32-bit bytes, to `out.write`."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.blocks: list[int] = []
        self.pending, self.waiting = [], 0
        self.out.write(MAGIC)

    def add(self, key: int, ids: bytes) -> None:
        self.docs.append(key)
        self.lengths.append(len(ids) // 4)
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        at = 0
        while len(ids) - at >= self.block_ids or (rest and at < len(ids)):
            block = ids[at : at + self.block_ids]
            self.blocks.append(len(block))
            for plane in to_planes(block, self.kind):
                data = self.zstd.compress(plane) if plane.count(0) < len(plane) else b""
                self.blocks += [self.out.write(data), len(data)]
            at += len(block)
        self.pending, self.waiting = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> int:
        """Writes the rest and the index; returns the number of ids."""
        self._flush(True)
        planes, total = 4 if self.kind == "byte" else 32, sum(self.lengths)
        head = [1, self.block_ids, planes, len(self.blocks) // (1 + 2 * planes), len(self.docs), total]
        index = self.zstd.compress(np.array(head + self.blocks + self.docs + self.lengths, "<i8").tobytes())
        self.out.write(index)
        self.out.write(struct.pack("<Q", len(index)) + MAGIC)
        return total


class PlaneReader:
    """Reads a file through read(at, n) of a given size."""

    def __init__(self, source):
        self.source = source
        tail = source.read(source.size - 16, 16)
        if tail[8:] != MAGIC or source.read(0, 8) != MAGIC:
            raise ValueError("not an id-plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(source.size - 16 - n, n)), "<i8")
        version, self.block_ids, planes, blocks, docs, self.n_ids = index[:6].tolist()
        if version != 1:
            raise ValueError(f"id-plane version {version}")
        end = 6 + blocks * (1 + 2 * planes)
        self.blocks = index[6:end].reshape(blocks, 1 + 2 * planes)
        self.docs, self.lengths = index[end : end + docs], index[end + docs : end + 2 * docs]

    def block(self, k: int) -> np.ndarray:
        n, *places = self.blocks[k].tolist()
        zstd = zstandard.ZstdDecompressor()
        return from_planes([zstd.decompress(self.source.read(at, size)) if size else None for at, size in zip(places[::2], places[1::2], strict=True)], n)

    def documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(key, number of ids before it, its ids in pieces), holding one block at a time."""
        k, have, at, before = 0, np.zeros(0, "<u4"), 0, 0
        for key, n in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            parts, left = [], n
            while left:
                if at == len(have):
                    have, at, k = self.block(k), 0, k + 1
                part = have[at : at + left]
                parts.append(part)
                at, left = at + len(part), left - len(part)
            yield key, before, parts
            before += n
