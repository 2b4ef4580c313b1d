"""Byte-level word kernels on Arrow string columns.

Words are maximal runs of word bytes. Both word classes used here are unions
of ASCII ranges plus all bytes of multi-byte characters, so cutting UTF-8 by
bytes cuts it by characters. A-Z are lower-cased by table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
#: Text handled at once; bounds the temporaries at about 60 bytes a byte.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0, U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        a, b = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
        a[0] = b[0] = 1
        _powers = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _powers


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a row boundary ends a word."""
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
    return np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


def words_of(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, number of words of each row).

    Works through the bytes in pieces cut at non-word bytes, so one huge row
    needs no more temporaries than many small ones.
    """
    data = LOWER[data]
    hashes, count, at, n = [], np.zeros(len(off) - 1, np.int64), 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        if end < n:
            stop = np.flatnonzero(~is_word[data[at:end]])
            while not len(stop) and end < n:  # one word longer than the piece
                end = min(n, end + SLICE_BYTES)
                stop = np.flatnonzero(~is_word[data[at:end]])
            if end < n:
                end = at + int(stop[-1]) + 1
        part = data[at:end]
        lo, hi = np.searchsorted(off, (at, end))
        start, stop = word_spans(part, off[lo:hi] - at if hi > lo else np.zeros(0, np.int64), is_word)
        up, down = _pow(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[stop] - total[start]) * down[start]))
        if len(start):
            row = np.searchsorted(off, start + at, side="right") - 1
            first = int(row[0])
            found = np.bincount(row - first)
            count[first : first + len(found)] += found
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), count


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, min(lo + SLICE_ROWS, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def shingles_of(hashes: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct shingle, sorted within its row; number per row).

    A row with fewer words than `width`, but some, has its whole sequence as
    its one shingle; a row without words has none.
    """
    rows = len(count)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    if len(hashes) >= width:
        m = len(hashes) - width + 1
        rolled = mix(hashes[:m] + U(width))
        for k in range(1, width):
            rolled = mix(rolled * U(_BASE) + hashes[k : k + m])
    else:
        rolled = np.zeros(0, U)
    each = np.maximum(count - width + 1, 0)
    row = np.repeat(np.arange(rows), each)
    where = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(each)))[:-1], each) + np.repeat(first, each)
    values = rolled[where]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = mix(hashes[first[short]] + count[short].astype(U))
        for k in range(1, width):
            more = np.flatnonzero(count[short] > k)
            whole[more] = mix(whole[more] * U(_BASE) + hashes[first[short[more]] + k])
        values, row = np.concatenate((values, whole)), np.concatenate((row, short))
    order = np.argsort(values)
    order = order[np.argsort(row[order], kind="stable")]
    values, row = values[order], row[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[keep], row[keep]
    return values, np.bincount(row, minlength=rows)
