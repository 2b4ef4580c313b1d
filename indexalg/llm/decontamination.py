"""Benchmark decontamination by an FM-index per training shard.

Each task cuts its documents into shards and indexes all words of a shard once;
all windows of the benchmark are searched backwards through that index,
occurrences are located by sampled suffix positions and merged to spans. Between
documents stands a symbol of its own, so no window reaches across.

The benchmark's windows go to the executors as files in the shared folder, in
blocks of bounded size, each searched in turn in the same index.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import NewFile, RangeReader
from .fm_index import FMIndex
from .shared import fresh_folder
from .tidy import tidy
from .words import ALNUM, LOWER, slices, text_buffers, word_spans, words_of

WINDOW = 13
#: Words of a shard; one more text of any length may follow the last.
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text in a block of windows.
BLOCK_BYTES = 32 << 20
#: Located at once.
LOCATE_ROWS = 1 << 20


class Windows:
    """The windows of some items: their words as symbols from 2 on, and which items have them."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int):
        data, off = text_buffers(pa.array(texts, pa.large_string()))
        words, count = words_of(data, off, ALNUM)
        self.vocabulary = np.unique(words)
        symbols = np.searchsorted(self.vocabulary, words).astype(np.int32) + 1
        first = np.concatenate(([0], np.cumsum(count)))
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, item in enumerate(ids):
            own = symbols[first[k] : first[k + 1]]
            if len(own) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
            elif len(own):
                rows.append(np.concatenate((np.zeros(window - len(own), np.int32), own))[None])
            else:
                continue
            owners.append(np.full(len(rows[-1]), -1 if item is None else k))
        self.patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(1)
        pairs = np.unique(np.stack((which.reshape(-1), np.concatenate(owners)), 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        self.items = np.array([x or 0 for x in ids], np.int64)[pairs[:, 1]]
        self.item_end = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns)), side="right")


class Shard:
    """The index of a run of words; `row` is each word's document."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        place = np.arange(len(words)) + row - (row[0] if len(row) else 0)
        # 1 stands between documents
        text = np.ones((int(place[-1]) if len(place) else 0) + 1, np.int32)
        text[place] = symbols + 2
        self.where = np.zeros(len(text), np.int64)
        self.where[place] = np.arange(len(words))
        self.index = FMIndex(text, max(2, int(len(self.vocabulary) + 1).bit_length()))

    def occurrences(self, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern, first word) of all occurrences."""
        if not len(self.vocabulary) or not len(windows.patterns):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, windows.vocabulary), len(self.vocabulary) - 1)
        # what a window's symbols are here; -1 for a word that is not
        ours = np.concatenate(([0], np.where(self.vocabulary[at] == windows.vocabulary, at + 2, -1))).astype(np.int32)
        patterns = ours[windows.patterns]
        here = np.flatnonzero((patterns >= 0).all(1))
        lo, hi = self.index.search(patterns[here], windows.lengths[here])
        found = np.flatnonzero(lo < hi)
        size = (hi - lo)[found]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        for a in range(0, total, LOCATE_ROWS):
            k = np.arange(a, min(total, a + LOCATE_ROWS))
            which = np.searchsorted(end, k, side="right")
            rows = lo[found[which]] + k - (end[which] - size[which])
            yield here[found[which]], self.where[self.index.locate(rows)]


def search_shard(blocks: Iterable[Windows], words: np.ndarray, count: np.ndarray, shard_words: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hit or not, for every word; distinct (document, item) rows) of documents given by words and counts.

    A run of documents longer than a shard is indexed in several, which overlap
    by a window less one word.
    """
    row = np.repeat(np.arange(len(count)), count)
    change = np.zeros(len(words) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for a in range(0, len(words), shard_words):
        b = min(len(words), a + shard_words + window - 1)
        shard = Shard(words[a:b], row[a:b])
        for windows in blocks:
            for pattern, at in shard.occurrences(windows):
                at = at + a
                np.add.at(change, at, 1)
                np.add.at(change, at + windows.lengths[pattern], -1)
                first = np.where(pattern > 0, windows.item_end[pattern - 1], 0)
                n = windows.item_end[pattern] - first
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                pairs.append(np.unique(np.stack((np.repeat(row[at], n), windows.items[k]), 1), axis=0))
    return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


@lru_cache(1)
def _only(folder: str, path: str) -> Windows:
    return _load(folder, path)


def _load(folder: str, path: str) -> Windows:
    source = RangeReader(folder, path)
    raw = source.read(0, source.size)
    source.close()
    return pickle.loads(raw)


class _Blocks:
    """The blocks of windows, one in memory at a time."""

    def __init__(self, folder: str, paths: list[str]):
        self.folder, self.paths = folder, paths

    def __iter__(self) -> Iterator[Windows]:
        for path in self.paths:
            yield _only(self.folder, path) if len(self.paths) == 1 else _load(self.folder, path)


def window_blocks(benchmark: DataFrame, item: str, text: str, window: int) -> tuple[str, list[str]]:
    """Writes the benchmark's windows to the shared folder; the driver holds a block and a partition at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("length(text) > 0")
    folder, paths, own, size = fresh_folder(benchmark.sparkSession, "windows"), [], [], 0

    def store() -> None:
        out = NewFile(folder, ".windows")
        out.write(pickle.dumps(Windows([r.item for r in own], [r.text for r in own], window)))
        paths.append(out.close())

    for r in rows.distinct().orderBy("item", "text").toLocalIterator():
        if own and size + len(r.text) > BLOCK_BYTES:
            store()
            own, size = [], 0
        own.append(r)
        size += len(r.text)
    if own:
        store()
    return folder, paths


def _shards(rows: Iterator[pa.RecordBatch], text: str, folder: str, paths: list[str], shard_words: int, window: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """(batches, words of each row, hit or not of each word, (row, item)) shard by shard."""
    blocks = _Blocks(folder, paths)
    batches, words, counts, size = [], [], [], 0

    def searched():
        count = np.concatenate(counts)
        return batches, count, *search_shard(blocks, np.concatenate(words), count, shard_words, window)

    for batch, data, off in slices(rows, text):
        hashes, count = words_of(data, off, ALNUM)
        batches.append(batch)
        words.append(hashes)
        counts.append(count)
        size += len(hashes)
        if size >= shard_words:
            yield searched()
            batches, words, counts, size = [], [], [], 0
    if batches:
        yield searched()


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


@tidy
def _reported(rows: Iterator[pa.RecordBatch], folder: str, paths: list[str], shard_words: int, window: int, share: int) -> Iterator[pa.RecordBatch]:
    for batches, count, hit, pairs in _shards(rows, "text", folder, paths, shard_words, window):
        end = np.cumsum(count)
        total = np.concatenate(([0], np.cumsum(hit)))
        n_hit = total[end] - total[end - count]
        own = np.searchsorted(pairs[:, 0], np.arange(len(count) + 1))
        items = [pairs[a:b, 1].tolist() for a, b in zip(own[:-1], own[1:], strict=True)]
        none = hashlib.sha256(b"").hexdigest()
        digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() if x else none for x in items]
        spans = [[{"start": s, "end": e} for s, e in _spans(hit[e - n : e])] if h else [] for e, n, h in zip(end.tolist(), count.tolist(), n_hit.tolist(), strict=True)]
        ids = pa.chunked_array([b.column(0) for b in batches]).combine_chunks()
        columns = [ids, pa.array(count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array((n_hit > 0) & (share * n_hit >= count)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    A window is `window` consecutive words of an item, or all words of a
    shorter one; every word inside an occurrence of one is hit. contaminated: at
    least one word in `share` is hit. spans are the merged runs of hit words,
    from 0, end excluded. Null and empty texts have no words. Rows with equal
    item_id are one item; one without an id hits but is not listed. Repeated
    documents are each reported; extra columns are ignored; an empty table
    gives no rows, an empty benchmark no hits.
    """
    folder, paths = window_blocks(benchmark, item_id, text, window)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>, items array<long>"
    return rows.mapInArrow(lambda batches: _reported(batches, folder, paths, shard_words, window, share), schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end = word_spans(LOWER[raw], np.array([0, len(raw)]), ALNUM)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : start[a]].tobytes())
        at = int(end[b - 1])
    return b"".join([*out, raw[at:].tobytes()]).decode()


@tidy
def _cleaned(rows: Iterator[pa.RecordBatch], text: str, folder: str, paths: list[str], shard_words: int, window: int, share: int) -> Iterator[pa.RecordBatch]:
    for batches, count, hit, _ in _shards(rows, text, folder, paths, shard_words, window):
        end, row = np.cumsum(count), 0
        total = np.concatenate(([0], np.cumsum(hit)))
        n_hit = total[end] - total[end - count]
        for batch in batches:
            own = np.arange(row, row + batch.num_rows)
            bad = (n_hit[own] > 0) & (share * n_hit[own] >= count[own])
            k = batch.schema.get_field_index(text)
            if (n_hit[own] > 0).any():
                texts = batch.column(k).to_pylist()
                for i in np.flatnonzero((n_hit[own] > 0) & ~bad).tolist():
                    texts[i] = _cut(texts[i], _spans(hit[end[row + i] - count[row + i] : end[row + i]]))
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
            yield batch.filter(pa.array(~bad))
            row += len(own)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, item_id: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` without contaminated rows, and without the hit spans of the others; all columns are kept."""
    folder, paths = window_blocks(benchmark, item_id, text, window)
    return docs.mapInArrow(lambda batches: _cleaned(batches, text, folder, paths, shard_words, window, share), docs.schema)
