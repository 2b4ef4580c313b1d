"""Token ids of documents in plane files, in key order."""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bit_planes import PlaneReader, PlaneWriter
from .files import NewFile, RangeReader
from .shared import cut, fresh_folder
from .tidy import tidy

END_ID = 0
#: Entries of a worker's cache of encoded words; when full, those after the first CORE go.
CACHE, CORE = 1_000_000, 500_000


#: Signs that end a word; after a letter or digit the pre-tokenizer sees a run of them on its own.
_SIGNS = ".,;:!?*&%$#|)"
_LETTERS = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7)))

_VISIBLE = _LETTERS.union(_SIGNS)


def _blank(c: str) -> bool:
    return c.isspace() or c == "\u180e"


class WordEncoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    The library's pre-tokenizer never joins a space to what stands before it,
    so a text falls apart before each single space, and the library's ids of
    the pieces, joined, are its ids of the text. A piece falls apart further
    around a single line feed between visible characters, and between a word
    and the signs that end it. Parts are encoded by the library once and
    remembered. Texts with special tokens' strings, or with a space after other
    white space, go to the library whole; and so do all texts if the vocabulary
    has another pre-tokenizer, a normalizer or a prefix of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.composed = composes(json.load(f))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.feed = self._encode(["\n"])[0]
        #: with a space before them; None stands for pieces that may not be cut from a space after them
        self.ids: dict[str, bytes | None] = {}
        self.core: dict[str, bytes | None] = {}
        self.bare: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, pieces: list[str], mark: str) -> list[bytes]:
        """Each piece with the mark before it: encoded as one text and cut where a token begins with the mark, which only a piece's first can."""
        if not pieces:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([mark + mark.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.opens[ids] if mark == " " else ids == np.frombuffer(self.feed, "<u4")[0]) * 4).tolist()
        if len(cuts) != len(pieces):
            return self._encode([mark + p for p in pieces])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    @staticmethod
    def _stem(word: str) -> str:
        stem = word.rstrip(_SIGNS)
        return stem if stem and stem[-1] in _LETTERS else word

    def _learn_bare(self, words: set[str]) -> None:
        """Words without a space before them."""
        new = list(words.difference(self.bare))
        plain = [w for w in new if "\n" not in w and not _blank(w[0]) and not _blank(w[-1])]
        self.bare.update((w, ids[len(self.feed) :]) for w, ids in zip(plain, self._encode_joined(plain, "\n"), strict=True))
        other = [w for w in new if w not in self.bare]
        self.bare.update(zip(other, self._encode(other), strict=True))

    def _learn(self, new: set[str]) -> None:
        """Pieces with a space before them."""
        ids, parts = self.ids, {}
        plain = [p for p in new if p[-1:] in _VISIBLE and "\n" not in p]
        if len(plain) < len(new):
            for p in new.difference(plain):
                if not p or _blank(p[-1]):
                    ids[p] = None
                elif "\n" in p and all(x and not _blank(x[0]) and not _blank(x[-1]) for x in p.split("\n")):
                    parts[p] = p.split("\n")
                else:
                    plain.append(p)
        words = plain + [x[0] for x in parts.values() if x[0] not in ids]
        stems = [w.rstrip(_SIGNS) for w in words]
        stems = [t if t[-1:] in _LETTERS else w for t, w in zip(stems, words, strict=True)]
        need = list(set(stems).difference(ids))
        ids.update(zip(need, self._encode_joined(need, " "), strict=True))
        ended = [(w, t, w[len(t) :]) for w, t in zip(words, stems, strict=True) if w is not t]
        self._learn_bare({x[2] for x in ended}.union(*(x[1:] for x in parts.values())))
        bare = self.bare
        for w, t, e in ended:
            ids[w] = ids[t] + bare[e]
        for p, x in parts.items():
            ids[p] = self.feed.join([ids[x[0]], *(bare[y] for y in x[1:])])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.composed or not texts:
            return self._encode(texts)
        if not self.core and len(self.ids) > CORE:
            self.core = dict(self.ids)
        if len(self.ids) > CACHE:
            self.ids = dict(self.core)
        if len(self.bare) > CORE:
            self.bare = {"": b""}
        # Arrow splits, numbers the distinct pieces and strings their ids together; Python sees each distinct piece once
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, coded = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # joined and split at spaces, which none holds: faster than to_pylist()
        words = pc.binary_join(pa.LargeListArray.from_arrays([0, len(distinct)], distinct), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        first, last = bounds[:-1], bounds[1:] - 1
        heads, ends = [words[k] for k in at[first].tolist()], [words[k] for k in at[last].tolist()]
        tails = [k for k, (e, a, b) in enumerate(zip(ends, first.tolist(), last.tolist(), strict=True)) if a < b and e[-1:].isspace()]
        inner = np.ones(len(at), bool)
        inner[first] = inner[last[tails]] = False
        used = np.zeros(len(words), bool)
        used[at[inner]] = True
        used = np.flatnonzero(used).tolist()
        mine = [words[k] for k in used] if len(used) < len(words) else words
        found = list(map(self.ids.get, mine))
        unknown = [k for k, x in enumerate(found) if x is None]
        self._learn({mine[k] for k in unknown if mine[k] not in self.ids})
        for k in unknown:
            found[k] = self.ids[mine[k]]
        self._learn_bare(set(heads))
        whole = [any(s in t for s in self.special) or (len(head) < len(t) and head != "" and _blank(head[-1])) for t, head in zip(texts, heads, strict=True)]
        uncut = [used[k] for k in unknown if found[k] is None]
        if uncut:  # the library sees such a text as it is
            bad = np.zeros(len(words), bool)
            bad[uncut] = True
            for k in (np.searchsorted(bounds, np.flatnonzero(bad[at] & inner), "right") - 1).tolist():
                whole[k] = True
        ids = np.full(len(words), b"", object)
        ids[used] = found
        ids = ids.tolist() + [self.bare[head] for head in heads]
        at[first] = np.arange(len(words), len(ids))
        tails = [k for k in tails if not whole[k]]
        at[last[tails]] = np.arange(len(ids), len(ids) + len(tails))
        ids += self._encode([f" {ends[k]}" for k in tails])
        joined = pa.array(ids, pa.large_binary()).take(pa.array(at))
        cuts = np.frombuffer(joined.buffers()[1], np.int64, len(at) + 1)[bounds].tolist()
        raw = memoryview(joined.buffers()[2] or b"")
        return [self._encode([t])[0] if w else bytes(raw[a:b]) for t, w, a, b in zip(texts, whole, cuts[:-1], cuts[1:], strict=True)]


def composes(vocabulary: dict) -> bool:
    """Whether a vocabulary's texts are encoded word by word, as WordEncoder takes for granted."""
    before, model = vocabulary.get("pre_tokenizer") or {}, vocabulary.get("model") or {}
    plain = not vocabulary.get("normalizer") and not any(vocabulary.get(k) for k in ("truncation", "padding"))
    split = before.get("type") == "ByteLevel" and before.get("add_prefix_space") is False and before.get("use_regex", True)
    bytes_only = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    added = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in vocabulary.get("added_tokens") or [])
    return bool(plain and split and bytes_only and added and "\u010a" in model.get("vocab", {}))


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker.

    Its work is lists of strings, which the cyclic garbage collector would look
    through again and again without finding anything.
    """
    gc.set_threshold(1_000_000, 50, 50)
    return WordEncoder(path)


def _groups(texts: list[str], limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for hi, t in enumerate(texts):
        size += len(t)
        if size > limit:
            yield lo, hi + 1
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@tidy
def _written(rows: Iterator[pa.RecordBatch], vocabulary: str, folder: str, kind: str) -> Iterator[pa.RecordBatch]:
    encoder = writer = out = None
    nulls = 0
    for batch in rows:
        keys = batch.column(0)
        for lo in range(0, batch.num_rows, 2048):
            texts = [t or "" for t in batch.column(1).slice(lo, 2048).to_pylist()]
            for a, b in _groups(texts):
                if writer is None:
                    encoder, out = word_encoder(vocabulary), NewFile(folder, ".planes")
                    writer = PlaneWriter(out, kind)
                end = np.array([END_ID], "<u4").tobytes()
                for k, ids in enumerate(encoder(texts[a:b]), lo + a):
                    key = keys[k].as_py()
                    nulls += key is None
                    writer.add(0 if key is None else key, ids + end)
    if writer is not None:
        total, n = writer.close(), len(writer.docs)
        row = [TaskContext.get().partitionId(), out.close(), n, nulls, total]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "path", "n_docs", "n_null", "n_ids"])


def write_token_ids(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", kind: str = "byte") -> tuple[DataFrame, str]:
    """Writes plane files in ascending key order (null first); (files, folder).

    files: part (their order), path, n_docs, n_null (documents without a key,
    the first of the file), n_ids, base (ids in the files before). A task that
    is run again writes a new file; only files of tasks that ended are listed.
    Null texts count as empty: one id, the end id. Rows with equal keys stand
    together, in order of a hash of their texts, over several files if many.
    """
    folder = fresh_folder(docs.sparkSession, "token-ids")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("draw", F.xxhash64("text")).repartitionByRange("doc_id", "draw").sortWithinPartitions("doc_id", "draw", "text").drop("draw")
    files = cut(rows.mapInArrow(lambda batches: _written(batches, vocabulary, folder, kind), "part long, path string, n_docs long, n_null long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")), folder


@tidy
def _read(rows: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for path, base, nulls in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            source, out = RangeReader(folder, path), []
            for k, (key, before, parts) in enumerate(PlaneReader(source).documents()):
                crc = 0
                for part in parts:
                    crc = zlib.crc32(part.tobytes(), crc)
                out.append((None if k < nulls else key, base + before, sum(map(len, parts)), crc))
            source.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_ids(files: DataFrame, folder: str) -> DataFrame:
    """Per document of plane files: doc_id, start, n_tokens, ids_crc32."""
    paths = files.select("path", "base", "n_null")
    n = max(1, paths.count())
    return paths.repartition(n).mapInArrow(lambda batches: _read(batches, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, vocabulary: str, **columns: str) -> DataFrame:
    """write_token_ids() and read_token_ids(); no rows for an empty table."""
    return read_token_ids(*write_token_ids(docs, vocabulary, **columns))
