"""Token counts of whole texts, huge ones by overlapping chunks.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two
neighbours are spliced inside their overlap at a boundary that both have and
that is proven stable from the vocabulary: between two characters that stand
side by side in no piece, where no merge can cross, and that the model's
normalisation treats one by one; so what is left and right of the place is
encoded alike in any context. Before a space such places are found in most
writing, between characters in writing without spaces. Where a chunk has none
it grows to twice its size; where the encodings do not agree at one, the overlap
is widened. So at most a small multiple of the text's bytes is encoded.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tidy import tidy

#: Bytes of a chunk and of the first overlap tried.
CHUNK, OVERLAP = 32_768, 512
_MARK = "▁"
#: Bytes looked through at once for a stable place.
_BLOCK = 4_096


class Counter:
    """Counts tokens by a sentencepiece model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: characters that stand side by side in a piece
        self.beside = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        #: unknown characters become bytes one by one; else runs of them would be one token
        self.bytes = any(self.model.is_byte(i) for i in range(len(pieces)))
        self.known: dict[str, bool] = {}
        #: bytes given to the model for long texts
        self.encoded = 0

    def counts(self, texts: list[str]) -> list[int]:
        short = [len(t) * 4 <= self.chunk or len(t.encode()) <= self.chunk for t in texts]
        found = iter(self.model.encode([t for t, s in zip(texts, short, strict=True) if s], num_threads=1)) if any(short) else iter(())
        return [len(next(found)) if s else self.long(t) for t, s in zip(texts, short, strict=True)]

    def _normal(self, text: str) -> str:
        """`text` as it is normalised inside a text."""
        return self.model.normalize(f"x{text}x").lstrip(_MARK)[1:-1]

    def apart(self, pair: str) -> bool:
        """Whether texts are encoded alike left and right of the place between two characters."""
        found = self.known.get(pair)
        if found is None:
            a, b = pair
            found = not a.isspace() and a != _MARK and (b == " " or not (b.isspace() or b == _MARK or unicodedata.category(b)[0] in "MC" or 0x1100 <= ord(b) <= 0x11FF))
            if found:
                x, y = self._normal(a), self._normal(b)
                found = bool(x and y) and self._normal(pair) == x + y and (x[-1], y[0]) not in self.beside
                if found and not self.bytes:
                    found = all(self.model.piece_to_id(c) != self.model.unk_id() for c in (x[-1], y[0]))
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[pair] = found
        return found

    def _places(self, raw: bytes, lo: int, hi: int) -> Iterator[int]:
        """Stable places of the text between two of its bytes, the last first."""
        while hi > lo:
            at = max(lo, hi - _BLOCK)
            while at > lo and raw[at] & 0xC0 == 0x80:
                at -= 1
            text, place = raw[at:hi].decode(), hi
            before = raw[max(0, at - 4) : at].decode(errors="ignore")[-1:]
            chars = before + text
            for k in range(len(chars) - 1, 0, -1):
                place -= len(chars[k].encode())
                if self.apart(chars[k - 1 : k + 1]):
                    yield place
            hi = at

    def _starts(self, raw: bytes, at: int, end: int) -> list[int]:
        """Where the pieces of the text raw[at:end] begin in all of raw."""
        self.encoded += end - at
        return [at + p.begin for p in self.model.encode(raw[at:end].decode(), return_type="proto").pieces]

    def long(self, text: str) -> int:
        """Tokens of a text, chunk by chunk."""
        raw = text.encode()

        def char(i: int) -> int:
            while i < len(raw) and raw[i] & 0xC0 == 0x80:
                i -= 1
            return min(i, len(raw))

        # counted are the pieces before `done`; a chunk goes from `at` to `end`, and no place up to `seen` will do
        total = at = done = seen = 0
        size, starts = self.chunk, None
        while True:
            end = max(char(at + size), char(min(len(raw), at + 4)))
            starts = self._starts(raw, at, end) if starts is None else starts
            first = bisect_left(starts, done) if done else 0
            if end == len(raw):
                return total + len(starts) - first
            for place in self._places(raw, max(seen, done, at), end):
                k = bisect_left(starts, place)
                if place <= done or k == len(starts) or starts[k] != place:
                    continue
                overlap, begin = self.overlap, None
                while begin != at:
                    begin = char(max(at, place - overlap))
                    more = self._starts(raw, begin, max(char(begin + self.chunk), end))
                    j = bisect_left(more, place)
                    if j < len(more) and more[j] == place:
                        break
                    overlap *= 2
                else:
                    continue
                total += k - first
                at, done, seen, size, starts = begin, place, place, max(self.chunk, end - begin), more
                break
            else:
                seen, size, starts = max(seen, char(end - 1)), 2 * size, None


@tidy
def _counted(rows: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = None
    for batch in rows:
        counter = counter or Counter(path)
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            n = counter.counts([t or "" for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: no bytes, no tokens. Null and repeated keys are
    kept as they are; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _counted(batches, model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
