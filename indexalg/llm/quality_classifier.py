"""Quality classifier: ordinal regression on graded ratings.

A cumulative-link model: one weight per hashed text feature, shared by all
grades, and ordered thresholds; P(grade > k) = s(score - threshold k). It gives
the expected grade and the tail probability of the highest grade, by which
documents are selected.

Ratings come from labels: grade 0 for toxic text, 1 for other text of low
quality, 2 for good text.

Features are present or absent: every distinct word, the first four, five and
six bytes of longer words (in many tongues the telling part of a word is its
stem), and shape features: in which band lie the shares of signs, capitals,
digits and bars, overall and in the block of 256 bytes that has most of them,
of distinct words, and of words that repeat the word before.

The model is fitted in numpy on a bounded sample of rated documents: the first
`most_rated` in order of a hash of their key, without those whose text is longer
than `most_bytes`. Scoring reads every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut
from .tidy import tidy
from .words import ALNUM, LOWER, SPACED, _BYTE, _pow, mix, slices, word_spans

BUCKETS = 1 << 20
STEMS = (4, 5, 6)
GRADES = 3
#: Rated documents the model is fitted on, and bytes of the longest of them.
MOST_RATED, MOST_BYTES = 8_000, 8 << 20
#: Passes, documents in a step, and of FTRL-Proximal the rate, and what a weight's pull must outweigh to make it other than 0, per root of a document.
EPOCHS, BATCH, RATE, SPARSE = 20, 16, 1.0, 0.13
BLOCK = 256
_SEED = np.arange(8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SIGN = SPACED & ~ALNUM
_SIGN[65:91] = False
_TABLES = [_SIGN, np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)]
_TABLES[1][65:91] = _TABLES[2][48:58] = _TABLES[3][124] = True
_PIECE = 1 << 20


def _pieces(n: int, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of bytes cut where no word is cut."""
    at = 0
    while at < n:
        end = min(n, at + _PIECE)
        while end < n and word[end - 1] and word[end]:
            stop = np.flatnonzero(~word[end : end + _PIECE])
            end = end + int(stop[0]) if len(stop) else min(n, end + _PIECE)
        yield at, end
        at = end


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, how many each row has): distinct buckets, row after row."""
    rows = len(off) - 1
    lower = LOWER[data]
    found, n_words, again = [], np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    words, last, last_row = [np.zeros(0, np.uint64)], None, -1
    for a, b in _pieces(len(data), ALNUM[lower]):
        part = lower[a:b]
        lo, hi = np.searchsorted(off, (a, b))
        start, end = word_spans(part, off[lo:hi] - a if hi > lo else np.zeros(0, np.int64), ALNUM)
        if not len(start):
            continue
        up, down = _pow(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        row = (np.searchsorted(off, start + a, side="right") - 1).astype(np.uint64)
        hashed = mix((total[end] - total[start]) * down[start])
        n_words += np.bincount(row.astype(np.int64), minlength=rows)
        repeats = np.flatnonzero((hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1]))
        again += np.bincount(row[repeats].astype(np.int64), minlength=rows)
        if hashed[0] == last and row[0] == last_row:  # the word before stands in the piece before
            again[int(last_row)] += 1
        last, last_row = hashed[-1], row[-1]
        words.append(np.unique(row << np.uint64(20) | (hashed & np.uint64(BUCKETS - 1))))
        for k, size in enumerate(STEMS, 1):
            s, r = start[end - start > size], row[end - start > size]
            found.append(np.unique(r << np.uint64(20) | (mix((total[s + size] - total[s]) * down[s] + _SEED[k]) & np.uint64(BUCKETS - 1))))
    found.append(np.unique(np.concatenate(words)))
    distinct = np.bincount((found[-1] >> np.uint64(20)).astype(np.int64), minlength=rows)
    length = np.diff(off)
    n = -(-length // BLOCK)
    block = np.repeat(off[:-1] - (np.cumsum(n) - n) * BLOCK, n) + np.arange(int(n.sum())) * BLOCK
    block_end = np.minimum(block + BLOCK, np.repeat(off[1:], n))
    first = (np.cumsum(n) - n)[n > 0]

    def band(x: np.ndarray) -> np.ndarray:
        return np.sqrt(x * 144).astype(np.int64)

    shapes = []
    for table in _TABLES:
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        shapes.append(band((total[off[1:]] - total[off[:-1]]) / np.maximum(length, 1)))
        most = np.zeros(rows)
        if len(block):
            # short last blocks count as whole ones
            most[n > 0] = np.maximum.reduceat((total[block_end] - total[block]) / np.minimum(BLOCK, np.repeat(np.maximum(length, 64), n)), first)
        shapes.append(band(np.minimum(most, 1)))
    shapes.append(np.minimum(distinct / np.maximum(n_words, 1) * 20, 20).astype(np.int64))
    shapes.append(band(again / np.maximum(n_words, 1)))
    shapes.append(np.minimum(length / np.maximum(n_words, 1), 39).astype(np.int64))
    shapes.append(np.log2(n_words + 1).astype(np.int64))
    for k, shape in enumerate(shapes):  # a band has the features of all bands below it
        row = np.repeat(np.arange(rows), shape + 1)
        level = np.arange(len(row)) - np.repeat(np.cumsum(shape + 1) - shape - 1, shape + 1)
        found.append(row.astype(np.uint64) << np.uint64(20) | (mix((level + 1000 * (k + 1)).astype(np.uint64)) & np.uint64(BUCKETS - 1)))
    keys = np.unique(np.concatenate(found))
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int32), np.bincount((keys >> np.uint64(20)).astype(np.int64), minlength=rows)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """Weights of buckets, and thresholds in ascending order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(buckets: np.ndarray, each: np.ndarray, grades: np.ndarray, seed: int = 1) -> OrdinalModel:
        """Maximum likelihood by FTRL-Proximal, which leaves most weights at 0, so that long texts don't add up noise."""
        share = np.clip(np.array([(grades > k).mean() for k in range(GRADES - 1)]), 1e-3, 1 - 1e-3)
        thresholds = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(GRADES - 1) * 1e-3)
        w, pulls, square, square_t = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), np.full(GRADES - 1, 1e-3)
        end, r, sparse = np.cumsum(each), np.random.default_rng(seed), SPARSE * len(each) ** 0.5
        for _ in range(EPOCHS):
            order = r.permutation(len(each))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                n = each[own]
                k = np.repeat(end[own] - n, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                b, doc = buckets[k], np.repeat(np.arange(len(own)), n)
                eta = np.bincount(doc, weights=w[b], minlength=len(own))
                y = grades[own]
                bounds = np.concatenate(([-np.inf], thresholds, [np.inf]))
                low, high = _sigmoid(eta - bounds[y]), _sigmoid(eta - bounds[y + 1])
                p = np.maximum(low - high, 1e-9)
                d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
                d_low[y == 0], d_high[y == GRADES - 1] = 0, 0
                pull = -(d_low - d_high)
                grad_t = np.zeros(GRADES - 1)
                np.add.at(grad_t, (y - 1)[y > 0], d_low[y > 0] / len(own))
                np.add.at(grad_t, y[y < GRADES - 1], -d_high[y < GRADES - 1] / len(own))
                touched, at = np.unique(b, return_inverse=True)
                g = np.bincount(at, weights=pull[doc])
                new = square[touched] + g * g
                pulls[touched] += g - (np.sqrt(new) - np.sqrt(square[touched])) / RATE * w[touched]
                square[touched] = new
                z = pulls[touched]
                w[touched] = np.where(np.abs(z) > sparse, -(z - np.sign(z) * sparse) / ((1 + np.sqrt(new)) / RATE), 0)
                square_t += grad_t * grad_t
                thresholds = np.maximum.accumulate(thresholds - 0.1 * grad_t / np.sqrt(square_t))
                thresholds = thresholds + np.arange(GRADES - 1) * 1e-9
        return OrdinalModel(w.astype(np.float32), thresholds)

    def tails(self, buckets: np.ndarray, each: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[buckets], dtype=np.float64)))
        end = np.cumsum(each)
        return _sigmoid((total[end] - total[end - each])[:, None] - self.thresholds)


def grade(quality: F.Column, toxic: F.Column) -> F.Column:
    """0 toxic, 1 of low quality, 2 good; null if not rated."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a table with doc_id, quality and toxic."""
    return labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))


@tidy
def _featured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, off in slices(rows, "text"):
        buckets, each = features(data, off)
        end = np.cumsum(each)
        lists = [buckets[e - n : e].tobytes() for e, n in zip(end.tolist(), each.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], ["rated", "grade", "buckets"])


def fit_classifier(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rated: int = MOST_RATED, most_bytes: int = MOST_BYTES) -> OrdinalModel | None:
    """A model of `ratings` (doc_id, grade) for `docs`; None if no document is rated, or all rated ones have one grade.

    Fitted on at most `most_rated` documents of at most `most_bytes` each; a
    longer one is left out alone. Null keys and grades are left out, too. Of
    repeated ratings of a key the lowest grade counts, of repeated rated
    documents the least text. Raises ValueError if there are different grades
    but the bounds leave one.
    """
    sample = ratings.select(F.col("doc_id").cast("long").alias("rated"), F.col("grade").cast("int").alias("grade")).where("rated IS NOT NULL AND grade IS NOT NULL")
    # keys without a document must not use up the sample
    known = docs.select(F.col(doc_id).cast("long").alias("rated"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("bytes"))
    sample = sample.groupBy("rated").agg(F.min("grade").alias("grade")).join(known.groupBy("rated").agg(F.min("bytes").alias("bytes")), "rated")
    sample = cut(sample)
    chosen = cut(sample.where(F.col("bytes") <= most_bytes).drop("bytes").orderBy(F.xxhash64("rated"), "rated").limit(most_rated))
    rows = docs.select(F.col(doc_id).cast("long").alias("rated"), F.col(text).cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    # features are a small part of long texts; a key with very many rows is rated by its first
    rows = rows.join(F.broadcast(chosen), "rated").groupBy("rated", "grade").agg(F.min("text").alias("text"))
    found = sorted(rows.select("rated", "grade", "text").mapInArrow(_featured, "rated long, grade int, buckets binary").collect(), key=lambda r: r.rated)
    grades = np.array([r.grade for r in found], np.int64)
    if len(np.unique(grades)) < 2:
        if sample.agg(F.count_distinct("grade")).first()[0] > 1:
            raise ValueError("the bounds leave rated documents of one grade only")
        return None
    lists = [np.frombuffer(r.buckets, np.int32) for r in found]
    return OrdinalModel.fit(np.concatenate(lists), np.array([len(x) for x in lists]), grades)


_ADDED = ("expected_grade", "tail_probability", "keep")


@tidy
def _scored(rows: Iterator[pa.RecordBatch], text: str, model: OrdinalModel | None, least: float, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch, data, off in slices(rows, text):
        n = batch.num_rows
        if model is None:
            added = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n)]
        else:
            tails = model.tails(*features(data, off))
            added = [pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])


def classify(docs: DataFrame, model: OrdinalModel | None, text: str = "text", least: float = 0.5, names: tuple[str, str, str] = _ADDED) -> DataFrame:
    """`docs` with three columns more, by default expected_grade, tail_probability (of the highest grade) and keep.

    keep says that the tail probability is at least `least`. Null texts are
    scored like empty ones. Without a model the scores are null and all is
    kept. Input columns named like the added ones are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in [n.lower() for n in names]))
    schema = StructType(docs.schema.fields[:]).add(names[0], "double").add(names[1], "double").add(names[2], "boolean")
    # the weights (4 MB) go to the executors as one broadcast variable
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda rows: _scored(rows, text, shared.value, least, names), schema)
