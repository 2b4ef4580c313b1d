"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles. Two sets A and B link when
|A & B| >= t * |A | B|, that is when d = |A ^ B| <= r * (|A| + |B|) with
r = (1 - t) / (1 + t).

Signatures. The shingle domain (64-bit hashes) is partitioned by hash prefix,
finer where a set is dense. Summed over the parts of any partition, d stays
below r * (a + b); so of the parts of a linked pair some non-empty one keeps
its own d <= r * (a + b), and so on below it. Following those parts down, both
sets arrive at a part where both have few elements: at most C = ceil(1/r) - 1
(8 for t = 0.8), where at most one element differs. There

* parts so small that no element may differ (1 to 3 for t = 0.8) give one
  signature of the whole part;
* larger parts are dealt into three sub-parts by a second hash, and each of
  the three subsets of two sub-parts gives one signature: the differing
  element lies in one sub-part, the other two agree. If they are empty, all
  elements lie in one sub-part; then the part gives its whole and every
  leave-one-out subset.

A part whose size lies at the edge of the size band (8 for t = 0.8), where the
partner may be large enough to be cut further, signs as it is and is cut
further too, as sets at the edge of a size band sign in both bands. So every
linked pair shares a signature: candidates are complete, by construction.

Candidates are then checked exactly, without writing out all pairs of a bucket:
first every member against its bucket's smallest document, which joins large
groups of near copies; then, in buckets that still hold several components, all
pairs of different components, in blocks, sifted by parity sketches (the
sketches of two sets differ in at most d bits, so sifting loses nothing). These
have at least two bits an element: a sketch of fixed size would let pass all
pairs of large sets. Of buckets with the same members one is compared, and
blocks are dealt into groups that are sent each document's sketch once and give
each pair that is left once. Where
all links are asked for, not only the classes they make, every pair of different
sets in a bucket is compared so: the links of a class of n sets may be n * n / 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import batches_of, cut, drop_shuffles, join_hot, unused
from .tidy import tidy
from .words import SPACED, U, mix, shingles_of, slices, words_of

SKETCH_WORDS = 8
#: Members of a bucket that are compared in one block.
BLOCK = 2048
#: Blocks are dealt into so many groups a shuffle partition, and more where a group would have more than GROUP_ROWS rows.
GROUPS, GROUP_ROWS = 4, 20_000
#: Pairs of a group that are kept before they are sifted.
KEPT_PAIRS = 1 << 21
#: Pairs that go to a worker at once, each with two whole sets.
PAIR_ROWS = 256
#: So many ids (16 bytes each) of documents to be checked are broadcast; more are joined by sort and merge, which moves all texts.
BROADCAST_IDS = 2_000_000
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_SET_SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, " + ", ".join(f"{s} long" for s in _SKETCH)


def _sums(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Wrapping sums of consecutive runs, empty runs included."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
    end = np.cumsum(each)
    return total[end] - total[end - each]


def sketches(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Per set, the parity of its elements in each of 512 bins, as 8 64-bit words."""
    bins = (mix(values ^ U(0x5BD1E995)) & U(64 * SKETCH_WORDS - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(each)), each)
    count = np.bincount(row * 64 * SKETCH_WORDS + bins, minlength=len(each) * 64 * SKETCH_WORDS)
    return np.packbits((count & 1).astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view(U).reshape(len(each), SKETCH_WORDS)


def _leading(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common leading bits of pairs."""
    y = a ^ b
    out = np.full(len(y), 64, np.int64)
    some = y > 0
    # frexp is exact here but for values that round up to the next power of two
    high = np.frexp((y[some] >> U(1)).astype(np.float64))[1].astype(np.int64)
    over = (high > 0) & ((y[some] >> U(1)) >> np.maximum(high - 1, 0).astype(U) == 0)
    out[some] = 64 - (high - over + 1)
    return out


def signatures(values: np.ndarray, each: np.ndarray, threshold: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of sets given as runs of sorted distinct hashes."""
    r = (1 - threshold) / (1 + threshold)
    most = math.ceil(1 / r - 1e-9) - 1
    edge = min(most, math.ceil(threshold * (most + 1) - 1e-9))
    whole = max(a for a in range(most + 1) if math.floor((a + math.floor(a / threshold + 1e-9)) * r + 1e-9) == 0)
    n = len(values)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(each)), each)

    def same(k: int) -> np.ndarray:
        """Common bits of each element and the k-th after it; -1 in another row."""
        out = np.full(n, -1, np.int64)
        if k < n:
            ok = row[k:] == row[: n - k]
            out[: n - k][ok] = _leading(values[: n - k][ok], values[k:][ok])
        return out

    # parts below the edge size: the first prefix length at which a part is that small
    cap = edge - 1
    window, depth = same(cap), np.full(n, -1, np.int64)
    for k in range(min(cap + 1, n)):
        depth[k:] = np.maximum(depth[k:], window[: n - k])
    depth += 1
    prefix = np.where(depth > 0, values >> (64 - np.maximum(depth, 1)).astype(U), U(0))
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (depth[1:] != depth[:-1]) | (prefix[1:] != prefix[:-1])
    start = np.flatnonzero(new)
    parts = [(start, np.diff(np.concatenate((start, [n]))), depth[start])]
    # parts of edge size or more, up to most, at every prefix length at which they are a part
    gap = same(1)
    for m in range(edge, most + 1):
        inner = same(m - 1)
        at = np.flatnonzero((inner >= 0) if m > 1 else np.ones(n, bool))
        out = np.maximum(np.where(at > 0, gap[at - 1], -1), gap[np.minimum(at + m - 1, n - 1)])
        times = np.maximum(inner[at] - out, 0)
        at = np.repeat(at, times)
        first = np.repeat(out + 1, times)
        k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        parts.append((at, np.full(len(at), m), first + k))
    start, size, depth = (np.concatenate(x) for x in zip(*parts, strict=True))
    prefix = np.where(depth > 0, values[start] >> (64 - np.maximum(depth, 1)).astype(U), U(0))
    base = mix(mix(depth.astype(U) + U(0x9E37)) + prefix)
    second = mix(values + U(0x7FEB352D))
    third = mix(second)
    deal = second % U(3)
    # the elements of all parts, part after part
    part = np.repeat(np.arange(len(start)), size)
    element = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    deal, third = deal[element], third[element]
    total = [_sums(np.where(deal == k, third, U(0)), size) for k in range(3)]
    count = [np.bincount(part[deal == k], minlength=len(start)) for k in range(3)]
    small = size <= whole
    every = total[0] + total[1] + total[2]
    sig, owner = [mix(base[small] + every[small])], [row[start[small]]]
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        ok = ~small & (count[i] + count[j] > 0)
        sig.append(mix(mix(base[ok] + U(k + 1)) + total[i][ok] + total[j][ok]))
        owner.append(row[start[ok]])
    lone = ~small & ((count[0] == size) | (count[1] == size) | (count[2] == size))
    sig.append(mix(mix(base[lone] + U(9)) + every[lone]))
    owner.append(row[start[lone]])
    of = lone[part]
    sig.append(mix(mix(base[part[of]] + U(9)) + every[part[of]] - third[of]))
    owner.append(row[start[part[of]]])
    return np.concatenate(sig), np.concatenate(owner)


def _sets(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch, data, off in slices(rows, "text"):
        yield batch, *shingles_of(*words_of(data, off, SPACED), width)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


@tidy
def _digests(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch, values, each in _sets(rows, width):
        sketch = sketches(values, each)
        columns = [batch.column(0).cast(pa.int64()), _long(each), _long(_sums(mix(values + U(1)), each)), _long(_sums(mix(values ^ U(0x1234567)), each)), *(_long(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_WORDS))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", *_SKETCH])


@tidy
def _signed(rows: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, values, each in _sets(rows, width):
        sig, owner = signatures(values, each, threshold)
        ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([_long(sig), _long(ids[owner])], ["sig", "rep"])


@tidy
def _shingle_lists(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch, values, each in _sets(rows, width):
        some = np.flatnonzero(each)
        end = np.cumsum(each)[some]
        lists = [values[e - k : e].tobytes() for e, k in zip(end.tolist(), each[some].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(some)), pa.array(lists, pa.binary())], ["rep", "shingles"])


@tidy
def _parities(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A sketch as in sketches(), but of at least two bits an element; of no empty set."""
    for batch, values, each in _sets(rows, width):
        some = np.flatnonzero(each)
        out, end = [], np.cumsum(each)[some]
        for e, k in zip(end.tolist(), each[some].tolist(), strict=True):
            bits = max(64 * SKETCH_WORDS, 1 << (2 * k - 1).bit_length())
            count = np.bincount((mix(values[e - k : e] ^ U(0x2545F491)) & U(bits - 1)).astype(np.int64), minlength=bits)
            out.append(np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(some)), _long(each[some]), pa.array(out, pa.binary())], ["rep", "n", "parity"])


@tidy
def _near(rows: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n, x, m, y) those pairs that sketches x and y don't rule out."""
    for batch in rows:
        n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        keep = []
        for k, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            while len(x) != len(y):  # fold the longer one onto fewer bins
                if len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                else:
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            if max(int(np.bitwise_count(x ^ y).sum()), abs(int(n[k]) - int(m[k]))) <= share * (n[k] + m[k]) + 1e-9:
                keep.append(k)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


@tidy
def _linked(rows: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, x, y) those pairs whose shingle lists x and y link."""
    for batch in rows:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= threshold * (len(x) + len(y) - shared):
                keep.append(k)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bins, by parity of those that fall together."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


class _Group:
    """Sketches of a group's documents, and the pairs of its blocks that they don't rule out."""

    def __init__(self, rep: list[np.ndarray], n: list[np.ndarray], sketch: list[np.ndarray], share: float):
        rep, order = np.concatenate(rep), np.argsort(np.concatenate(rep), kind="stable")
        self.rep, self.n, self.share = rep[order], np.concatenate(n)[order], share
        self.sketch = [sketch[k] for k in order.tolist()]
        self.coarse = np.stack([_folded(s, SKETCH_WORDS) for s in self.sketch], axis=1)
        self.found: list[np.ndarray] = []
        self.kept = 0

    def add(self, rep: np.ndarray, side: np.ndarray, label: np.ndarray, twice: bool) -> None:
        """Pairs of different components in a block, of unlike sides if it is of two parts of a bucket."""
        first = np.searchsorted(self.rep, rep)
        each = np.searchsorted(self.rep, rep, "right") - first  # several if texts share a doc_id
        at = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        side, label, n, m = np.repeat(side, each), np.repeat(label, each), self.n[at], len(at)
        for lo in range(0, m, 256):
            a, b = slice(lo, min(m, lo + 256)), slice(lo, m)
            ok = label[a, None] != label[None, b]
            ok &= np.arange(m)[a, None] < np.arange(m)[None, b]
            if twice:
                ok &= side[a, None] != side[None, b]
            ok &= np.abs(n[a, None] - n[None, b]) <= self.share * (n[a, None] + n[None, b]) + 1e-9
            i, j = np.nonzero(ok)
            i, j = at[i + lo], at[j + lo]
            differ = np.zeros(len(i), np.int64)
            for s in self.coarse:
                differ += np.bitwise_count(s[i] ^ s[j])
            ok = (differ <= self.share * (self.n[i] + self.n[j]) + 1e-9) & (self.rep[i] != self.rep[j])
            self.found.append(np.unique(np.minimum(i[ok], j[ok]) * len(self.rep) + np.maximum(i[ok], j[ok])))
            self.kept += len(self.found[-1])
            if self.kept > 2 * KEPT_PAIRS:
                self.found = [np.unique(np.concatenate(self.found))]
                self.kept = len(self.found[0])

    def pairs(self) -> pa.RecordBatch:
        """Those found since the last call that whole sketches don't rule out."""
        i, j = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *self.found])), len(self.rep))
        self.found, self.kept = [], 0
        size = np.array([len(s) for s in self.sketch])
        size, ok = np.minimum(size[i], size[j]), np.zeros(len(i), bool)
        for words in np.unique(size).tolist():
            at = np.flatnonzero(size == words)
            used, x = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
            sketch, (x, y) = np.stack([_folded(self.sketch[k], words) for k in used.tolist()]), np.split(x, 2)
            step = max(1, (1 << 17) // words)
            for lo in range(0, len(at), step):
                part = slice(lo, lo + step)
                differ = np.bitwise_count(sketch[x[part]] ^ sketch[y[part]]).sum(axis=1, dtype=np.int64)
                ok[at[part]] = differ <= self.share * (self.n[i[at[part]]] + self.n[j[at[part]]]) + 1e-9
        a, b = self.rep[i[ok]], self.rep[j[ok]]
        return pa.RecordBatch.from_arrays([_long(a), _long(b)], ["a", "b"])


@tidy
def _crossed(rows: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within each block that sketches don't rule out; of a group each pair once.

    Rows come in order of (part, sig, lo, hi): of each group first its
    documents' sketches, without sig, then its blocks, each of at most two
    parts of a bucket.
    """
    names = ("sig", "lo", "hi", "side", "rep", "label")
    group: _Group | None = None
    part, fresh, seen = None, ([], [], []), None

    def blocks(x: dict[str, np.ndarray]) -> None:
        cut_at = np.flatnonzero(np.concatenate(([True], (x["sig"][1:] != x["sig"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1]), [True])))
        for s, e in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True):
            if e - s > 1:
                group.add(x["rep"][s:e], x["side"][s:e], x["label"][s:e], bool(x["lo"][s] != x["hi"][s]))

    for batch in rows:
        if not batch.num_rows:
            continue
        column = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        parts = column["part"].to_numpy()
        of_sketch = column["sig"].is_null().to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.concatenate(([True], (parts[1:] != parts[:-1]) | (of_sketch[1:] != of_sketch[:-1]), [True]))).tolist()
        for s, e in zip(runs[:-1], runs[1:], strict=True):
            own = {k: v.slice(s, e - s) for k, v in column.items()}
            if parts[s] != part:
                if seen is not None:
                    blocks(seen)
                if group is not None:
                    yield group.pairs()
                part, group, seen, fresh = parts[s], None, None, ([], [], [])
            if of_sketch[s]:
                fresh[0].append(own["rep"].to_numpy())
                fresh[1].append(own["n"].to_numpy(zero_copy_only=False).astype(np.int64))
                fresh[2].extend(np.frombuffer(x, U) for x in own["parity"].to_pylist())
                continue
            if group is None:
                group = _Group(*fresh, share)
            x = {k: own[k].to_numpy(zero_copy_only=False) for k in names}
            x = x if seen is None else {k: np.concatenate((seen[k], v)) for k, v in x.items()}
            last = (x["sig"] == x["sig"][-1]) & (x["lo"] == x["lo"][-1]) & (x["hi"] == x["hi"][-1])
            first = int(np.argmax(last))
            if first:
                blocks({k: v[:first] for k, v in x.items()})
                if group.kept > KEPT_PAIRS:
                    yield group.pairs()
            seen = {k: v[first:] for k, v in x.items()}
    if seen is not None:
        blocks(seen)
    if group is not None:
        yield group.pairs()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 80, width: int = 5, all_links: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, rep; with `all_links` also n_links.

    `threshold` in percent, 50 to 99. rep is the smallest doc_id with the same
    set; n_links is the exact number of other, different sets that rep's links to.
    component_id is the smallest doc_id that links reach.

    Null and empty texts and texts without words have n_shingles 0 and their
    own doc_id. Rows that share a doc_id count as one document when linking.
    A null doc_id links with nothing and has a null component. Extra columns
    are ignored. An empty table gives no rows.
    """
    share = (100 - threshold) / (100 + threshold)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = cut(base.mapInArrow(lambda rows: _digests(rows, width), _SET_SCHEMA))
    some_sets = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cut(some_sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    one = reps.select("rep").distinct()
    # texts of representatives: all but the copies', if the copies' ids are few enough to send, else by a join that moves all texts
    copies = cut(join_hot(some_sets, reps, ["k1", "k2"]).where("doc_id <> rep").select("doc_id").distinct().join(one, F.col("doc_id") == F.col("rep"), "left_anti"))
    some = base.where("doc_id IS NOT NULL")
    own = some.join(F.broadcast(copies), "doc_id", "left_anti") if copies.count() <= BROADCAST_IDS else some.join(one, F.col("doc_id") == F.col("rep"), "left_semi")
    bucket = Window.partitionBy("sig")
    entries = cut(own.mapInArrow(lambda rows: _signed(rows, width, threshold / 100), "sig long, rep long").select("sig", "rep", F.min("rep").over(bucket).alias("pivot"), F.max("rep").over(bucket).alias("top")).where("pivot < top").drop("top").distinct())
    drop_shuffles(docs.sparkSession)
    known = sets.where("n_shingles > 0").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), *_SKETCH)
    known = cut(known.join(entries.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep", *_SKETCH]))

    def side(name: str, prefix: str) -> DataFrame:
        return known.select(F.col("rep").alias(name), F.col("n").alias(f"{prefix}n"), *(F.col(s).alias(f"{prefix}{s}") for s in _SKETCH))

    def texts(ids: DataFrame) -> DataFrame:
        return base.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("rep"), "left_semi")

    def finer(ids: DataFrame) -> DataFrame:
        return cut(texts(ids).mapInArrow(lambda rows: _parities(rows, width), "rep long, n long, parity binary"))

    def checked(pairs: DataFrame, sifted: bool = False) -> DataFrame:
        """The pairs (a, b), a table that is cut, that link by their whole shingle sets; unless `sifted`, finer sketches first, as they are a thirtieth of the sets."""

        def beside(table: DataFrame, *columns: str) -> DataFrame:
            x = table.select(F.col("rep").alias("a"), *(F.col(c).alias(f"x_{c}") for c in columns))
            y = table.select(F.col("rep").alias("b"), *(F.col(c).alias(f"y_{c}") for c in columns))
            # a group's smallest document stands in very many pairs
            left = join_hot(pairs, x, ["a"], size=f"x_{columns[-1]}")
            return join_hot(left, y, ["b"], size=f"y_{columns[-1]}", counted=pairs).select("a", "b", *(f"x_{c}" for c in columns), *(f"y_{c}" for c in columns))

        def ends() -> DataFrame:
            return cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())

        with batches_of(docs.sparkSession, PAIR_ROWS):
            if not sifted:
                pairs = cut(beside(finer(ends()), "n", "parity").mapInArrow(lambda rows: _near(rows, share), "a long, b long").distinct())
            lists = cut(texts(ends()).mapInArrow(lambda rows: _shingle_lists(rows, width), "rep long, shingles binary"))
            return cut(beside(lists, "shingles").mapInArrow(lambda rows: _linked(rows, threshold), "a long, b long").distinct())

    differ = sum((F.bit_count(F.col(f"p{s}").bitwiseXOR(F.col(f"q{s}"))) for s in _SKETCH), F.lit(0))
    if all_links:
        links, named = None, entries.select("sig", "rep", F.col("rep").alias("label"))
    else:
        star = entries.where("pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        star = join_hot(cut(star), side("a", "p"), ["a"]).join(side("b", "q"), "b").where(F.greatest(differ, F.abs(F.col("pn") - F.col("qn"))) <= share * (F.col("pn") + F.col("qn")) + 1e-9).select("a", "b").distinct()
        links = checked(cut(star))
        drop_shuffles(docs.sparkSession)
        label = components(links).withColumnRenamed("node", "rep")
        named = cut(entries.join(label, "rep", "left").select("sig", "rep", F.coalesce("component", "rep").alias("label")))
    # of buckets with the same members, told by 128 bits, one
    mixed = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("h"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("g")).where("low < high")
    mixed = cut(mixed.groupBy("h", "g", "m").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("q")))
    dealt = join_hot(named, mixed, ["sig"]).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("q")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    dealt = cut(dealt.select("sig", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rep", "label"))
    groups = max(GROUPS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // GROUP_ROWS)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("sig", "lo", "hi"), F.lit(groups)))
    sketch = dealt.select("part", "rep").distinct().join(finer(cut(dealt.select("rep").distinct())), "rep").distinct()
    rest = dealt.unionByName(sketch, allowMissingColumns=True).select("part", "sig", "lo", "hi", "side", "rep", "label", "n", "parity")
    with batches_of(docs.sparkSession, GROUP_ROWS // 10):
        rest = cut(rest.repartition("part").sortWithinPartitions("part", "sig", "lo", "hi").mapInArrow(lambda rows: _crossed(rows, share), "a long, b long").distinct())
    links = checked(rest, sifted=True) if links is None else cut(links.union(checked(rest, sifted=True)).distinct())

    label = components(links)
    group = join_hot(reps, label.withColumnRenamed("node", "rep"), ["rep"], "left")
    columns = ["doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("rep")]
    if all_links:
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        group = group.join(degree, "rep", "left")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    group = cut(group.withColumn("component", F.coalesce("component", "rep")))
    grouped = join_hot(some_sets.select("doc_id", "n_shingles", "k1", "k2"), group, ["k1", "k2"], "left").select(*columns)
    alone = sets.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("rep"))
    return grouped.unionByName(alone.withColumn("n_links", F.lit(0).cast("long")) if all_links else alone)


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 80, width: int = 5) -> DataFrame:
    """`docs` without those whose class has a smaller doc_id.

    All rows with a null doc_id stay; of rows that share a doc_id one stays.
    Input columns may have any names.
    """
    near = unused("near_id", docs.columns)
    classes = cut(jaccard_components(docs, doc_id, text, threshold, width).select(F.col("doc_id").alias(near), F.col("component_id").alias("near_first")))
    gone = classes.where(F.col("near_first") < F.col(near)).select(near).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = F.col(doc_id).cast("long") == F.col(near)
    left = docs.join(gone, same, "left_anti")
    again = cut(classes.where(F.col(near).isNotNull()).groupBy(near).agg(F.count("*").alias("rows")).where("rows > 1").select(near))
    if again.isEmpty():
        return left
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([doc_id]))
