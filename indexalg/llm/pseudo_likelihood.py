"""Language-model scores by masked pseudo-likelihood.

A small network predicts each token from the tokens on both its sides: the
embeddings of two tokens before and two after, each side and distance with
embeddings of its own, are added and squashed; from that a class of tokens and
then the token within its class are predicted. A document's score is the sum of
its tokens' conditional log-probabilities, each token masked in its turn.

Tokens are lower-cased words. The most frequent words of all documents, counted
exactly, are tokens of their own; the other words share tokens by hash, and the
probability of such a word is its token's times the word's share of the token's
occurrences: (word's count) / (token's count + 1). A word not seen in training
counts as 1, so it is never likelier than a rare word that was seen. So every
distinct word has a probability of its own at any size of the corpus; what is
bounded is the words with embeddings of their own (TOKENS - RARE): as context,
the words that share a token are alike. Counts also give the network's first
biases. Counts of at most KNOWN of the more frequent words go to all tasks; those
of the others stay a distributed table, to which their occurrences are joined,
and the logarithms are summed per document.

Training, in numpy, covers every word once. Documents are turned into tokens and
dealt to trainers by a hash of their keys and words, in ROUNDS parts; in each
round every trainer starts from the last round's model, passes once over its
documents in order of that hash by Adagrad, and the trainers' models are averaged
in proportion to their words by a tree of tasks. The number of trainers follows
from the number of words (WORDS each), not from how the table is split into
tasks, and so does the model, but for the rounding of averages. No task or driver
holds more than one model, some thousand counts and FAN models at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import NewFile, RangeReader
from .shared import cut, fresh_folder, join_hot
from .tidy import keep_memory, tidy
from .words import SPACED, mix, slices, words_of

CLASSES = MEMBERS = 64
TOKENS = CLASSES * MEMBERS
#: Tokens shared by all words that have none of their own.
RARE = 256
#: Words whose counts every task holds (16 bytes each).
KNOWN = 1 << 18
EDGE = TOKENS  # beyond a document's ends
OFFSETS = (-2, -1, 1, 2)
WIDTH = 32
#: Tokens in a step of training; Adagrad's rate and first sum of squares.
BATCH, RATE, FIRST = 1 << 12, 0.15, 1.0
#: Parts of the documents between which models are averaged; words of a trainer in a round, about.
ROUNDS, WORDS = 3, 1_000_000
#: Up to so many trainers each has a task, beyond a task has so many trainers.
FEW_TRAINERS, TRAINERS_OF_TASK = 256, 8
#: Tokens of a document that travel in one row.
PIECE = 1 << 16
#: Tokens put into random order together.
SHUFFLED = 1 << 17
#: Models averaged by one task.
FAN = 8
#: Distinct words a task counts before it hands the counts on.
COUNTED = 1_000_000
#: Tokens scored at once.
CHUNK = 1 << 12
#: Rows of a run that are added one after the other; at most 255.
RUN = 16


class Network:
    """Weights, as float32 arrays by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def new(share: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; biases that give each token its share."""
        r = np.random.default_rng(seed)
        share = (share + 1e-9).reshape(CLASSES, MEMBERS)
        share = share / share.sum()
        of_class = share.sum(1)
        w = {
            "embed": r.normal(0, 0.1, (len(OFFSETS), TOKENS + 1, WIDTH)),
            "hidden_bias": np.zeros(WIDTH),
            "to_class": r.normal(0, 0.05, (WIDTH, CLASSES)),
            "class_bias": np.log(of_class),
            "to_member": r.normal(0, 0.05, (CLASSES, WIDTH, MEMBERS)),
            "member_bias": np.log(share / of_class[:, None]),
        }
        return Network({k: v.astype(np.float32) for k, v in w.items()})

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.w["embed"][0].take(context[0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += self.w["embed"][k].take(context[k], axis=0)
        h += self.w["hidden_bias"]
        return np.tanh(h, out=h)

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given its context, one row of `context` per offset."""
        order = _order(token)
        token = token[order].astype(np.int64)
        h = self._hidden(_picked(context, order))
        group, member, each = token // MEMBERS, token % MEMBERS, np.arange(len(token))
        z = h @ self.w["to_class"]
        z += self.w["class_bias"]
        found = z[each, group]
        found -= _log_sum(z)
        end = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        for c in range(CLASSES):
            if end[c] < end[c + 1]:
                np.matmul(h[end[c] : end[c + 1]], self.w["to_member"][c], out=z[end[c] : end[c + 1]])
        z += self.w["member_bias"].take(group, axis=0)
        found += z[each, member]
        found -= _log_sum(z)
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, context: np.ndarray, token: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        """One Adagrad step on tokens in ascending order; `sums` holds the sums of squared gradients."""
        w = self.w
        h = self._hidden(context)
        token = token.astype(np.int64)
        group, member, each, ones = token // MEMBERS, token % MEMBERS, np.arange(len(token)), np.ones(len(token), np.float32)
        z = h @ w["to_class"]
        z += w["class_bias"]
        p = _shares(z)
        p[each, group] -= 1
        back = p @ w["to_class"].T
        grad = {"to_class": h.T @ p, "class_bias": ones @ p, "to_member": np.zeros_like(w["to_member"]), "member_bias": np.zeros_like(w["member_bias"])}
        # the tokens are in order, so those of a class lie together
        end = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        own = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(end[:-1], end[1:], strict=True)) if lo < hi]
        for c, of in own:
            np.matmul(h[of], w["to_member"][c], out=z[of])
        z += w["member_bias"].take(group, axis=0)
        p = _shares(z)
        p[each, member] -= 1
        of_member = np.empty_like(back)
        for c, of in own:
            np.matmul(p[of], w["to_member"][c].T, out=of_member[of])
            np.matmul(h[of].T, p[of], out=grad["to_member"][c])
            np.matmul(ones[of], p[of], out=grad["member_bias"][c])
        back += of_member
        h *= h
        back *= np.subtract(1, h, out=h)
        grad["hidden_bias"] = ones @ back
        for k, g in grad.items():
            square = g * g
            sums[k] += square
            g *= RATE
            g /= np.sqrt(sums[k], out=square)
            w[k] -= g
        # the embeddings of all offsets as one table, of which a step sees few rows
        embed, squares = w["embed"].reshape(-1, WIDTH), sums["embed"].reshape(-1, WIDTH)
        rows, g = _embed_gradient(context, back)
        square = g * g
        square += squares.take(rows, axis=0)
        squares[rows] = square
        g *= RATE
        g /= np.sqrt(square, out=square)
        embed[rows] = np.subtract(embed.take(rows, axis=0), g, out=g)


def _picked(context: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The columns `which`; all neighbours of a token are copied at once where they lie together."""
    return context.T.take(which, axis=0).T


def _embed_gradient(context: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of the embeddings of all offsets that `context` names, of each the sum of the rows of `back` of the tokens that name it)."""
    key = (context + _OFFSET_ROWS).astype(np.uint16).ravel()
    order = _order(key)
    key = key[order]
    begin = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    by, total = _run_sums(back, order % context.shape[1], begin)
    return key[begin[by]].astype(np.int64), total


_OFFSET_ROWS = np.arange(len(OFFSETS), dtype=np.int32)[:, None] * (TOKENS + 1)


def _run_sums(table: np.ndarray, of: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs in another order, of each the sum of the rows of `table` that `of` names from the run's begin to the next).

    Runs of up to RUN rows are summed side by side, the longest first, so that
    those with an r-th row are always a prefix; longer ones are cut into such,
    whose sums are summed in their turn.
    """
    count = np.diff(begin, append=len(of))
    if count.max() > RUN:
        parts = -(-count // RUN)
        first = np.cumsum(parts) - parts
        by, sums = _run_sums(table, of, np.repeat(begin, parts) + RUN * (np.arange(parts.sum()) - np.repeat(first, parts)))
        at = np.empty_like(by)
        at[by] = np.arange(len(by))
        return _run_sums(sums, at, first)
    by = np.argsort((RUN - count).astype(np.uint8), kind="stable")
    begin = begin[by]
    total = table.take(of[begin], axis=0)
    for r, runs in enumerate((len(count) - np.cumsum(np.bincount(count)))[1:-1].tolist(), 1):
        total[:runs] += table.take(of[begin[:runs] + r], axis=0)
    return by, total


def _order(tokens: np.ndarray) -> np.ndarray:
    """Of tokens in ascending order; 16 bits are sorted by radix."""
    return np.argsort(tokens.astype(np.uint16), kind="stable")


def _powers(z: np.ndarray) -> np.ndarray | float:
    """Overwrites `z` by its exponentials, those of each row but for a factor; returns that factor's logarithm."""
    top = 0.0
    if not (-60 < z.min(initial=0) and z.max(initial=0) < 60):
        top = z.max(1)
        z -= top[:, None]
    np.exp(z, out=z)
    return top


def _shares(z: np.ndarray) -> np.ndarray:
    """The probabilities of each row's logits; overwrites `z`."""
    _powers(z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Overwrites `z`."""
    top = _powers(z)
    return top + np.log(z @ np.ones(z.shape[1], z.dtype))


class Vocabulary:
    """Tokens of word hashes: the frequent words' own, in order of frequency, then RARE shared ones."""

    def __init__(self, frequent: np.ndarray):
        #: Of each shared token, how often its words occur.
        self.totals = np.zeros(RARE)
        self.know(frequent[:0], np.zeros(0, np.int64), 0)
        self.frequent = frequent
        # the most frequent word that ends in these 16 bits, and after each word the next that ends in the same
        self.slot, self.next = np.full(1 << 16, -1, np.int16), np.full(len(frequent), -1, np.int16)
        for k, at in reversed(list(enumerate((frequent & np.uint64(0xFFFF)).tolist()))):
            self.next[k], self.slot[at] = self.slot[at], k

    def know(self, words: np.ndarray, n: np.ndarray, least: int) -> None:
        """Takes in all words that occur `least` times or more."""
        order = np.argsort(words)
        self.known, self.logs, self.least = words[order], np.log(n[order]), least

    def log_counts(self, words: np.ndarray) -> np.ndarray:
        """Logarithms of the words' counts; nan for words that occur fewer than `least` times."""
        out = np.full(len(words), np.nan)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            ok = self.known[at] == words
            out[ok] = self.logs[at[ok]]
        return out

    def tokens(self, words: np.ndarray) -> np.ndarray:
        out = TOKENS - RARE + (mix(words) % np.uint64(RARE)).astype(np.int64)
        at = self.slot.take((words & np.uint64(0xFFFF)).astype(np.int64))
        maybe = np.flatnonzero(at >= 0)
        at = at[maybe]
        while len(maybe):
            ok = self.frequent.take(at) == words[maybe]
            out[maybe[ok]] = at[ok]
            at = self.next.take(at)
            more = ~ok & (at >= 0)
            maybe, at = maybe[more], at[more]
        return out


def contexts(tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per offset, each token's neighbour there; EDGE beyond its document. A token's neighbours lie together."""
    out = np.full((len(tokens), len(OFFSETS)), EDGE, np.int16)
    end = np.cumsum(count)
    for k, offset in enumerate(OFFSETS):
        far = abs(offset)
        if offset > 0:
            out[:-far, k] = tokens[far:]
        else:
            out[far:, k] = tokens[:-far]
        for j in range(far):  # the j-th token from an end has a neighbour of another document there
            has = count > j
            out[(end - 1 - j if offset > 0 else end - count + j)[has], k] = EDGE
    return out.T


@tidy
def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    pending, size = [], 0
    for _, data, off in slices(rows, "text"):
        pending.append(words_of(data, off, SPACED)[0])
        size += len(pending[-1])
        if size > 2 * COUNTED:
            words, n = _merged(words, n, pending)
            pending, size = [], 0
            if len(words) > COUNTED:
                yield batch()
                words, n = words[:0], n[:0]
    words, n = _merged(words, n, pending)
    yield batch()


def _merged(words: np.ndarray, n: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, k = np.unique(np.concatenate(more) if more else words[:0], return_counts=True)
    both, at = np.unique(np.concatenate((words, new)), return_inverse=True)
    return both, np.bincount(at, weights=np.concatenate((n, k)), minlength=len(both)).astype(np.int64)


@tidy
def _totals(rows: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """(shared token, occurrences of its words) of (word, n)."""
    totals = np.zeros(RARE, np.int64)
    for batch in rows:
        token = vocabulary.tokens(batch.column(0).to_numpy().view(np.uint64)) - (TOKENS - RARE)
        rare = token >= 0
        np.add.at(totals, token[rare], batch.column(1).to_numpy()[rare])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(totals)], ["token", "n"])


def _counts(folder: str) -> str:
    """Where the table of all words' counts is."""
    return f"{folder}/counts"


def _store(folder: str, what: object) -> str:
    out = NewFile(folder, ".model")
    out.write(pickle.dumps(what))
    return out.close()


def _stored(folder: str, path: str) -> object:
    source = RangeReader(folder, path)
    raw = source.read(0, source.size)
    source.close()
    return pickle.loads(raw)


@tidy
def _dealt(rows: Iterator[pa.RecordBatch], folder: str, path: str, trainers: int = 1) -> Iterator[pa.RecordBatch]:
    """(part, trainer, key, piece, lead, tail, tokens): documents in pieces, each with up to as many tokens of its neighbours as the network looks at.

    `key` is a hash of the row's id and words; a row like one before it in the
    same slice has a key of its own, so that repeated rows are dealt too.
    """
    vocabulary, _ = _stored(folder, path)
    reach = max(OFFSETS)
    for batch, data, off in slices(rows, "text"):
        words, count = words_of(data, off, SPACED)
        tokens = vocabulary.tokens(words).astype(np.int16)
        key = _keys(batch.column(0), words, count)
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        again = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        key[order] = np.where(again > 0, mix(key[order] + again.astype(np.uint64)), key[order])
        n = -(-count // PIECE)
        row = np.repeat(np.arange(len(count)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(np.cumsum(count) - count, n)
        lo, hi = begin + piece * PIECE, begin + np.minimum((piece + 1) * PIECE, np.repeat(count, n))
        lead, tail = np.minimum(lo - begin, reach), np.minimum(begin + np.repeat(count, n) - hi, reach)
        raw = [tokens[a:b].tobytes() for a, b in zip((lo - lead).tolist(), (hi + tail).tolist(), strict=True)]
        draw = (key[row] >> np.uint64(1)).astype(np.int64)
        columns = [pa.array(draw % ROUNDS, pa.int32()), pa.array(draw // ROUNDS % trainers), pa.array(key[row].view(np.int64)), pa.array(piece, pa.int32()), pa.array(lead, pa.int32()), pa.array(tail, pa.int32()), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, _DEALT)


_DEALT = ["part", "trainer", "key", "piece", "lead", "tail", "tokens"]


@tidy
def _trained(rows: Iterator[pa.RecordBatch], folder: str, path: str) -> Iterator[pa.RecordBatch]:
    """(words, average model) of the trainers whose rows of _dealt() these are, trainer by trainer."""
    keep_memory()
    _, start = _stored(folder, path)
    network, sums, waiting, size, n = Network(start), {}, [], 0, 0
    total, words = 0.0, 0

    def begin() -> None:
        nonlocal network, sums, n
        network, sums, n = Network({k: v.copy() for k, v in start.items()}), {k: np.full_like(v, FIRST) for k, v in start.items()}, 0

    def go() -> None:
        nonlocal waiting, size, n
        if size:
            n += _pass(network, sums, waiting)
        waiting, size = [], 0

    def end() -> None:
        nonlocal total, words
        go()
        if n:
            total, words = total + n * _flat(network.w).astype(np.float64), words + n

    now = None
    for batch in rows:
        trainer, lead, tail = (batch.column(k).to_numpy() for k in (1, 4, 5))
        raw = batch.column(6).cast(pa.large_binary())
        off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 2
        tokens = np.frombuffer(raw.buffers()[2], np.int16)[off[0] : off[-1]] if len(raw) else np.zeros(0, np.int16)
        off, at = off - off[0], 0
        while at < len(raw):
            if now != trainer[at]:
                end()
                begin()
                now = trainer[at]
            to = max(at + 1, int(np.searchsorted(off, off[at] + SHUFFLED, side="right")) - 1)
            to = min(to, at + int(np.searchsorted(trainer[at:], now, side="right")))
            own, count = tokens[off[at] : off[to]], np.diff(off[at : to + 1])
            context = contexts(own, count)
            if lead[at:to].any() or tail[at:to].any():
                place = np.arange(len(own)) - np.repeat(off[at:to] - off[at], count)
                target = np.flatnonzero((place >= np.repeat(lead[at:to], count)) & (place < np.repeat(count - tail[at:to], count)))
                context, own = _picked(context, target), own[target]
            waiting.append((context, own))
            size, at = size + len(own), to
            if size >= SHUFFLED:
                go()
    end()
    if words:
        yield _model_row(words, (total / words).astype(np.float32))


def _pass(network: Network, sums: dict, waiting: list) -> int:
    context, token = np.concatenate([x[0].T for x in waiting]).T, np.concatenate([x[1] for x in waiting])
    order = np.random.default_rng(len(token)).permutation(len(token))
    for lo in range(0, len(token), BATCH):
        own = order[lo : lo + BATCH]
        own = own[_order(token[own])]
        network.train(_picked(context, own), token[own], sums)
    return len(token)


_NAMES = ["embed", "hidden_bias", "to_class", "class_bias", "to_member", "member_bias"]


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _NAMES])


def _model_row(n: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "model"])


@tidy
def _averaged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in rows:
        for k, model in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(model.as_buffer(), np.float32).astype(np.float64) * k
            total, n = (own if total is None else total + own), n + k
    if n:
        yield _model_row(n, (total / n).astype(np.float32))


def _average(models: DataFrame) -> tuple[int, np.ndarray | None]:
    """(words, weights) of all trainers' models, by a tree of tasks of FAN models each."""
    left = models.count()
    while left > FAN:
        models = cut(models.repartition(-(-left // FAN)).mapInArrow(_averaged, "n long, model binary"))
        left = models.count()
    total, n = None, 0
    for r in models.orderBy("n").collect():
        own = np.frombuffer(r.model, np.float32).astype(np.float64) * r.n
        total, n = (own if total is None else total + own), n + r.n
    return n, total / n if n else None


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at, weights = 0, {}
    for k in _NAMES:
        weights[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return weights


def train_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[str, str]:
    """(folder, path) of the stored vocabulary and weights, trained on every word."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "pseudo-likelihood")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.select("text").mapInArrow(_counted, "word long, n long")
    found.groupBy("word").agg(F.sum("n").alias("n")).write.parquet(_counts(folder))
    counts = spark.read.schema("word long, n long").parquet(_counts(folder))
    top = counts.orderBy(F.desc("n"), "word").limit(TOKENS - RARE).collect()
    frequent = np.array([r.word for r in top], np.int64).view(np.uint64)
    totals = np.zeros(RARE)
    for r in counts.mapInArrow(lambda batches: _totals(batches, Vocabulary(frequent)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        totals[r.token] = r.n
    share = np.zeros(TOKENS)
    share[: len(top)] = [r.n for r in top]
    share[TOKENS - RARE :] = np.maximum(totals, 1 / RARE)
    vocabulary, weights = Vocabulary(frequent), Network.new(share).w
    vocabulary.totals = totals
    level = F.floor(F.log2("n"))
    levels = {r.level: r.words for r in counts.where("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    least = min((k for k in [*levels, 62] if sum(m for x, m in levels.items() if x >= k) <= KNOWN))
    known = counts.where(level >= least).toArrow().combine_chunks()
    vocabulary.know(known["word"].to_numpy().view(np.uint64), known["n"].to_numpy(), 1 << least)
    path = _store(folder, (vocabulary, weights))
    words = int(totals.sum() + sum(r.n for r in top))
    trainers = max(1, -(-words // (ROUNDS * WORDS)))
    # a task may train several, and hands on their average; how many does not change the model
    tasks = 4 * trainers if trainers <= FEW_TRAINERS else max(4 * FEW_TRAINERS, trainers // TRAINERS_OF_TASK)
    dealt = f"{folder}/tokens"
    schema = "part int, trainer long, key long, piece int, lead int, tail int, tokens binary"
    rows.mapInArrow(lambda batches, path=path: _dealt(batches, folder, path, trainers), schema).write.partitionBy("part").parquet(dealt)
    for part in range(ROUNDS if words else 0):
        own = spark.read.schema(schema).parquet(dealt).where(F.col("part") == part).select(*_DEALT).repartition(tasks, "trainer").sortWithinPartitions("trainer", "key", "piece")
        models = cut(own.mapInArrow(lambda batches, path=path: _trained(batches, folder, path), "n long, model binary"))
        n, flat = _average(models)
        if n:
            weights = _shaped(flat, weights)
            path = _store(folder, (vocabulary, weights))
    return folder, path


def _keys(ids: pa.Array, words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each row's id and words; rows with the same have the same score."""
    ids = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).view(np.uint64)
    within = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + mix(within.astype(np.uint64))), dtype=np.uint64)))
    end = np.cumsum(count)
    return mix(mix(ids + np.uint64(1)) + total[end] - total[end - count])


_SCORED = ["doc_id", "key", "n_tokens", "score", "word"]


@tidy
def _scored(rows: Iterator[pa.RecordBatch], folder: str, path: str) -> Iterator[pa.RecordBatch]:
    """For each row (doc_id, key, n_tokens, score), and for each occurrence of a word without a token of its own whose count is not at hand (key, word)."""
    keep_memory()
    vocabulary, weights = _stored(folder, path)
    network = Network(weights)
    # the part of a rare word's logarithm that its token tells; the word's count is joined
    shared = np.concatenate((np.zeros(TOKENS - RARE), -np.log(vocabulary.totals + 1)))
    for batch, data, off in slices(rows, "text"):
        words, count = words_of(data, off, SPACED)
        tokens = vocabulary.tokens(words)
        context = contexts(tokens, count)
        each = np.zeros(len(tokens))
        for lo in range(0, len(tokens), CHUNK):
            each[lo : lo + CHUNK] = network.log_probabilities(context[:, lo : lo + CHUNK], tokens[lo : lo + CHUNK])
        each += shared[tokens]
        rare = np.flatnonzero(tokens >= TOKENS - RARE)
        logs = vocabulary.log_counts(words[rare])
        each[rare] += np.nan_to_num(logs)
        total = np.concatenate(([0.0], np.cumsum(each)))
        end = np.cumsum(count)
        score = np.where(count > 0, total[end] - total[end - count], 0.0)
        key = _keys(batch.column(0), words, count).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array(count), pa.array(score), pa.nulls(len(count), pa.int64())], _SCORED)
        asked = rare[np.isnan(logs)]
        none = [pa.nulls(len(asked), kind) for kind in (pa.int64(), pa.int64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([none[0], pa.array(np.repeat(key, count)[asked]), *none[1:], pa.array(words[asked].view(np.int64))], _SCORED)


def pseudo_likelihoods(docs: DataFrame, model: tuple[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, log_likelihood, mean_log_probability.

    The model is trained on `docs` unless given. log_likelihood sums the natural
    logarithms of each word's probability given its neighbours. Null and empty
    texts have no tokens, 0 and a null mean. Keys may be null or repeat; other
    columns are ignored; an empty table gives no rows.
    """
    folder, path = model or train_model(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = docs.sparkSession.read.schema("word long, n long").parquet(_counts(folder)).where((F.col("n") > 1) & (F.col("n") < _stored(folder, path)[0].least))
    found = cut(rows.mapInArrow(lambda batches: _scored(batches, folder, path), "doc_id long, key long, n_tokens long, score double, word long"))
    scored, rare = found.where("n_tokens IS NOT NULL").drop("word"), found.where("n_tokens IS NULL").select("word", "key")
    # words that occur once, and unseen ones, add log 1; repeated rows share a key, whose sum is then theirs together
    known = rare.join(counts, "word").groupBy("key").agg(F.sum(F.log("n")).alias("logs"))
    copies = scored.groupBy("key").agg(F.count("*").alias("copies"))
    logs = cut(known.join(copies, "key").select("key", (F.col("logs") / F.col("copies")).alias("logs")))
    likelihood = F.when(F.col("n_tokens") > 0, F.col("score") + F.coalesce("logs", F.lit(0.0))).otherwise(0.0)
    out = join_hot(scored, logs, ["key"], "left").select("doc_id", "n_tokens", likelihood.alias("log_likelihood"))
    return out.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
