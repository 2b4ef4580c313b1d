"""Scores against a plain computation, and against predicting by frequency alone."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from indexalg.llm import pseudo_likelihood as M
from indexalg.llm.words import SPACED, text_buffers, words_of


def made_up(seed, n):
    """Every second word is told by the one before it."""
    r = random.Random(seed)
    return [(i, " ".join(w for _ in range(r.choice([1, 20, 150])) for k in [r.randrange(40)] for w in (f"a{k}", f"b{k}"))) for i in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(made_up(1, 900), "doc_id long, text string").repartition(3)
    return M.train_model(docs)


def mean(spark, model, rows):
    got = M.pseudo_likelihoods(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    return sum(r.log_likelihood for r in got) / sum(r.n_tokens for r in got)


def test_context_helps_on_held_out_text(spark, trained):
    assert mean(spark, trained, made_up(2, 100)) > -math.log(80) + 0.3


def test_against_a_plain_computation(spark, trained):
    vocabulary, w = M._stored(*trained)
    text = "a1 b1 a2 never-seen b2"
    tokens = vocabulary.tokens(words_of(*text_buffers(pa.array([text])), SPACED)[0]).tolist()
    total = 0.0
    for i, t in enumerate(tokens):
        h = w["hidden_bias"].astype(float)
        for k, o in enumerate(M.OFFSETS):
            h = h + w["embed"][k][tokens[i + o] if 0 <= i + o < len(tokens) else M.EDGE]
        h = np.tanh(h)
        z = h @ w["to_class"] + w["class_bias"]
        c, m = divmod(t, M.MEMBERS)
        y = h @ w["to_member"][c] + w["member_bias"][c]
        total += z[c] - np.log(np.exp(z).sum()) + y[m] - np.log(np.exp(y).sum())
    got = M.pseudo_likelihoods(spark.createDataFrame([(1, text)], "doc_id long, text string"), trained).first()
    assert got.n_tokens == 5 and got.log_likelihood == pytest.approx(total, abs=1e-3) and got.mean_log_probability == pytest.approx(total / 5, abs=1e-3)


def test_probabilities_sum_to_one(trained):
    _, w = M._stored(*trained)
    context = np.full((len(M.OFFSETS), M.TOKENS), 3)
    assert np.exp(M.Network(w).log_probabilities(context, np.arange(M.TOKENS)).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def plain_step(network, context, token, sums):
    """An Adagrad step whose embeddings' gradients are scattered over whole tables, number by number."""
    w, h = network.w, network._hidden(context)
    group, member, each = token // M.MEMBERS, token % M.MEMBERS, np.arange(len(token))
    p = M._shares(h @ w["to_class"] + w["class_bias"])
    p[each, group] -= 1
    back = p @ w["to_class"].T
    grad = {k: np.zeros_like(v) for k, v in w.items() if "member" in k} | {"to_class": h.T @ p, "class_bias": p.sum(0)}
    end = np.searchsorted(group, np.arange(M.CLASSES + 1)).tolist()
    own = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(end[:-1], end[1:], strict=True)) if lo < hi]
    z = w["member_bias"].take(group, axis=0)
    for c, of in own:
        z[of] += h[of] @ w["to_member"][c]
    p = M._shares(z)
    p[each, member] -= 1
    for c, of in own:
        back[of] += p[of] @ w["to_member"][c].T
        np.matmul(h[of].T, p[of], out=grad["to_member"][c])
    grad["member_bias"][[c for c, _ in own]] = np.add.reduceat(p, [of.start for _, of in own], axis=0)
    back *= 1 - h * h
    grad["hidden_bias"] = back.sum(0)
    for k, g in grad.items():
        sums[k] += g * g
        g *= M.RATE
        g /= np.sqrt(sums[k])
        w[k] -= g
    for k in range(len(M.OFFSETS)):
        rows = np.flatnonzero(np.bincount(context[k], minlength=M.TOKENS + 1))
        at = (context[k][:, None] * M.WIDTH + np.arange(M.WIDTH)).ravel()
        g = np.bincount(at, weights=back.ravel(), minlength=(M.TOKENS + 1) * M.WIDTH)
        g = g.reshape(-1, M.WIDTH).take(rows, axis=0).astype(np.float32)
        total = sums["embed"][k].take(rows, axis=0) + g * g
        sums["embed"][k][rows] = total
        w["embed"][k][rows] -= M.RATE * g / np.sqrt(total)


def steps_of(n, batch, seed=8):
    """Batches of (context, token), tokens in ascending order, of which few are frequent and many rare."""
    r = np.random.default_rng(seed)
    for _ in range(n):
        token = np.sort((M.TOKENS * r.random(batch) ** 4).astype(np.int64))
        context = (M.TOKENS * r.random((len(M.OFFSETS), batch)) ** 4).astype(np.int64)
        context[r.random(context.shape) < 0.05] = M.EDGE
        yield context, token


def fresh():
    network = M.Network.new(np.ones(M.TOKENS))
    return network, {k: np.full_like(v, M.FIRST) for k, v in network.w.items()}


@pytest.mark.parametrize("batch", [1, 2, 300, M.BATCH])
def test_a_step_against_a_plain_one(batch):
    (one, its), (other, others) = fresh(), fresh()
    for context, token in steps_of(4, batch):
        one.train(context, token, its)
        plain_step(other, context, token, others)
    for k in one.w:
        assert np.allclose(one.w[k], other.w[k], atol=1e-4) and np.allclose(its[k], others[k], rtol=1e-3, atol=1e-4)


def test_a_step_takes_less_time_than_a_plain_one():
    steps = list(steps_of(4, M.BATCH))

    def share():
        took = {M.Network.train: [], plain_step: []}
        for _ in range(7):
            for step, seconds in took.items():
                network, sums = fresh()
                began = time.thread_time()
                for context, token in steps:
                    step(network, context, token, sums)
                seconds.append(time.thread_time() - began)
        return min(took[M.Network.train]) / min(took[plain_step])

    assert any(share() < 0.9 for _ in range(3))  # other load may disturb one of them


def test_neighbours_end_with_their_document():
    r = random.Random(9)
    for count in ([0], [1], [0, 3, 0, 1, 2, 0], [r.randrange(6) for _ in range(200)]):
        tokens, want, at = np.array([r.randrange(M.TOKENS) for _ in range(sum(count))], np.int64), [], 0
        for n in count:
            want += [tuple(int(tokens[at + i + o]) if 0 <= i + o < n else M.EDGE for o in M.OFFSETS) for i in range(n)]
            at += n
        assert list(map(tuple, M.contexts(tokens, np.array(count)).T.tolist())) == want


def test_words_whose_hashes_end_alike_have_their_own_tokens():
    frequent = np.array([5, 5 + (1 << 16), 7, 5 + (3 << 16), 9 << 20], np.uint64)
    asked = np.array([*frequent.tolist(), 5 + (2 << 16), 8], np.uint64)
    got = M.Vocabulary(frequent).tokens(asked).tolist()
    assert got[:5] == [0, 1, 2, 3, 4] and all(M.TOKENS - M.RARE <= t < M.TOKENS for t in got[5:])


def test_counts_are_exact():
    rows = ["a b a", "", "b " * 50, "c"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])
    counted = {}
    for out in M._counted(iter([batch, batch])):
        for k, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            counted[k] = counted.get(k, 0) + n
    assert sorted(counted.values()) == [6, 12, 306]


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_every_word_is_a_training_target(spark, monkeypatch, piece):
    monkeypatch.setattr(M, "PIECE", piece)
    rows = [(1, "one two three"), (2, ""), (3, None), (4, "just four words here"), (5, "long " * 100), (5, "long " * 100), (None, "a b")]
    folder, path = M.train_model(spark.createDataFrame(rows, "doc_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    found = list(M._dealt(iter([batch]), folder, path))
    assert len({k for b in found for k in b.column(2).to_pylist()}) == 5  # the repeated row too has its own
    seen = []
    monkeypatch.setattr(M.Network, "train", lambda self, context, token, sums: seen.append((context, token)))
    assert sum(n for out in M._trained(iter(found), folder, path) for n in out.column(0).to_pylist()) == 209
    # each word with the neighbours it has in its whole document
    vocabulary, want = M._stored(folder, path)[0], Counter()
    for _, t in rows:
        words, count = words_of(*text_buffers(pa.array([t], pa.string())), SPACED)
        tokens = vocabulary.tokens(words)
        want.update(zip(map(tuple, M.contexts(tokens, count).T.tolist()), tokens.tolist(), strict=True))
    assert want == Counter(x for context, token in seen for x in zip(map(tuple, context.T.tolist()), token.tolist(), strict=True))


def test_the_model_does_not_depend_on_the_splits(spark, monkeypatch):
    monkeypatch.setattr(M, "WORDS", 5_000)
    monkeypatch.setattr(M, "FAN", 2)
    docs = spark.createDataFrame(made_up(5, 400), "doc_id long, text string")
    held = spark.createDataFrame(made_up(6, 50), "doc_id long, text string")
    scores = [sorted((r.doc_id, r.log_likelihood / r.n_tokens) for r in M.pseudo_likelihoods(held, M.train_model(docs.repartition(n))).collect()) for n in (4, 64)]
    assert all(i == j and x == pytest.approx(y, abs=1e-3) for (i, x), (j, y) in zip(*scores, strict=True))


@pytest.mark.parametrize("known", [1 << 18, 40, 0])
def test_rare_words_have_probabilities_of_their_own(spark, monkeypatch, known):
    monkeypatch.setattr(M, "KNOWN", known)
    r = random.Random(4)
    kinds = [f"w{k}" for k in range(M.TOKENS + 400)]
    rows = [(i, " ".join(kinds[int(len(kinds) * r.random() ** 2)] for _ in range(300))) for i in range(60)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (99, "")]
    counts = Counter(w for _, t in rows for w in t.split())
    model = M.train_model(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    vocabulary, w = M._stored(*model)
    network, of = M.Network(w), {}
    for word in [*counts, "never-seen"]:
        of[word] = int(vocabulary.tokens(words_of(*text_buffers(pa.array([word])), SPACED)[0])[0])
    totals = Counter()
    for word, n in counts.items():
        totals[of[word]] += n
    rare = [word for word in counts if of[word] >= M.TOKENS - M.RARE]
    assert rare and all(vocabulary.totals[t - M.TOKENS + M.RARE] == totals[t] for t in map(of.get, rare))

    def plain(text):
        tokens = np.array([of[word] for word in text.split()], np.int64)
        found = network.log_probabilities(M.contexts(tokens, np.array([len(tokens)])), tokens).astype(float).sum() if len(tokens) else 0.0
        return found + sum(math.log(max(counts[word], 1) / (totals[of[word]] + 1)) for word in text.split() if of[word] >= M.TOKENS - M.RARE)

    asked = [*rows, (100, " ".join(["never-seen", *rare[:50], rare[0]]))]
    got = M.pseudo_likelihoods(spark.createDataFrame(asked, "doc_id long, text string").repartition(5), model).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    for (i, x), (j, y) in zip(sorted(((r.doc_id, r.log_likelihood) for r in got), key=key), sorted(((i, plain(t)) for i, t in asked), key=key), strict=True):
        assert i == j and x == pytest.approx(y, abs=1e-2)


def test_averaging_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN", 2)
    docs = spark.createDataFrame(made_up(3, 120), "doc_id long, text string").repartition(7)
    folder, path = M.train_model(docs)
    assert M._stored(folder, path)[1]["embed"].shape == (len(M.OFFSETS), M.TOKENS + 1, M.WIDTH)


def test_odd_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, " \n", "c"), (None, "word", "c"), (5, "same words", "c"), (5, "same words", "c"), (6, "long " * 70_000, "c")]
    got = M.pseudo_likelihoods(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 0), (5, 2), (5, 2), (6, 70_000)]
    assert all((r.mean_log_probability is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in got)
    assert M.pseudo_likelihoods(spark.createDataFrame([], "doc_id long, text string")).count() == 0
