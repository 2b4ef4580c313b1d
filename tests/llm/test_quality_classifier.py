"""Held-out accuracy on made-up ratings, ordered probabilities, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from indexalg.llm import quality_classifier as M
from indexalg.llm.quality_classifier import OrdinalModel, classify, features, fit_classifier, rated
from indexalg.llm.words import text_buffers


def made_up(seed, n):
    """(doc_id, text, grade): 0 with bad words in it, 1 full of signs, 2 plain."""
    r, rows = random.Random(seed), []
    plain = [f"word{k}" for k in range(300)]
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.choice([10, 40, 200]))]
        g = r.choices([0, 1, 2], [2, 2, 6])[0]
        if g == 0:
            for _ in range(2):
                words[r.randrange(len(words))] = r.choice(["nasty", "vileone", "viletwo"])
        elif g == 1:
            words = [w + r.choice(["$$$", "***", "&&&"]) for w in words]
        rows.append((i, " ".join(words), g))
    return rows


def test_held_out_accuracy(spark):
    rows = made_up(1, 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = fit_classifier(docs, docs.where("doc_id < 1000").select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    got = classify(docs.where("doc_id >= 1000"), model).collect()
    assert np.mean([r.keep == (r.grade == 2) for r in got]) > 0.97
    mean = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2] and all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in got)


def test_tails_are_ordered_and_match_the_formula():
    w = np.zeros(1 << 20, np.float32)
    buckets, each = features(*text_buffers(pa.array(["some words here", "others"])))
    w[buckets[: each[0]]] = 0.25
    model = OrdinalModel(w, np.array([-1.0, 2.0]))
    score = w[buckets[: each[0]]].sum()
    assert np.allclose(model.tails(buckets, each)[0], [1 / (1 + np.exp(-(score + 1))), 1 / (1 + np.exp(-(score - 2)))])


MASK = 2**64 - 1


def scrambled(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def plain_features(text):
    """Features of one text, byte by byte."""
    raw = (text or "").encode()
    low = raw.lower()
    words, word = [], b""
    for c in [*low, 32]:
        if chr(c).isascii() and not chr(c).isalnum():
            words, word = (words + [word] if word else words), b""
        else:
            word += bytes([c])

    def summed(w):
        return sum(int(M._BYTE[c]) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, c in enumerate(w)) & MASK

    bucket = lambda x: x & (M.BUCKETS - 1)
    distinct = {bucket(scrambled(summed(w))) for w in words}
    out = set(distinct)
    for k, size in enumerate(M.STEMS, 1):
        out |= {bucket(scrambled((summed(w[:size]) + int(M._SEED[k])) & MASK)) for w in words if len(w) > size}
    n, shapes = len(words), []
    band = lambda x: int((x * 144) ** 0.5)
    for test in (lambda c: M._SIGN[c], lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c == 124):
        hits = [int(test(c)) for c in raw]
        shapes.append(band(sum(hits) / max(len(raw), 1)))
        blocks = [sum(hits[k : k + M.BLOCK]) / min(M.BLOCK, max(len(raw), 64)) for k in range(0, len(raw), M.BLOCK)]
        shapes.append(band(min(max(blocks, default=0), 1)))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shapes += [int(min(len(distinct) / max(n, 1) * 20, 20)), band(again / max(n, 1)), int(min(len(raw) / max(n, 1), 39)), int(np.log2(n + 1))]
    for k, shape in enumerate(shapes, 1):
        out |= {bucket(scrambled(level + 1000 * k)) for level in range(shape + 1)}
    return sorted(out)


@pytest.mark.parametrize("piece", [1 << 20, 1000, 16, 1])
def test_features_against_plain_loops(monkeypatch, piece):
    monkeypatch.setattr(M, "_PIECE", piece)
    rows = ["Abc def $$ abc 12 | x", "", None, "é" * 300 + " abcdefgh", "abc " * 200, "x" * 3000, *(t for _, t, _ in made_up(5, 25))]
    buckets, each = features(*text_buffers(pa.array(rows)))
    end = np.cumsum(each)
    assert [buckets[e - n : e].tolist() for e, n in zip(end, each, strict=True)] == [plain_features(t) for t in rows]


def test_a_fit_against_plain_loops(monkeypatch):
    monkeypatch.setattr(M, "EPOCHS", 2)
    rows = made_up(6, 60)
    buckets, each = features(*text_buffers(pa.array([t for _, t, _ in rows])))
    grades = np.array([g for *_, g in rows])
    got = OrdinalModel.fit(buckets, each, grades)
    end = np.cumsum(each).tolist()
    texts = [buckets[e - n : e].tolist() for e, n in zip(end, each.tolist(), strict=True)]
    s = lambda x: 1 / (1 + np.exp(-x))
    top = M.GRADES - 1
    share = [np.mean(grades > k) for k in range(top)]
    bounds = [-np.log(x / (1 - x)) for x in share]
    bounds = [max(x + 1e-3 * k for k, x in enumerate(bounds[: j + 1])) if j else bounds[0] for j in range(top)]
    w, z, q, q_t, r, least = {}, {}, {}, [1e-3] * top, np.random.default_rng(1), M.SPARSE * len(rows) ** 0.5
    for _ in range(2):
        order = r.permutation(len(rows)).tolist()
        for lo in range(0, len(order), M.BATCH):
            own, pull, grad_t = order[lo : lo + M.BATCH], {}, [0.0] * top
            for i in own:
                eta, y = sum(w.get(b, 0.0) for b in texts[i]), int(grades[i])
                low = s(eta - bounds[y - 1]) if y else 1.0
                high = s(eta - bounds[y]) if y < top else 0.0
                p = max(low - high, 1e-9)
                d_low, d_high = (low * (1 - low) / p if y else 0.0), (high * (1 - high) / p if y < top else 0.0)
                if y:
                    grad_t[y - 1] += d_low / len(own)
                if y < top:
                    grad_t[y] -= d_high / len(own)
                for b in texts[i]:
                    pull[b] = pull.get(b, 0.0) - (d_low - d_high)
            for b, g in pull.items():
                new = q.get(b, 0.0) + g * g
                z[b] = z.get(b, 0.0) + g - (new**0.5 - q.get(b, 0.0) ** 0.5) / M.RATE * w.get(b, 0.0)
                q[b] = new
                w[b] = -(z[b] - np.sign(z[b]) * least) / ((1 + new**0.5) / M.RATE) if abs(z[b]) > least else 0.0
            for k in range(top):
                q_t[k] += grad_t[k] ** 2
                bounds[k] -= 0.1 * grad_t[k] / q_t[k] ** 0.5
            bounds = [max(bounds[: k + 1]) + 1e-9 * k for k in range(top)]
    want = np.zeros(M.BUCKETS)
    want[list(w)] = list(w.values())
    assert np.count_nonzero(want) > 20 and np.allclose(got.weights, want, atol=1e-5) and np.allclose(got.thresholds, bounds, atol=1e-6)


def test_bounds_leave_out_single_texts_and_never_keep_all(spark):
    rows = made_up(7, 120)
    docs = spark.createDataFrame([*rows, (1000, "nasty " * 60_000, 0), (1001, "long " * 60_000, 2)], "doc_id long, text string, grade int")
    ratings = docs.select("doc_id", "grade")
    model = fit_classifier(docs, ratings, most_bytes=50_000)
    plain = fit_classifier(docs.where("doc_id < 1000"), ratings)
    assert np.array_equal(model.weights, plain.weights)
    assert fit_classifier(docs, ratings, most_rated=60) is not None
    with pytest.raises(ValueError):
        fit_classifier(docs, ratings, most_bytes=1)
    assert fit_classifier(docs, ratings.where("grade = 2")) is None


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "", 1, "x"), (2, "", 1, "x"), (None, "word1 nasty", 0, "x"), (5, "long " * 60_000, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep int, note string")
    model = fit_classifier(spark.createDataFrame(made_up(2, 200), "doc_id long, text string, grade int"), spark.createDataFrame([(i, g) for i, _, g in made_up(2, 200)], "doc_id long, grade int"))
    got = classify(docs, model).collect()
    assert len(got) == 5 and all(r.keep in (True, False) and r.note == "x" for r in got)
    assert classify(docs.limit(0), model).count() == 0
    none = fit_classifier(docs, spark.createDataFrame([(None, 1), (2, None)], "doc_id long, grade int"))
    assert none is None and all(r.keep and r.expected_grade is None for r in classify(docs, none).collect())
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in rated(labels).collect() if r.grade is not None) == [(1, 0), (2, 1), (3, 2)]
