"""FM-index and contamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from indexalg.llm import decontamination as M
from indexalg.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("n", [1, 2, 7, 60, 500])
@pytest.mark.parametrize("symbols", [1, 2, 5, 70])
def test_index(n, symbols):
    r = np.random.default_rng(n + symbols)
    text = r.integers(1, symbols + 1, n).astype(np.int32)
    if n == 500:
        text[300:420] = text[20:140]
    bits, full = max(1, int(symbols).bit_length()), [*text.tolist(), 0]
    order = suffix_order(np.array(full), bits)
    assert order.tolist() == sorted(range(n + 1), key=lambda i: full[i:])
    index = FMIndex(text, bits, 5)
    assert index.locate(np.arange(n + 1)).tolist() == order.tolist()
    patterns = np.array([full[i : i + 3] for i in range(max(0, n - 3))] + r.integers(1, symbols + 1, (20, 3)).tolist())
    lo, hi = index.search(patterns, np.full(len(patterns), 3))
    for p, a, b in zip(patterns.tolist(), lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if full[i : i + 3] == p]


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            v = words(other)
            for i in range(max(1, len(v) - window + 1)) if v else ():
                part = v[i : i + window]
                for k in range(len(w) - len(part) + 1):
                    if w[k : k + len(part)] == part:
                        hit.update(range(k, k + len(part)))
                        found |= {item} - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def made_up(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "漢", "x1"]
    items = [(k * 3, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 6, 7, 12])))) for k in range(25)]
    items += [(3, items[1][1]), (99, items[0][1]), (None, "alone by itself"), (100, None), (101, "..."), (102, "")]
    docs = []
    for i in range(150):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 40, 300]))]
        if r.random() < 0.5:
            at, part = r.randrange(len(w) + 1), (r.choice(items)[1] or "").split()
            w[at:at] = part[: r.randrange(len(part) + 1)] if r.random() < 0.4 else part
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return docs + [(5, "repeated id"), (None, "alone by itself"), (900, None), (901, "!?")], items


@pytest.mark.parametrize(("shard", "block"), [(1 << 19, 1 << 25), (50, 1 << 25), (300, 40)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    monkeypatch.setattr(M, "LOCATE_ROWS", 7)
    docs, items = made_up(shard)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    got = M.contamination(frame, bench, window=6, shard_words=shard)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    rows = got.collect()
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted(brute(docs, items, 6), key=key)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and len(r["items"]) == r.n_items
    clean = M.decontaminated(frame, bench, window=6, shard_words=shard)
    assert clean.columns == frame.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    for r in rows:
        if r.doc_id not in (None, 5):
            assert (r.doc_id in left) == (not r.contaminated)
            if not r.contaminated:
                text = dict(docs)[r.doc_id]
                hit = {k for s in r.spans for k in range(s.start, s.end)}
                assert left[r.doc_id] == text if not hit else words(left[r.doc_id]) == [w for k, w in enumerate(words(text)) if k not in hit]


@pytest.mark.parametrize("block", [1 << 25, 40])
def test_a_shard_is_sorted_once_whatever_the_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    docs, items = made_up(8)
    folder, paths = M.window_blocks(spark.createDataFrame(items + items, "item_id long, text string"), "item_id", "text", 6)
    assert (len(paths) == 1) == (block > 40)
    sorts, index = [], M.FMIndex
    monkeypatch.setattr(M, "FMIndex", lambda text, bits: sorts.append(len(text)) or index(text, bits))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    found = list(M._shards(iter([batch]), "text", folder, paths, 1 << 19, 6))
    assert len(found) == len(sorts) == 1
    assert found[0][1].tolist() == [len(words(t)) for _, t in docs]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert M.contamination(docs.limit(0), bench).count() == 0
    assert [(r.n_hit, r.contaminated) for r in M.contamination(docs, bench.limit(0)).orderBy("doc_id").collect()] == [(0, False), (0, False)]
    assert M.decontaminated(docs, bench.limit(0)).count() == 2
