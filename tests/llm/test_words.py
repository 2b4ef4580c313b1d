"""Word kernels against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from indexalg.llm import words as W

PATTERNS = [(W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts(seed, n):
    r = random.Random(seed)
    signs = ["a", "B", "ß", "é", "漢", "𐍈", " ", "\n", "\t", "\x0b", "\x1c", " ", "　", ".", "7", "|", "\x00", "\x7f"]
    return [None if r.random() < 0.05 else "".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 7, 40]))) for _ in range(n)]


@pytest.mark.parametrize(("table", "pattern"), PATTERNS)
@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_words_match_the_pattern(table, pattern, piece, monkeypatch):
    monkeypatch.setattr(W, "SLICE_BYTES", piece)
    rows = texts(piece, 300)
    hashes, count = W.words_of(*W.text_buffers(pa.array(rows)), table)
    want = [re.findall(pattern, lower(t)) for t in rows]
    assert count.tolist() == list(map(len, want))
    of, flat = {}, [w for x in want for w in x]
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_shingles_match_tuples():
    rows = ["a b c d e f a b c d e", "a b", "b a", "", None, "x " * 9, "a b c d e"]
    values, each = W.shingles_of(*W.words_of(*W.text_buffers(pa.array(rows)), W.SPACED), 5)
    want = []
    for t in rows:
        w = (t or "").split()
        want.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert each.tolist() == list(map(len, want))
    end = np.cumsum(each)
    sets = [set(values[e - n : e].tolist()) for e, n in zip(end, each, strict=True)]
    for x, p in zip(want, sets, strict=True):
        for y, q in zip(want, sets, strict=True):
            assert len(x & y) == len(p & q)


def test_slices_keep_rows_and_sliced_arrays():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, ""] * 5)], ["text"]).slice(1, 17)
    got = [t for part, data, off in W.slices([batch], "text", 20) for t in (bytes(data[a:b]).decode() for a, b in zip(off[:-1], off[1:], strict=True))]
    assert got == [t or "" for t in batch.column(0).to_pylist()]
